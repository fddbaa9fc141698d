"""Shared pieces of the training-data operators.

Arrow batches arrive with up to ten thousand rows, so every operator works through
them in slices of a few megabytes of text: memory in a Python worker is bounded by
one slice plus the longest single text, whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.checkpoint import cut, shared_folder  # noqa: F401
from spanloom.operators.joins import joined_by_count  # noqa: F401

SLICE_BYTES = 2 << 20
#: for the pipeline, whose stages share executors that have grown by then
STAGE_BYTES = 1 << 19
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
#: ASCII white space, and bytes with A-Z in lower case
WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """``df``, cut off, and marked for broadcast if it has ``rows`` rows at most (of a few numbers each)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def keep_rows(docs: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text: str = "text", limit: int = STAGE_BYTES) -> DataFrame:
    """The rows, with all of their columns, whose text ``verdict`` accepts; without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield part.filter(pa.array(verdict(part.column(text))))
            release()

    return docs.mapInArrow(run, docs.schema)


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges with about ``limit`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def map_slices(
    df: DataFrame, columns: list[str], f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, text: str = "text", limit: int = SLICE_BYTES
) -> DataFrame:
    """``f`` over every slice of the named columns; only those columns are read.

    ``f`` may return a dict of column arrays in the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                out = f(part)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
            release()

    return df.select(*columns).mapInArrow(run, schema)


def trim(cache: dict, most: int) -> None:
    """Halve a cache that holds over ``most`` entries; the oldest stay, since frequent words come first."""
    if len(cache) > most:
        for key in list(islice(reversed(cache), len(cache) - most // 2)):
            del cache[key]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each word, and the words: runs of anything but ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return pc.filter(rows, full).to_numpy().astype(np.int64), pc.filter(words, full)


def codes(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the strings, and the distinct strings."""
    encoded = strings.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Per row, the number (or summed weight) of its entries."""
    got = np.bincount(rows, weights=weights, minlength=n)
    return got.astype(np.int64)


def byte_class(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """Per text, the number of its bytes that are among ``wanted`` (ASCII only)."""
    hit = np.zeros(256, np.uint8)
    hit[list(wanted)] = 1
    return _per_text(texts, hit)


def code_points(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one row, and the n + 1 offsets between them; null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _per_text(texts: pa.Array, hit: np.ndarray) -> np.ndarray:
    raw, at = text_bytes(texts)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(hit[raw], out=total[1:])
    return np.diff(total[at])
