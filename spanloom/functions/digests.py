"""Digests in Arrow batches: BLAKE2b of normalised texts, MinHash over unsigned 64 bits, SHA-256 of files.

Hash functions that the engine lacks run here, over whole batches; the result of a passage needs no
shuffle, since its paragraphs, shingles and bands never leave its row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from spanloom.functions.text import folded

# fixed value: odd constant that spreads the permutation masks
SPREAD = 0x9E3779B97F4A7C15
PARAGRAPH = re.compile(r"\n\s*\n+")
TOP = np.uint64(1 << 63)


def blake2b_hex(text: str, size: int = 16) -> str:
    return hashlib.blake2b(text.encode(), digest_size=size).hexdigest()


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """The texts as strings, of which one is held at a time, not those of a whole batch."""
    return (t.as_py() for t in texts)


@F.arrow_udf(StringType())
def normalized_digest(texts: pa.Array) -> pa.Array:
    """128-bit BLAKE2b, in hexadecimal digits, of each text's folded form; null stays null."""
    return pa.array([None if t is None else blake2b_hex(folded(t)) for t in one_by_one(texts)], pa.string())


def long_paragraphs(text: str, min_chars: int) -> list[str]:
    """Folded forms of the paragraphs, between blank lines, of over ``min_chars`` characters."""
    return [folded(p) for p in PARAGRAPH.split(text) if len(p.strip()) > min_chars]


@cache
def masks(n: int) -> np.ndarray:
    return np.array([k * SPREAD % (1 << 64) for k in range(n)], np.uint64)


def signature_of(normalized: str, n: int, width: int) -> np.ndarray:
    """Unsigned minima of the text's distinct word windows under ``n`` masks."""
    raw = " ".join(normalized.split()).encode()
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    ends = [*spaces[width - 1 :].tolist(), len(raw)]
    windows = {raw[s:e] for s, e in zip([0, *(spaces + 1).tolist()], ends)}
    hashes = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in windows]), ">u8").astype(np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):  # bounded memory for very long texts
        np.minimum(low, (hashes[None, k : k + 4096] ^ masks(n)[:, None]).min(1), out=low)
    return low


def minhash_signature(text: Column, n: int = 32, width: int = 5) -> Column:
    """``n`` minima as longs whose order is that of the unsigned values: their highest bit is flipped."""

    @F.arrow_udf(ArrayType(LongType()))
    def f(texts: pa.Array) -> pa.Array:
        held = [None if t is None else (signature_of(folded(t), n, width) ^ TOP).view(np.int64) for t in one_by_one(texts)]
        return pa.array(held, pa.list_(pa.int64()))

    return f(text)


def passage_keys(text: Column, min_chars: int = 80, bands: int = 8, rows: int = 4, width: int = 5) -> Column:
    """``struct(digest, paragraphs, bands)``: all keys by which a passage can be a duplicate, in one pass.

    The digests of the text and of its long paragraphs, and a 64-bit key of each band of its signature.
    """

    @F.arrow_udf("struct<digest:string,paragraphs:array<string>,bands:array<bigint>>")
    def f(texts: pa.Array) -> pa.Array:
        out = []
        for t in one_by_one(texts):
            if t is None:
                out.append(None)
                continue
            whole = folded(t)
            low = signature_of(whole, bands * rows, width).reshape(bands, rows)
            keys = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True) for x in low]
            parts = [blake2b_hex(p) for p in dict.fromkeys(long_paragraphs(t, min_chars))]
            out.append({"digest": blake2b_hex(whole), "paragraphs": parts, "bands": keys})
        return pa.array(out, pa.struct([("digest", pa.string()), ("paragraphs", pa.list_(pa.string())), ("bands", pa.list_(pa.int64()))]))

    return f(text)


def file_digests(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """``(path, length, sha256)`` of the files below ``root``; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
