"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distances.

A fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` parts, so every choice of
that many parts is a key, and any linked pair shares a key. Equal fingerprints are
folded into one before that, keyed by their smallest document.

Keys that hold one fingerprint cannot link. Other keys are dealt out by key and sorted;
a task walks its sorted rows, compares the fingerprints of a key in numpy, and gives out
a spanning forest of each key's links, never all of its pairs. A key with more than
``cell`` fingerprints is cut into parts that meet pairwise in cells of bounded size on
different tasks, so that a hot key is whole but never in one task. Sizes reach the rows of
frequent keys and fingerprints by broadcast, of a number of keys that is bounded.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; texts of any length are taken whole; repeated rows fall into one group; rows with a null doc_id get their fingerprint
and the group's smallest id (null if the group has none); an empty table gives no rows;
further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, WHITE, cut, joined_by_count, map_slices, table, text_bytes
from spanloom.llm.graph import components, local_components
from spanloom.llm.registry import QUERIES
from spanloom.llm.xxh import xxh64

BITS = 64


def shingles(texts: pa.Array, width: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Text of each shingle, and its XXH64: ``width`` words of the lower-cased text, space-joined.

    Repeats are included; a text with fewer words has one shingle of all its words.
    """
    raw, at = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = inside & np.r_[True, ~inside[:-1]] | inside & edge[:-1]
    word = np.cumsum(start)[inside] - 1
    n = int(start.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = np.full(len(word) + n, 32, np.uint8)
    joined[np.arange(len(word)) + word] = LOWER[raw[inside]]
    ends = np.cumsum(np.bincount(word, minlength=n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    row = np.searchsorted(at, np.flatnonzero(start), "right") - 1
    last = np.searchsorted(row, row, "right")
    first = np.searchsorted(row, row, "left")
    k = np.arange(n)
    own = np.flatnonzero((k + width <= last) | (k == first))
    ends = ends[np.minimum(own + width, last[own]) - 1]
    return row[own], xxh64(joined, starts[own], ends - starts[own], seed)


def simhash(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; zero where there are none."""
    out = np.zeros(n, np.uint64)
    edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True]) if len(rows) else np.zeros(1, int)
    ones = np.zeros((max(len(edges) - 1, 0), BITS), np.int64)
    step = 1 << 16
    for at in range(0, len(rows), step):  # bits are unpacked for a bounded number of hashes at a time
        bits = np.unpackbits(hashes[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + len(bits), "left")
        cuts = np.maximum(edges[lo:hi], at) - at
        for k, (s, e) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(bits)])):
            ones[lo + k] += bits[s:e].sum(0, dtype=np.uint32)
    total = np.diff(edges)
    if len(total):
        out[rows[edges[:-1]]] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp holds the 64 bits as a signed long."""

    def f(part: pa.RecordBatch) -> dict:
        rows, hashes = shingles(part.column("text"), width)
        return {"doc_id": part.column("doc_id"), "fp": simhash(rows, hashes, part.num_rows).view(np.int64)}

    return map_slices(docs, ["doc_id", "text"], f, "doc_id long, fp long", limit=1 << 20)


def block_keys(blocks: int, distance: int) -> list[int]:
    """Masks over 64 bits, one for each choice of ``blocks - distance`` parts."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(key: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each run of equal keys; rows are sorted by key.

    ``side`` 0 and 1 are the two parts of a cell, which link across; 2 links with all.
    """
    n = len(key)
    a_all, b_all = [], []
    root = np.arange(n)
    live = np.arange(n)
    step = 1
    while len(live):
        live = live[live + step < n]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        other = live + step
        new = root[live] != root[other]
        a, b = live[new], other[new]
        cross = (side[a] == 2) | (side[a] != side[b])
        a, b = a[cross], b[cross]
        near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= distance
        a, b = a[near], b[near]
        if len(a):
            a_all.append(a)
            b_all.append(b)
            if step % 16 == 0:
                root = local_components(n, np.concatenate(a_all), np.concatenate(b_all))
                a_all, b_all = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]]
        step += 1
    if not a_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = local_components(n, np.concatenate(a_all), np.concatenate(b_all))
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def links(prints: DataFrame, distance: int = 3, blocks: int = 6, cell: int = 4096) -> DataFrame:
    """``(a, b)`` pairs of fingerprints that connect whatever is within ``distance`` bits.

    ``prints`` has distinct ``fp`` and is read more than once. Two fingerprints are connected by the result exactly
    if a chain of links within ``distance`` joins them.
    """
    masks = block_keys(blocks, distance)
    # the choice's number is mixed in; a chance collision only adds comparisons
    key: Column = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(m))), F.lit(k)) for k, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(key).alias("key"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = joined_by_count(keyed, size, "key", "n", len(masks) * prints.count(), cell)
    parts = F.ceil(F.col("n") / F.lit(cell))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    cells = F.when(parts <= 1, F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(2).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), parts - 1),
            lambda o: F.struct(
                (F.least(own, o) * parts + F.greatest(own, o)).alias("cell"),
                F.when(own == o, 2).when(own < o, 0).otherwise(1).alias("side"),
            ),
        )
    )
    dealt = full.select("key", "fp", F.explode(cells).alias("c")).select(F.xxhash64("key", "c.cell").alias("key"), "fp", "c.side")
    dealt = dealt.repartition(F.col("key")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            k, fp, side = rows
            a, b = forest(k, fp, side, distance)
            return pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("key", "fp", "side")))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held))
            keep = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            yield emit(tuple(x[:keep] for x in rows))
            held = [tuple(x[keep:] for x in rows)]
        if held:
            yield emit(tuple(np.concatenate(x) for x in zip(*held)))

    return dealt.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, distance: int = 3, blocks: int = 6, cell: int = 4096) -> DataFrame:
    """``(fp, root)`` for distinct fingerprints: equal roots are one group."""
    roots = components(links(prints, distance, blocks, cell))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 6, cell: int = 4096, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every document."""
    own = cut(fingerprints(docs, width))
    prints = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    joined = cut(prints.join(groups(prints.select("fp"), distance, blocks, cell), "fp"))
    # a group's smallest document over all of its fingerprints
    low = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    known = cut(joined_by_count(joined, low, "root", "size", prints.count()).select("fp", "component_id", "n"))
    return joined_by_count(own, known, "fp", "n", own.count()).select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op6_simhash"] = op6_simhash
