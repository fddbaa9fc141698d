"""Near-duplicate texts: SimHash proposes, further bands propose more, and shared shingles decide exactly.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of ``share`` (4/5)
or more, and a chain of links makes a group. Texts with equal sets are folded into one
print first, the sum of the set's hashes.

SimHash fingerprints (three-word shingles, pigeonhole blocks and star contraction, by op6's operator) propose
texts that differ in ``distance`` (3) bits or fewer. At 4/5 most pairs differ in more, and no number of
bits is both whole and narrow, so the texts of equal bands are proposed as well.
MinHash signatures in 28 bands of 4 only propose texts, too: a pair at exactly 4/5
has no equal band with probability 4e-7, and less above. Each text of a band's bucket is
tied to the bucket's first, and connected components of these ties hold every proposed
pair. A component's texts then meet on one task, where each shared shingle counts, and
only pairs that reach ``share`` are links. A component with more than ``cell`` texts, or
more than ``load`` shingles in all, is cut into parts that meet pairwise on different tasks; so
a task's memory is bounded by two such parts, or two texts where these are longer.

Lists of chosen documents (two numbers a row) are broadcast up to a million rows, and beyond
that joined by key, which shuffles the texts once.

Defined results: null, empty and blank texts have no shingles and are one group; a text
with fewer than five words is one shingle; texts of any length are taken whole; repeated
rows are one group, as are texts with equal sets; of a group the smallest id stays (of equal
ids the smallest print); an empty table gives no rows; further columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import simhash
from spanloom.llm.common import cut, joined_by_count, map_slices, release, slices, small
from spanloom.llm.graph import components
from spanloom.llm.simhash import shingles

BANDS, ROWS = 28, 4
#: fixed values: odd constants, one for each permutation, and one that mixes keys
FACTORS = np.random.default_rng(42).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text of each distinct shingle, and its hash; sorted by both."""
    rows, hashes = shingles(texts, width)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])][: len(rows)]
    return rows[new], hashes[new]


def prints(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text, the sum of its set's hashes; zero where there are none."""
    out = np.zeros(n, np.uint64)
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(hashes, first)
    return out.view(np.int64)


def band_keys(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and a row of ``BANDS`` keys for each."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    keys = np.zeros((len(first), BANDS), np.uint64)
    for k, factor in enumerate(FACTORS):
        band = k // ROWS
        least = np.minimum.reduceat(hashes * factor, first)
        mixed = keys[:, band] ^ least if k % ROWS else least + np.uint64(band)
        keys[:, band] = (mixed ^ mixed >> np.uint64(29)) * MIX
    return rows[first], keys.view(np.int64)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, fp, size, keys, sim)``: the print of a text's set, its number of shingles, its bands' keys, and its SimHash fingerprint."""

    def f(part: pa.RecordBatch) -> dict:
        rows, hashes = sets(part.column("text"), width)
        own, keys = band_keys(rows, hashes)
        size = np.zeros(part.num_rows, np.int32)
        size[own] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(keys.ravel()))
        sim = simhash.simhash(*shingles(part.column("text")), part.num_rows).view(np.int64)
        return {"doc_id": part.column("doc_id"), "fp": prints(rows, hashes, part.num_rows), "size": np.bincount(rows, minlength=part.num_rows), "keys": lists, "sim": sim}

    return map_slices(docs, ["doc_id", "text"], f, "doc_id long, fp long, size long, keys array<long>, sim long", limit=1 << 20)


def printed(docs: DataFrame, name: str, width: int = 5) -> DataFrame:
    """``docs`` with the print of each text as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.append_column(name, pa.array(prints(*sets(part.column("text"), width), part.num_rows)))
            release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def alike(texts: pa.Array, side: np.ndarray, share: tuple[int, int], width: int = 5) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between texts; ``side`` 0 and 1 link across, 2 with all."""
    n = len(texts)
    rows, hashes = sets(texts, width)
    size = np.bincount(rows, minlength=n)
    at = np.r_[0, np.cumsum(size)]
    _, code = np.unique(hashes, return_inverse=True)
    owner = rows[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code)) if len(code) else np.zeros(0, np.int64)
    starts = np.r_[0, ends[:-1]]
    root = np.arange(n)
    a, b = [], []
    for k in range(n - 1):
        mine = code[at[k] : at[k + 1]]
        length = ends[mine] - starts[mine]
        place = np.arange(length.sum()) + np.repeat(starts[mine] - np.cumsum(length) + length, length)
        shared = np.bincount(owner[place], minlength=n)
        near = share[1] * shared >= share[0] * (size[k] + size - shared)
        near &= (root != root[k]) & ((side == 2) | (side != side[k]))
        found = np.flatnonzero(near)
        if len(found):
            _, one = np.unique(root[found], return_index=True)
            a += [k] * len(one)
            b += found[one].tolist()
            root[np.isin(root, root[found])] = root[k]
            if (root == root[0]).all():
                break
    return a, b


def plain_ids(own: DataFrame) -> bool:
    """Whether no document id is null or repeated, so that it names a row without the print of its text."""
    return own.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def folded(own: DataFrame) -> DataFrame:
    """``(fp, n, best, size, keys)``: each print once, with its number of texts and its first document."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best")
    return cut(own.groupBy("fp").agg(F.count("*").alias("n"), best, F.max("size").alias("size"), F.first("keys").alias("keys")))


def simhash_links(own: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)`` pairs of prints: each print of a SimHash group (``simhash.groups``) with the group's smallest."""
    pairs = cut(own.select("fp", "sim").distinct())
    groups = simhash.groups(cut(pairs.select(F.col("sim").alias("fp")).distinct()), distance).withColumnRenamed("fp", "sim")
    rooted = cut(pairs.join(groups, "sim").select("fp", "root").distinct())
    low = rooted.groupBy("root").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return joined_by_count(rooted, low, "root", "n", rooted.count()).where("a <> fp").select("a", F.col("fp").alias("b"))


def links(docs: DataFrame, prints: DataFrame, plain: bool, share: tuple[int, int] = (4, 5), cell: int = 1024, width: int = 5, load: int = 500_000, proposed: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` pairs of prints that connect exactly the groups; ``prints`` is ``folded(signatures(docs))``.

    ``proposed`` are pairs ``(a, b)`` to verify besides those of the bands.
    """
    keyed = prints.select("fp", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("a <> z").select("key", "a", "n")
    ties = joined_by_count(keyed, low, "key", "n", BANDS * prints.count(), cell)
    ties = ties.where("fp <> a").select("a", F.col("fp").alias("b"))
    roots = cut(components(ties if proposed is None else ties.unionByName(proposed)))
    # one document of each set that is to be compared
    sizes = roots.join(prints.select(F.col("fp").alias("node"), "size"), "node")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(cell), F.sum("size") / F.lit(load)))
    size = sizes.groupBy("root").agg(F.count("*").alias("n"), F.greatest(parts, F.lit(1)).alias("parts"))
    members = joined_by_count(roots, size, "root", "n", roots.count(), cell)
    chosen = prints.select("fp", "best.doc_id").join(members, F.col("fp") == F.col("node"))
    chosen = small(chosen.select("root", "parts", F.col("doc_id").alias("chosen_id"), F.col("fp").alias("chosen_fp")))
    if plain:
        full = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("chosen_id")).withColumnRenamed("chosen_fp", "fp")
    else:
        full = printed(docs.select("doc_id", "text"), "fp", width)
        full = full.join(chosen, full["doc_id"].eqNullSafe(chosen["chosen_id"]) & (full["fp"] == chosen["chosen_fp"])).dropDuplicates(["doc_id", "fp"])
    parts = F.col("parts")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda o: F.struct(
            (F.least(mine, o) * parts + F.greatest(mine, o)).alias("cell"),
            F.when(mine == o, 2).when(mine < o, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = full.select("root", "fp", "text", F.explode(cells).alias("c")).select("root", "c.cell", "c.side", "fp", "text")
    dealt = dealt.repartition(F.col("root"), F.col("cell")).sortWithinPartitions("root", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            text, side, fp = (pa.concat_arrays([x.column(c) for x in held]) for c in ("text", "side", "fp"))
            a, b = alike(text, side.to_numpy(), share, width)
            fp = fp.to_numpy()
            return pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

        last = None
        for batch in batches:
            root, where = batch.column("root").to_numpy(), batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (where[1:] != where[:-1])][: len(root)])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(root)]):
                if held and last != (root[s], where[s]):
                    yield emit()
                    held = []
                part = batch.slice(s, e - s)  # strings with long offsets: a cell of two long texts may pass 2 GB
                held.append(part.set_column(part.schema.get_field_index("text"), "text", part.column("text").cast(pa.large_string())))
                last = root[s], where[s]
        if held:
            yield emit()

    return dealt.mapInArrow(run, "a long, b long")


def keep_first(docs: DataFrame, share: tuple[int, int] = (4, 5), cell: int = 1024, width: int = 5, load: int = 500_000, distance: int = 3) -> DataFrame:
    """One row of each group, with all of its columns: that of the smallest doc_id, null ids last."""
    own = cut(signatures(docs, width))
    plain, prints = plain_ids(own), folded(own)
    roots = components(links(docs, prints, plain, share, cell, width, load, simhash_links(own, distance)))
    grouped = prints.select("fp", "best").join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    name = "fp"
    while name in docs.columns:
        name = f"_{name}"
    chosen = small(grouped.select(F.col("best.doc_id").alias("chosen_id"), F.col("best.fp").alias("chosen_fp")))
    if plain:
        return docs.join(chosen, docs["doc_id"] == chosen["chosen_id"], "left_semi")
    full = printed(docs, name, width)
    same = full["doc_id"].eqNullSafe(chosen["chosen_id"]) & (full[name] == chosen["chosen_fp"])
    return full.join(chosen, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
