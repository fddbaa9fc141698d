"""Best-fit packing of token sequences.

Best-fit decreasing looks only at lengths, and lengths are whole numbers from 1 to the
capacity. So the packing of any number of pieces follows from the histogram of their
lengths: a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and a run of equal pieces fills the equal bins found there together.
The resulting plan has a few thousand rows at most, whatever the corpus holds, and gives
each piece the bin that document-by-document best-fit decreasing would (up to the names
of equal bins): the packing is that of the whole corpus, not of shards. A piece finds
its row in the plan from its length and its rank among equal lengths, and ranks come from
counts per bucket of rows, so neither a length nor a repeated row is gathered in one task.

Defined results: null and empty texts are the end token alone; texts of any length are
coded whole and only then cut; repeated rows are packed one by one; an empty table gives
no rows; further columns of the input are not read. Among pieces of equal length the order
is that of the rows; among equally tight bins the one opened or reduced last is taken.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import codes, cut, map_slices, table, trim
from spanloom.llm.registry import QUERIES

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class Capacities:
    """Segment tree over remaining capacities 0 to ``top``; a leaf holds its open bins."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def _add(self, left: int, n: int) -> None:
        k = left + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, left: int, first: int, n: int) -> None:
        """``n`` bins from number ``first`` on, each with ``left`` free."""
        if n:
            self.bins[left].append((first, n))
            self._add(left, n)

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins with exactly ``left`` free, with consecutive numbers."""
        first, n = self.bins[left].pop()
        got = min(n, most)
        if got < n:
            self.bins[left].append((first + got, n - got))
        self._add(left, -got)
        return first, got

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that has an open bin."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """The plan: rows (length, first rank, first bin, pieces per bin, offset in the bin).

    The piece of ``length`` with rank r, ``first rank`` <= r, goes to bin
    ``first bin + (r - first rank) // per bin``, behind ``(r - first rank) % per bin``
    equal pieces from ``offset`` on.
    """
    tree, bins, plan = Capacities(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            each = (capacity if room is None else room) // length
            want = max(left // each, 1)
            if room is None:
                room, first, n = capacity, bins, want
                bins += n
            else:
                first, n = tree.take(room, want)
            each = min(each, left)
            plan.append((length, rank, first, each, capacity - room))
            tree.put(room - each * length, first, n)
            rank += n * each
            left -= n * each
    return np.array(plan, np.int64).reshape(-1, 5)


class Encoder(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of text parts cut before a space.

    A space that a non-space follows always starts a token of the byte-level pattern, so a
    text's ids are those of its parts. Of parts that are not in the cache, signs behind a run
    of letters are a token of their own, plain Latin ones with white space inside are cut by
    the pattern, and what is left is coded, many parts in one text. The dictionary itself
    holds what stands behind a space, under its bare text, and ``known`` other tokens; both
    are bounded in entries, and no entry of over ``LONG`` characters outlives its slice. Texts are cut only for a file with that byte-level pattern and no normaliser;
    any other vocabulary codes whole texts.
    """

    LONG = 256
    SIGNS = ".,!?;:$%&*#|"
    #: a space that any white space of Unicode follows
    ODD = r" [\s\x0b\x1c-\x1f\x{85}\pZ]"

    def __init__(self, path: str, most: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        pattern = self.model.pre_tokenizer
        self.cuts = isinstance(pattern, ByteLevel) and not pattern.add_prefix_space and pattern.use_regex and self.model.normalizer is None
        self.model.encode_special_tokens = True  # their strings are ordinary text
        self.most = most
        self.cut = re.compile(r" (?=\S)")
        self.plain = re.compile(r"[\n\t !-~\u00a1-\u00ff]*").fullmatch
        self.white = re.compile(r"\s").search
        self.tokens = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, bytes] = {}
        self.long = False  # whether there may be long entries
        names = self.model.get_vocab()
        self.space = np.zeros(1 + max(names.values()), bool)
        self.space[[k for name, k in names.items() if name.startswith("\u0120")]] = True  # the sign for a space

    def ids(self, parts: list[str]) -> list[bytes]:
        got = [x.ids for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), "<u4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, got)])).tolist()
        return [flat[s:e] for s, e in zip(ends, ends[1:])]

    def spaced(self, parts: list[str], together: int = 1000) -> list[bytes]:
        """Ids of parts without white space, each behind a space, coded many at a time.

        Each part then has one token that starts with the space, its first.
        """
        lines = [" " + " ".join(parts[k : k + together]) for k in range(0, len(parts), together)]
        got = [x.ids for x in self.model.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), "<u4")
        ends = (4 * np.append(np.flatnonzero(self.space[flat]), len(flat))).tolist()
        if len(ends) != len(parts) + 1:
            return self.ids([" " + x for x in parts])
        raw = flat.tobytes()
        return [raw[s:e] for s, e in zip(ends, ends[1:])]

    def learn(self, parts: list[str]) -> None:
        """Make every part, as it stands behind a space, known."""
        behind: set[str] = set()  # without white space
        other: set[str] = set()
        made: list[tuple[str, str, str]] = []
        rest: list[str] = []
        for part in parts:
            core = part.rstrip(self.SIGNS)
            if core.isalpha():
                behind.add(core)
                if core is not part:
                    other.add(tail := part[len(core) :])
                    made.append((part, core, tail))
            elif part and not self.white(part):
                behind.add(part)
            else:
                rest.append(part)
        new = [x for x in behind if x not in self]
        self.update(zip(new, self.spaced(new)))
        new = [x for x in other if x not in self.known]
        self.known.update(zip(new, self.ids(new)))
        known = self.known
        self.update((part, self[core] + known[tail]) for part, core, tail in made)
        self.update(self.cut_further(rest))

    def cut_further(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts with white space inside, from those of the pattern's tokens where they are plain."""
        cut = [self.tokens(" " + x) if self.plain(x) else [" " + x] for x in parts]
        heads = [x for x in {t[0][1:] for t in cut} if x.isalpha() and x not in self]
        self.update(zip(heads, self.spaced(heads)))
        new = [x for x in {t for x in cut for t in x} if x not in self.known and not (x[0] == " " and x[1:] in self)]
        self.known.update(zip(new, self.ids(new)))
        return {x: b"".join(self[t[1:]] if t[0] == " " and t[1:] in self else self.known[t] for t in tokens) for x, tokens in zip(parts, cut)}

    def coded(self, parts: pa.ListArray) -> list[bytes]:
        """Ids of texts given as their parts: each distinct part is looked up once, and the rest is gathered."""
        flat, at = parts.flatten(), np.diff(parts.offsets.to_numpy()).cumsum()
        first = np.r_[0, at[:-1]]
        inner = np.ones(len(flat), bool)
        inner[first] = False
        code, kinds = codes(flat.filter(pa.array(inner)))
        units = kinds.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in units if x not in self]
        if new:
            self.long = self.long or max(map(len, new)) > self.LONG
            self.learn(new)
        held = list(map(self.__getitem__, units)) + self.ids(flat.take(pa.array(first)).to_pylist())
        which = np.empty(len(flat), np.int64)
        which[inner] = code
        which[first] = len(units) + np.arange(len(first))
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begin = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        place = np.repeat(begin[which] - ends + n, n) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(held), "<u4")[place].tobytes()
        stops = (4 * ends[at - 1]).tolist()
        return [raw[s:e] for s, e in zip([0, *stops], stops)]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        if not self.cuts:
            return self.ids(texts.to_pylist())
        for held in (self, self.known) if self.long else ():
            for part in [x for x in held if len(x) > self.LONG]:
                del held[part]
        self.long = False
        trim(self, self.most)
        trim(self.known, self.most // 3)
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if not odd.all():
            plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            for k, ids in zip(np.flatnonzero(~odd).tolist(), self.coded(plain)):
                out[k] = ids
        if odd.any():
            cut = [self.cut.split(x) for x in texts.filter(pa.array(odd)).to_pylist()]
            for k, ids in zip(np.flatnonzero(odd).tolist(), self.coded(pa.array(cut, pa.list_(pa.string())))):
                out[k] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, most: int | None = None) -> DataFrame:
    """Tokenised documents, cut where they are longer than ``capacity``.

    With ``most`` every task has an encoder of its own, of that many entries, which ends with it; else a worker keeps one.
    """
    own: list[Encoder] = []  # a task has a copy of the list
    end = np.array([end_id], "<u4").tobytes()

    def f(part: pa.RecordBatch) -> dict:
        if most is not None and not own:
            own.append(Encoder(path, most))
        code = own[0] if own else encoder(path)
        out: list[tuple] = []
        rows: list[int] = []
        for row, ids in enumerate(code(part.column("text"))):
            ids += end
            n = len(ids) // 4
            first = n % capacity or capacity
            starts = [0, *range(first, n, capacity)]
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], n])):
                out.append((k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
                rows.append(row)
        columns = list(zip(*out)) or [()] * 4
        return {
            "doc_id": part.column("doc_id").take(pa.array(rows, pa.int64())),
            "piece": pa.array(columns[0], pa.int32()),
        } | {k: pa.array(columns[i], pa.int64()) for i, k in enumerate(("start", "length", "ids_crc32"), 1)}

    return map_slices(docs, ["doc_id", "text"], f, PIECES, limit=1 << 20)


def pack(found: DataFrame, capacity: int = 1024, bucket_rows: int = 65_536) -> DataFrame:
    """Give every piece a sequence and an offset; ``found`` has the columns of ``pieces``."""
    # buckets are stretches of rows: a repeated row or a common length fills many of them
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = best_fit_decreasing(sizes, capacity)
    found = found.withColumn("bucket", F.expr(f"row div {bucket_rows}"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("bucket", "length").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("bucket", "length").orderBy("row")
    ranked = found.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(base.select("bucket", "length", "base"), ["bucket", "length"])
    ranked = ranked.select(*[c.split()[0] for c in PIECES.split(", ")], (F.col("rank") + F.col("base")).alias("rank"))
    top = int(max(sizes.values(), default=0)) + 1
    keys = plan[:, 0] * top + plan[:, 1]
    by = np.argsort(keys)
    keys, plan = keys[by], plan[by]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * top + rank, "right") - 1]
            at = rank - row[:, 1]
            out = {c: batch.column(c) for c in batch.schema.names[:5]}
            yield pa.RecordBatch.from_pydict(
                out | {"sequence_id": row[:, 2] + at // row[:, 3], "offset": row[:, 4] + at % row[:, 3] * length}
            )

    return ranked.mapInArrow(place, PACKED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), default_vocabulary()))


QUERIES["op7_best_fit_packing"] = op7_best_fit_packing
