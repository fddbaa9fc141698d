"""Personal data: base patterns, and bootstrapped contextual extraction.

Base patterns find e-mail addresses, network addresses, card numbers and phone numbers: the
seed entities. The words around seeds, and around other runs of words with digits
(mentions), are lexical patterns: the word before, the two words before, and the words on
both sides. Patterns and the distinct strings in their slot (instances) are a bipartite
graph, which Spark scores in rounds:

* a pattern's confidence is the share of its extractions that are known instances; ordinary
  words in its slot, counted over all texts, are extractions that are not;
* a pattern counts if ``support`` different known instances are in it and its confidence is
  ``confidence`` or more;
* an unseen instance is known from the next round on if the patterns around it, taken as
  independent, are wrong altogether with a chance of ``1 - evidence`` at most.

Mentions of instances that became known are the spans the method adds, of kind ``context``.

Ordinary words are counted only for patterns that can count at all: these set bits in a
filter of ``2 ** filter_bits`` bits, the one thing that is broadcast; a join keeps the counts
exact when the filter is full. Confidences are quotients of whole numbers and evidence is added up in whole
micro-nats, so results do not depend on the order of rows.

Defined results: null and empty texts have no spans; texts of any length are searched whole;
repeated rows give repeated results, and repeated strings are one instance; spans of equal
start are listed by kind; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, WHITE, cut, joined_by_count, map_slices, table
from spanloom.llm.registry import QUERIES
from spanloom.llm.xxh import xxh64

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive, and from the first digit of a run: the same matches without a second look at any digit
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = bytes(range(48, 58))
NOT_DIGITS = bytes(x for x in range(256) if x not in DIGITS)
EDGES = b".,;:!?\"'()[]{}<>"
DIGIT = np.isin(np.arange(256), list(DIGITS))
#: what a word of a mention is made of, apart from signs at its edges
ALLOWED = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+_%@/#()-" + EDGES))
MOST_WORDS, LEAST_DIGITS = 4, 4


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = (d - 48) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes, in order."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        size = at - free
        own = size - len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if own and (m := DOMAIN.match(text, at)):
            out.append((at - own, 0, m.end()))
            free = m.end()
        at = text.find(b"@", free)
    for m in IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m[0].split(b".")]
        if all(len(p) < 3 or len(p) == 3 and p <= b"255" for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].translate(None, b" -")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(m[0].translate(None, NOT_DIGITS)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Page:
    """A slice of texts in one buffer, apart by line ends: its words, base spans and mentions."""

    raw: np.ndarray
    at: np.ndarray  # first byte of each text, and one past the last one's line end
    start: np.ndarray  # of words
    stop: np.ndarray
    row: np.ndarray
    base: list[tuple[int, int, int]]
    spans: np.ndarray  # (start, end, first word, last word, 1 if base), by start
    taken: np.ndarray  # words that are in one of these


def page(texts: pa.Array) -> Page:
    bodies = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts.cast(pa.large_binary())]
    text = b"\n".join([*bodies, b""])
    raw = np.frombuffer(text, np.uint8)
    at = np.r_[0, np.cumsum([len(x) + 1 for x in bodies])].astype(np.int64)
    inside = np.r_[False, ~WHITE[raw], False]
    start, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    base = base_spans(text)
    taken = np.zeros(len(start), bool)
    spans = []
    for s, _, e in base:
        first, last = int(np.searchsorted(stop, s, "right")), int(np.searchsorted(start, e, "left")) - 1
        taken[first : last + 1] = True
        spans.append((s, e, first, last, 1))
    total = np.r_[0, np.cumsum(DIGIT[raw], dtype=np.int64)]
    odd = np.r_[0, np.cumsum(~ALLOWED[raw], dtype=np.int64)]
    digits = total[stop] - total[start]
    wanted = np.flatnonzero((digits > 0) & (odd[stop] == odd[start]) & ~taken)
    k = 0
    while k < len(wanted):
        first = last = int(wanted[k])
        s, e = start[first], start[first] + len(text[start[first] : stop[first]].rstrip(EDGES))
        s += len(text[s:e]) - len(text[s:e].lstrip(EDGES))
        k += 1
        # words that follow after one space, as long as no sign ends the one before
        while k < len(wanted) and wanted[k] == last + 1 and start[last + 1] == stop[last] + 1 and raw[stop[last]] == 32 and text[stop[last] - 1] not in b".,;:!?":
            last += 1
            e = start[last] + len(text[start[last] : stop[last]].rstrip(EDGES))
            k += 1
        if last - first < MOST_WORDS and digits[first : last + 1].sum() >= LEAST_DIGITS:
            taken[first : last + 1] = True
            spans.append((int(s), int(e), first, last, 0))
    row = np.searchsorted(at, start, "right") - 1
    return Page(raw, at, start, stop, row, base, np.array(sorted(spans), np.int64).reshape(-1, 5), taken)


def mixed(kind: int, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of a kind of pattern and its words."""
    with np.errstate(over="ignore"):
        x = (a + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        if b is not None:
            x = (x ^ (x >> np.uint64(29)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def patterns(raw: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (three for each place) and whether they exist.

    ``ranges``: start, stop and whether it is there, of the word before, the second before and the one after.
    """
    (one, two, after), there = [xxh64(raw, s, np.where(ok, e - s, 0), 3) for s, e, ok in ranges], [ok for _, _, ok in ranges]
    keys = np.stack([mixed(1, one), mixed(2, one, two), mixed(3, one, after)], axis=1)
    return keys, np.stack([there[0], there[0] & there[1], there[0] & there[2]], axis=1)


def around(p: Page, lower: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``patterns`` of the places from byte ``at`` in word ``first`` to ``end`` in word ``last``; words in other spans are none."""
    n = len(p.start)

    def word(k: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = np.clip(k, 0, max(n - 1, 0))
        ok = (k >= 0) & (k < n)
        ok &= (p.row[near] == row) & ~p.taken[near] if n else False
        return (p.start[near], p.stop[near], ok) if n else (at, at, ok)

    row = p.row[first] if n else first
    head, tail = (p.start[first] < at, p.stop[last] > end) if n else (at < 0, at < 0)  # parts of words that are before and after
    s1, e1, ok1 = word(first - 1, row)
    s2, e2, ok2 = word(np.where(head, first - 1, first - 2), row)
    s3, e3, ok3 = word(last + 1, row)
    one = np.where(head, p.start[first], s1) if n else s1, np.where(head, at, e1), ok1 | head
    after = np.where(tail, end, s3), np.where(tail, p.stop[last], e3) if n else e3, ok3 | tail
    return patterns(lower, [one, (s2, e2, ok2), after])


MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SCHEMA = (
    "doc_id long, _row long, base array<struct<start int, kind int, end int>>, "
    "mentions array<struct<start int, end int, seed boolean, instance long, patterns array<long>>>"
)


def found(part: pa.RecordBatch) -> dict:
    """Base spans and mentions of each text, in code points, the mentions with their instance and patterns."""
    p = page(part.column("text"))
    point = np.r_[0, np.cumsum((p.raw & 0xC0) != 0x80)]

    def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, p.at), pa.int32()), values)

    def points(at: np.ndarray) -> pa.Array:
        return pa.array(point[at] - point[p.at[np.searchsorted(p.at, at, "right") - 1]], pa.int32())

    s, kind, e = np.array(p.base, np.int64).reshape(-1, 3).T
    base = pa.StructArray.from_arrays([points(s), pa.array(kind, pa.int32()), pa.array(point[e] - point[s], pa.int32())], fields=list(SPAN))
    base = pa.StructArray.from_arrays([base.field(0), base.field(1), pc.add(base.field(0), base.field(2))], fields=list(SPAN))
    start, end, first, last, seed = p.spans.T
    lower = LOWER[p.raw]
    keys, there = around(p, lower, start, first, last, end)
    offsets = pa.array(np.r_[0, np.cumsum(there.sum(1))], pa.int32())
    begin = points(start)
    mentions = pa.StructArray.from_arrays(
        [
            begin, pc.add(begin, pa.array(point[end] - point[start], pa.int32())), pa.array(seed == 1), pa.array(xxh64(lower, start, end - start, 5).view(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(keys[there].view(np.int64))),
        ],
        fields=list(MENTION),
    )
    return {"doc_id": part.column("doc_id"), "_row": part.column("_row"), "base": lists(s, base), "mentions": lists(start, mentions)}


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter with the bit of each ``pattern`` set; at most ``2 ** bits / 63`` rows reach the driver."""
    place = F.col("pattern").bitwiseAND(F.lit((1 << bits) - 1))
    word = F.floor(place / 63)
    got = keys.select(word.alias("word"), F.expr(f"shiftleft(1L, cast((pattern & {(1 << bits) - 1}) % 63 as int))").alias("bit"))
    got = got.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    flags = np.zeros((1 << bits) // 63 * 63 + 63, bool)
    held = (got["bits"].to_numpy(np.int64)[:, None] >> np.arange(63)) & 1
    flags.reshape(-1, 63)[got["word"].to_numpy(np.int64)] = held.astype(bool)
    return np.packbits(flags[: 1 << bits], bitorder="little")


def ordinary_counts(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """``(pattern, ordinary)``: how many ordinary words, in all texts, are in the slot of each pattern of ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, bits))
    mask = np.uint64((1 << bits) - 1)

    def f(part: pa.RecordBatch) -> dict:
        p = page(part.column("text"))
        places = np.flatnonzero(~p.taken)
        flags, hits = shared.value, []
        for k in range(0, len(places), 1 << 16):
            own = places[k : k + (1 << 16)]
            keys, there = around_words(p, own)
            keys = keys[there]
            at = keys & mask
            hits.append(keys[(flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *hits]), return_counts=True)
        return {"pattern": key.view(np.int64), "n": n.astype(np.int64)}

    counts = map_slices(docs, ["text"], f, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("ordinary"))
    return counts.join(wanted.select("pattern"), "pattern", "left_semi")


def around_words(p: Page, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``around`` for ascending whole words: every word of the stretch is hashed once."""
    if not len(words):
        return np.zeros((0, 3), np.uint64), np.zeros((0, 3), bool)
    a, b = max(int(words[0]) - 2, 0), min(int(words[-1]) + 2, len(p.start))
    lo = int(p.start[a])
    h = xxh64(LOWER[p.raw[lo : int(p.stop[b - 1])]], p.start[a:b] - lo, p.stop[a:b] - p.start[a:b], 3)

    def word(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.clip(k, a, b - 1)
        return h[near - a], (k >= a) & (k < b) & (p.row[near] == p.row[words]) & ~p.taken[near]

    (one, ok1), (two, ok2), (after, ok3) = word(words - 1), word(words - 2), word(words + 1)
    return np.stack([mixed(1, one), mixed(2, one, two), mixed(3, one, after)], axis=1), np.stack([ok1, ok1 & ok2, ok1 & ok3], axis=1)


def bootstrapped(edges: DataFrame, totals: DataFrame, support: int, confidence: float, evidence: float, rounds: int) -> DataFrame:
    """``(instance)`` that became known.

    ``edges``: pattern, instance, occurrences and whether the instance is a seed; ``totals``: pattern and all of its extractions.
    """
    n_edges = edges.count()
    need = int(-np.log1p(-evidence) * 1e6)
    known = edges.where("seed").select("instance").limit(0)
    share = F.col("hits") / (F.col("total") + 1)
    live = cut(edges.withColumn("known", F.col("seed")))
    for _ in range(rounds):
        hits = live.groupBy("pattern").agg(F.sum(F.when(F.col("known"), F.col("occurrences")).otherwise(0)).alias("hits"), F.count_if("known").alias("kinds"), F.count("*").alias("n"))
        good = hits.where(F.col("kinds") >= support).join(totals, "pattern").where(share >= confidence)
        good = good.select("pattern", "n", F.floor(-F.log1p(-share) * 1e6).alias("weight"))
        told = joined_by_count(live.where("not known").select("pattern", "instance"), good, "pattern", "n", n_edges)
        new = cut(told.groupBy("instance").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= need).select("instance"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        many = new.join(live.groupBy("instance").agg(F.count("*").alias("n")), "instance")
        told = joined_by_count(live, many, "instance", "n", n_edges).drop("n").withColumn("known", F.lit(True))
        live = cut(live.join(new, "instance", "left_anti").unionByName(told))
    return known


def personal_spans(docs: DataFrame, support: int = 3, confidence: float = 0.6, evidence: float = 0.75, rounds: int = 4, filter_bits: int = 23) -> DataFrame:
    """``(doc_id, base, spans)`` for each row of ``docs``: base spans, and these with those that the method adds.

    Both are arrays of ``(start, kind, end)`` in code points by start, kinds by their place in ``KINDS``.
    """
    first = cut(map_slices(docs.withColumn("_row", F.monotonically_increasing_id()), ["doc_id", "text", "_row"], found, SCHEMA))
    mentions = first.select("_row", F.explode("mentions").alias("m")).select("_row", "m.*")
    each = mentions.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "instance").agg(F.count("*").alias("occurrences"), F.max("seed").alias("seed")))
    # a pattern in which too few different strings are, of any kind, can never count
    able = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("occurrences").alias("own")).where(F.col("n") >= support)
    able = cut(able)
    edges = cut(joined_by_count(edges, able.select("pattern", "n"), "pattern", "n", edges.count()).drop("n"))
    totals = able.join(ordinary_counts(docs, able, filter_bits), "pattern", "left")
    totals = cut(totals.select("pattern", (F.col("own") + F.coalesce("ordinary", F.lit(0))).alias("total")))
    known = cut(bootstrapped(edges, totals, support, confidence, evidence, rounds))
    unseen = mentions.where("not seed").select("_row", "start", "end", "instance")
    often = known.join(unseen.groupBy("instance").agg(F.count("*").alias("n")), "instance")
    new = joined_by_count(unseen, often, "instance", "n", unseen.count())
    new = new.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return first.drop("mentions").join(new, "_row", "left").select("doc_id", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """The spans as text: kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]  # noqa: B023
    return spans.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES["op11_personal_data"] = op11_personal_data
