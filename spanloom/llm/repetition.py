"""Quality rules: suffix-array repetition within a text.

Every word of a slice of texts is a symbol that belongs to its text, so that equal
words of two texts differ. Prefix doubling sorts all suffixes of the slice at once:
each round sorts only the suffixes whose group still ties. The longest common prefix
of neighbours in the suffix array comes from the ranks kept for each doubling, and
the larger of the two neighbours' values at a suffix is the length of the longest
repeated substring that starts there, which is where the LCP intervals peak. The
union of these spans is the repeated part of a text.

The intervals themselves are not listed: the peak at a suffix is that of its interval, so
the spans and the longest repeat are the same.

Defined results: null and empty texts have no words (``n_words`` 0, rejected by the base
rule); texts of any length are taken whole, alone in their slice where they are longer than
one; repeated rows give repeated results; a covered share or a repeat equal to its limit is
kept; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import byte_class, code_points, codes, counts, keep_rows, map_slices, split_words, table
from spanloom.llm.registry import QUERIES

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def suffix_array(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``symbols`` and the LCP of each suffix with the one before it.

    ``owner`` is non-decreasing; a suffix ends where its owner ends, and only suffixes
    of one owner compare equal.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(owner, owner, "right")
    key = owner * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order, n)
    levels, h = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        ahead = np.where(tied + h < end[tied], rank[np.minimum(tied + h, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        key, who = key[by], tied[by]
        head = np.r_[True, key[1:] != key[:-1]]
        group = rank[who]
        # place in the group: groups are contiguous in ``who`` and start at rank ``group``
        first = np.r_[True, group[1:] != group[:-1]]
        at = np.arange(len(who))
        start = np.maximum.accumulate(np.where(first, at, 0))
        own = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[who] = group + own - start
        levels.append(rank.astype(np.int32))
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1].copy(), array[1:].copy()
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = 1 << level
        got += same * step
        a += same * step
        b += same * step
    lcp[live + 1] = got
    return array, lcp


def _ranks(sorted_key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, sorted_key[1:] != sorted_key[:-1]], at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    return rank


def longest_repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs again in its text."""
    array, lcp = suffix_array(symbols, owner)
    out = np.zeros(len(symbols), np.int64)
    if len(symbols):
        out[array] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions inside the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts of every text; see the contract of ``quality_rules``."""
    n = len(texts)
    rows, words = split_words(texts)
    code, _ = codes(words)
    longest = longest_repeats(code, rows)
    three = np.flatnonzero(longest >= 3)
    long = np.flatnonzero(longest >= min_repeat)
    in_three = covered(three, np.full(len(three), 3), len(rows))
    in_long = covered(long, longest[long], len(rows))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, rows, longest)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_rows, line = pc.list_parent_indices(lists := lines), lists.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    line_rows = pc.filter(line_rows, full).to_numpy().astype(np.int64)
    line_code, kinds = codes(pc.filter(line, full))
    different = np.unique(line_rows * max(len(kinds), 1) + line_code) // max(len(kinds), 1)
    return {
        "n_words": counts(rows, n),
        "word_chars": code_points(texts) - byte_class(texts, SPACE),
        "n_symbols": byte_class(texts, SYMBOLS),
        "n_dup_lines": counts(line_rows, n) - counts(different, n),
        "n_repeat_words": counts(rows[in_three], n),
        "covered_words": counts(rows[in_long], n),
        "longest_repeat": top,
    }


def quality_rules(
    docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 200, min_words: int = 50
) -> DataFrame:
    """One row per text: base counts, the repetition measures and the verdict.

    ``kept`` is false where the base rule fails (fewer than ``min_words`` words, or over
    half of the words inside three-word windows that occur again), where repeats of at
    least ``min_repeat`` words cover more than ``max_covered`` of the words, or where one
    repeat is longer than ``max_longest`` words.
    """

    limits = (min_repeat, max_covered, max_longest, min_words)

    def f(part: pa.RecordBatch) -> dict:
        m = judged(part.column("text"), *limits)
        return {"doc_id": part.column("doc_id")} | {k: m[k] for k in (c.split()[0] for c in SCHEMA.split(", ")[1:])}

    return map_slices(docs, ["doc_id", "text"], f, SCHEMA)


def judged(texts: pa.Array, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 200, min_words: int = 50) -> dict[str, np.ndarray]:
    """Measures of every text with ``base_failed`` and ``kept``."""
    m = measure(texts, min_repeat)
    n = m["n_words"]
    m["base_failed"] = (n < min_words) | (100 * m["n_repeat_words"] > 50 * n)
    m["kept"] = ~m["base_failed"] & (m["covered_words"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
    return m


def keep_good(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all of their columns.

    The 50 words that op5's contract asks for bind that query. Short texts are no worse than
    others, so that a filter only drops those without ``min_words`` words.
    """
    return keep_rows(docs, lambda texts: judged(texts, min_words=min_words)["kept"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES["op5_quality_rules"] = op5_quality_rules
