"""Subword tokens with code-point offsets, and the overlapping windows a token classifier reads.

A vocabulary file is read where the driver runs and broadcast (a few megabytes, whatever the corpus
holds), so executors need no file. Texts are coded in Arrow batches. Documents are independent: windows
need no shuffle, and labelled ones one exchange of texts and spans by document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.spans import overlapped, tags

#: characters that are coded at once
STRETCH = 100_000
#: tag number of tokens that no loss counts
IGNORED = -100
BREAK = re.compile(r"(?<=\S)(?= )")
#: places where the byte-level pattern begins a piece: those of ``BREAK``, and signs behind a letter
PIECE = re.compile(r"(?<=\S)(?= )|(?<=[A-Za-z])(?=[.,!?;:])")


@lru_cache(maxsize=4)
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(definition)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    found.no_truncation()
    found.no_padding()
    return found


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """``(start, part)``: the text in parts of about ``size`` characters, cut before a space that follows another character.

    No token of a vocabulary whose pre-tokeniser begins a piece at such a place reaches across the cut, so the
    parts' tokens are those of the whole text. A run without such a place stays in one part.
    """
    at = 0
    while at < len(text):
        found = BREAK.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield at, text[at:end]
        at = end


def trimmed(text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts moved behind the white space that their tokens begin with; tokens of white space alone keep theirs."""
    held = np.r_[[not c.isspace() for c in text], True]
    place = np.where(held, np.arange(len(held)), len(held))
    behind = np.minimum.accumulate(place[::-1])[::-1][start]
    return np.where(behind < end, behind, start)


def _separable(tokenizer) -> bool:
    """Whether every cut of ``PIECE`` is one between pieces: the byte-level pattern, and nothing before or behind it."""
    from tokenizers.pre_tokenizers import ByteLevel

    pattern = tokenizer.pre_tokenizer
    plain = isinstance(pattern, ByteLevel) and pattern.use_regex and not pattern.add_prefix_space
    return plain and tokenizer.normalizer is None and tokenizer.post_processor is None and all(t.special for t in tokenizer.get_added_tokens_decoder().values())


def _room(columns: np.ndarray, n: int) -> np.ndarray:
    """``columns`` with room for ``n`` entries each, at least doubled where it was short."""
    more = max(n, 2 * columns.shape[1]) - columns.shape[1]
    return columns if n <= columns.shape[1] else np.concatenate([columns, np.zeros((len(columns), more), columns.dtype)], 1)


class Coder:
    """Tokens of texts, from those of their parts between cuts of ``PIECE``, each coded when it first comes.

    Known parts are forgotten once they have ``most`` characters in all. A vocabulary with another pattern codes
    whole stretches.
    """

    def __init__(self, tokenizer, most: int = 3_000_000) -> None:
        self.tokenizer, self.most, self.separable = tokenizer, most, _separable(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = self.tokens = 0
        self.parts = np.zeros((3, 1024), np.int64)  # of each part: characters, tokens, place of the first token
        self.held = np.zeros((3, 4096), np.int64)  # of each token: id, start, end

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
        return np.array(got.ids, np.int64), trimmed(text, offsets[:, 0], offsets[:, 1]), offsets[:, 1]

    def _learn(self, new: list[str]) -> None:
        """Parts between spaces are coded in one text, which is cut where they meet; others one by one."""
        usual = [p for p in new if p[0] == " " and not p[-1].isspace()]
        for group in ([usual] if usual else []) + [[p] for p in new if p[0] != " " or p[-1].isspace()]:
            ids, start, end = self._encoded("".join(group))
            size = np.fromiter(map(len, group), np.int64, len(group))
            cuts = np.cumsum(size)
            own = np.searchsorted(cuts, end, "left")  # the part in which a token ends
            before = (cuts - size)[own]
            k, n = len(self.number), self.tokens + len(ids)
            self.parts = _room(self.parts, k + len(group))
            self.held = _room(self.held, n)
            count = np.bincount(own, minlength=len(group))
            self.parts[:, k : k + len(group)] = size, count, self.tokens + np.cumsum(count) - count
            self.held[:, self.tokens : n] = ids, start - before, end - before
            self.number.update(zip(group, range(k, k + len(group))))
            self.tokens, self.chars = n, self.chars + int(cuts[-1])

    def _known(self, stretch: str) -> np.ndarray:
        """Characters, tokens and first token's place of each of the stretch's parts."""
        if self.chars > self.most:
            self.forget()
        parts = PIECE.split(stretch)
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        if new:
            self._learn(new)
        return self.parts[:, np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))]

    def coded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the text's tokens."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, stretch in stretches(text):
            if self.separable:
                size, count, first = self._known(stretch)
                place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                shift = np.repeat(np.cumsum(size) - size + at, count)
                ids, start, end = self.held[:, place]
                out.append((ids.astype(np.int32), start + shift, end + shift))
            else:
                ids, start, end = self._encoded(stretch)
                out.append((ids.astype(np.int32), start + at, end + at))
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, start, end = (np.concatenate(x) for x in zip(*out))
        return ids, start, end

    def count(self, text: str) -> int:
        if self.separable:
            return sum(int(self._known(s)[1].sum()) for _, s in stretches(text))
        return sum(len(self.tokenizer.encode(s, add_special_tokens=False).ids) for _, s in stretches(text))


@lru_cache(maxsize=4)
def _coder(definition: str) -> Coder:
    """One of a Python worker's, which keeps what it has learnt from one batch to the next."""
    return Coder(_tokenizer(definition))


@dataclass(frozen=True)
class Windows:
    """Length of a window with its two special tokens, tokens that neighbours share, and the ids of the special tokens."""

    length: int = 512
    stride: int = 128
    first: int = 0
    last: int = 0

    @property
    def content(self) -> int:
        if not 0 <= self.stride < self.length - 2:
            raise ValueError(f"stride must be between 0 and {self.length - 3}")
        return self.length - 2

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        """Token ranges of the windows of ``n`` tokens; one, without a token, where there is none."""
        step = self.content - self.stride
        for k in range(max(-(-(n - self.content) // step), 0) + 1):
            yield k * step, min(k * step + self.content, n)


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast[str]:
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


WINDOW_COLUMNS = "win int, token array<int>, start array<bigint>, end array<bigint>"


def subword_windows(docs: DataFrame, vocabulary: str, windows: Windows = Windows(), rows: int = 512) -> DataFrame:
    """``(doc_id, win, token, start, end)``: one row a window, its arrays framed by the special tokens, whose offsets are zero.

    Null texts have no window and empty ones a window of the special tokens alone. Texts of any length are
    coded whole, a stretch at a time; rows of one ``doc_id`` are windowed one by one.
    """
    return _windowed(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), vocabulary, windows, rows, None)


def labelled_windows(docs: DataFrame, spans: DataFrame, vocabulary: str, windows: Windows = Windows(), scheme: str = "bilou", rows: int = 512) -> DataFrame:
    """``subword_windows`` with ``tag``, numbers in ``spans.tags(scheme)``; windows without a labelled token go.

    A token has the first span, by start and end, that it overlaps. Special tokens have -100. ``spans`` is
    ``(doc_id, label, start, end)``; they meet their text once, as an array of the document's spans.
    """
    per = spans.where("start is not null and end is not null and label is not null").groupBy("doc_id")
    per = per.agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")).alias("spans"))
    both = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(per, "doc_id")  # documents without a span have no such window
    return _windowed(both, vocabulary, windows, rows, scheme)


def _windowed(docs: DataFrame, vocabulary: str, windows: Windows, rows: int, scheme: str | None) -> DataFrame:
    held = broadcast_vocabulary(docs.sparkSession, vocabulary)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, {WINDOW_COLUMNS}" + (", tag array<int>" if scheme else "")
    windows.content  # bad settings are an error here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value)
        for batch in batches:
            ids = batch.column(0)
            out: list[list] = []
            for k in range(batch.num_rows):
                token, start, end = coder.coded(batch.column(1)[k].as_py())
                tag = tagged(start, end, batch.column(2)[k].values, scheme) if scheme else None
                for win, (a, b) in enumerate(windows.cuts(len(token))):
                    if tag is not None and not tag[a:b].any():
                        continue
                    row = [k, win, np.r_[windows.first, token[a:b], windows.last], np.r_[0, start[a:b], 0], np.r_[0, end[a:b], 0]]
                    out.append(row if tag is None else [*row, np.r_[IGNORED, tag[a:b], IGNORED]])
                    if len(out) == rows:  # bounded memory, also within one long text
                        yield _batch(ids, out)
                        out = []
            if out:
                yield _batch(ids, out)

    return docs.mapInArrow(run, schema)


def _batch(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
    at, win, *arrays = zip(*rows)
    columns = [ids.take(pa.array(at, pa.int64())), pa.array(win, pa.int32())]
    for values, kind in zip(arrays, (pa.int32(), pa.int64(), pa.int64(), pa.int32())):
        cuts = np.r_[0, np.cumsum([len(x) for x in values])].astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(values).astype(kind.to_pandas_dtype()))))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "win", "token", "start", "end", "tag"][: len(columns)])


def tagged(start: np.ndarray, end: np.ndarray, spans: pa.StructArray, scheme: str) -> np.ndarray:
    """Tag numbers of one document's tokens, by a sweep over its spans; of equal spans the label that sorts first counts."""
    spans = spans.take(pc.sort_indices(pc.struct_field(spans, "label")))
    s, e = (pc.struct_field(spans, k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    order, low, high = overlapped(np.zeros(len(start), np.int64), start, end, np.zeros(len(s), np.int64), s, e)
    hit = np.flatnonzero((low < high) & (start < end))
    number = {x: k for k, x in enumerate(tags(scheme))}
    which = order[low[hit]]
    first = (start[hit] <= s[which]) & (s[which] < end[hit])
    last = (start[hit] < e[which]) & (e[which] <= end[hit])
    prefixes = ("B", "I", "L", "U")
    prefix = np.where(first, 0, 1) if scheme == "bio" else np.select([first & last, first, last], [3, 0, 2], 1)
    label = pc.struct_field(spans, "label").dictionary_encode()
    known = np.array([[number.get(f"{p}-{x}", 0) for x in label.dictionary.to_pylist()] for p in prefixes], np.int64)
    out = np.zeros(len(start), np.int64)
    if len(hit):
        out[hit] = known[prefix, label.indices.to_numpy(zero_copy_only=False)[which]]
    return out


def window_tokens(windows: DataFrame) -> DataFrame:
    """``(doc_id, win, pos, token, start, end)``: the rows of the windows' tokens, for averages, categories and decoding."""
    each = windows.select("doc_id", "win", F.posexplode(F.arrays_zip("token", "start", "end")).alias("pos", "t"))
    return each.select("doc_id", "win", "pos", "t.token", "t.start", "t.end")


def token_counter(spark: SparkSession, vocabulary: str) -> Callable[[Column], Column]:
    """A column function that counts a text's tokens, for the calibration of a ``corpus.Budget``; null stays null."""
    held = broadcast_vocabulary(spark, vocabulary)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        coder = _coder(held.value)
        return pa.array([None if t is None else coder.count(t) for t in texts.to_pylist()], pa.int64())

    return count
