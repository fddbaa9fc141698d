"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces with the word behind it: no piece reaches
across, and equal units have equal pieces) are joined into one text, and a suffix array over their first characters is
built. Every piece of the vocabulary is searched in it by bisection; the range that it
finds are the piece's occurrences, so all ranges together are the edges of a lattice over
the text. Edges are sorted by the position where they end and relaxed in that order.

For a byte-pair vocabulary the best path is the one that merging gives. A sequence of
pieces is that path exactly if every two neighbours stand as they are when merged on their
own, and each position has one last piece: so an edge relaxes its end if it is compatible
with the last piece at its start. Characters that no piece covers fall back to bytes.

Defined results: null and empty texts have no pieces; texts, words and runs of any length
are encoded whole; of two equally good merges the left one is first; repeated rows give repeated results;
an empty table gives no rows; further columns of the input are not read. Texts that hold
U+2581 decode with a space in its place, as the format itself has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import map_slices, table
from spanloom.llm.registry import QUERIES

SPACE = "▁"
#: bytes of text that one suffix array indexes; a longer text is a batch of its own
BATCH = 3 << 20
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_crc32 long, round_trip boolean"


#: with so few units left, a loop over their edges is faster than steps of all side by side
FEW = 8


class Vocabulary:
    """Pieces of a byte-pair model with identity normalisation, a leading space and byte fallback."""

    def __init__(self, path: str, most: int = 4_000_000) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(k) for k in range(n)]
        normal = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.id = {self.piece[k]: k for k in normal}
        self.score = np.array([model.get_score(k) for k in range(n)])
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(map(len, self.id))
        self.width = self.longest + 1  # of keys: one behind the longest piece, for bounds above it
        self.output = [x.replace(SPACE, " ").encode() for x in self.piece]
        for b, k in enumerate(self.byte):
            self.output[k] = bytes([b])
        self._merges()
        # pieces as rows of code points plus one, zero behind their ends, like the suffixes
        self.normal = np.array(sorted(normal, key=lambda k: self.piece[k]))
        self.letters = np.zeros((len(normal), self.width), np.uint32)
        for row, k in zip(self.letters, self.normal.tolist()):
            row[: len(self.piece[k])] = np.frombuffer(self.piece[k].encode("utf-32-le", "surrogatepass"), "<u4") + 1
        self.size = np.array([len(x) for x in self.piece])
        self.sizes = self.size.tolist()
        self.single: dict[tuple[int, int], bool] = {}
        self.most = most
        self.checked = np.zeros(0, np.int64)  # pairs whose verdict is known
        self.verdict = np.zeros(0, bool)

    def _merges(self) -> None:
        """Pairs that join to a piece, and the last merge that makes each piece."""
        pairs = {}
        for text, k in self.id.items():
            for cut in range(1, len(text)):
                a, b = self.id.get(text[:cut]), self.id.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = k
        self.pairs = pairs
        order = sorted(set(self.score.tolist()), reverse=True)
        rank = {s: k for k, s in enumerate(order)}
        self.rank = np.array([rank[s] for s in self.score.tolist()])  # lower merges first

    def merge(self, text: str) -> list[int]:
        """Merge by hand: the best pair first, the leftmost of equals; -1 for an uncovered character."""
        now = [self.id.get(c, -1) for c in text]
        while True:
            best = None
            for k in range(len(now) - 1):
                got = self.pairs.get((now[k], now[k + 1]))
                if got is not None and (best is None or self.rank[got] < self.rank[best[1]]):
                    best = k, got
            if best is None:
                return now
            now[best[0] : best[0] + 2] = [best[1]]

    def compatible_pair(self, left: int, right: int) -> bool:
        """``compatible`` for one pair; verdicts are kept."""
        got = self.single.get((left, right))
        if got is None:
            if len(self.single) > self.most:  # known verdicts only save time
                self.single.clear()
            got = self.single[left, right] = self.merge(self.piece[left] + self.piece[right]) == [left, right]
        return got

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the two pieces stand as they are when their joined text is merged."""
        key = right * len(self.piece) + left  # edges come by their own piece, so that neighbours are looked up in turn
        at = np.searchsorted(self.checked, key)
        known = np.zeros(len(key), bool)
        if len(self.checked):
            known = self.checked[np.minimum(at, len(self.checked) - 1)] == key
        if not known.all():
            new = np.sort(key[~known])
            new = new[np.r_[True, new[1:] != new[:-1]]]
            ends = zip((new % len(self.piece)).tolist(), (new // len(self.piece)).tolist())
            got = np.array([self.merge(self.piece[a] + self.piece[b]) == [a, b] for a, b in ends], bool)
            if len(self.checked) > self.most:  # known verdicts only save time
                self.checked, self.verdict = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.compatible(left, right)
            to = np.searchsorted(self.checked, new)
            self.checked, self.verdict = np.insert(self.checked, to, new), np.insert(self.verdict, to, got)
            at = np.searchsorted(self.checked, key)
        return self.verdict[at]


def narrow_argsort(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers; small ones are sorted by digits, in linear time."""
    small = len(key) and int(key.max()) < 1 << 16
    return np.argsort(key.astype(np.uint16) if small else key, kind="stable")


class Lattice:
    """The distinct units of a batch as one text, its suffix array, and the edges found in it."""

    def __init__(self, units: list[str], vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        self.length = np.fromiter(map(len, units), np.int64, len(units))
        self.base = np.cumsum(self.length) - self.length
        self.text = text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(text)
        self.offset = np.arange(n) - np.repeat(self.base, self.length)  # of each character in its unit
        left = np.repeat(self.length, self.length) - self.offset
        # only as many characters of a suffix matter as the longest piece has
        array, lanes, place, bits = sorted_suffixes(text + 1, left, v.width)
        low, high = ranges(lanes, v.letters, place, bits)
        found = high - low
        piece = np.repeat(v.normal, found)
        start = array[np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
        depth = self.offset[start] + v.size[piece]
        by = narrow_argsort(depth * v.width - v.size[piece])
        self.piece, self.start, self.depth = piece[by], start[by], depth[by] - 1

    def relax(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and where each unit's end; bytes stand for uncovered characters."""
        v, n, offset = self.vocabulary, len(self.text), self.offset
        covered = np.zeros(n, bool)
        covered[self.start[v.size[self.piece] == 1]] = True
        last = np.full(n, -2)  # piece that ends behind each character: -2 none yet, -1 an uncovered one
        into = self.start + v.size[self.piece] - 1
        edge_cuts = np.searchsorted(self.depth, np.arange(int(self.length.max(initial=0)) + 1))
        by_offset = narrow_argsort(offset)
        cuts = np.searchsorted(offset[by_offset], np.arange(len(edge_cuts)))
        for d in range(len(edge_cuts) - 1):  # all units side by side, one position after the other
            here = by_offset[cuts[d] : cuts[d + 1]]
            if len(here) <= FEW:
                self._relax_each(last, covered, into, d, edge_cuts[d])
                break
            last[here[~covered[here]]] = -1
            own = slice(edge_cuts[d], edge_cuts[d + 1])
            piece, start, to = self.piece[own], self.start[own], into[own]
            before = np.where(offset[start] == 0, -1, last[np.maximum(start - 1, 0)])
            fine = before == -1
            ask = np.flatnonzero(before >= 0)
            fine[ask] = v.compatible(before[ask], piece[ask])
            last[to[fine]] = piece[fine]
        return self._walk(last)

    def _relax_each(self, last: np.ndarray, covered: np.ndarray, into: np.ndarray, depth: int, edge: int) -> None:
        """``relax`` from position ``depth`` on, where few units are that long: one after the other, an edge at a time."""
        v = self.vocabulary
        unit = np.searchsorted(self.base, self.start[edge:], "right") - 1
        order = edge + np.argsort(unit, kind="stable")
        stops = np.cumsum(np.bincount(unit, minlength=len(self.base)))
        for u in np.flatnonzero(self.length > depth).tolist():
            base, end = int(self.base[u]), int(self.base[u] + self.length[u])
            tail = last[base + depth : end]
            tail[~covered[base + depth : end]] = -1
            now = [-1, *last[base:end].tolist()]  # what ends before each character of the unit
            own = order[(stops[u - 1] if u else 0) : stops[u]]
            for piece, start, to in zip(self.piece[own].tolist(), (self.start[own] - base).tolist(), (into[own] - base).tolist()):
                before = now[start]
                if before == -1 or before >= 0 and v.compatible_pair(before, piece):
                    now[to + 1] = piece
            last[base:end] = now[1:]

    def _walk(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From every unit's end back to its start, all units side by side."""
        v = self.vocabulary
        unit = np.flatnonzero(self.length > 0)
        at = self.base[unit] + self.length[unit] - 1
        owner, place, found = [], [], []
        while len(unit):
            if len(unit) <= FEW:
                for u, k in zip(unit.tolist(), at.tolist()):
                    base, back = int(self.base[u]), []
                    pieces = last[base : k + 1].tolist()
                    k -= base
                    while k >= 0:
                        back.append(k)
                        k -= int(v.sizes[pieces[k]]) if pieces[k] >= 0 else 1
                    owner.append(np.full(len(back), u))
                    place.append(base + np.array(back))
                    found.append(last[place[-1]])
                break
            p = last[at]
            owner.append(unit)
            place.append(at)
            found.append(p)
            at = at - np.where(p >= 0, v.size[p], 1)
            on = at >= self.base[unit]
            unit, at = unit[on], at[on]
        if not owner:
            return np.zeros(0, "<u4"), np.zeros(len(self.length), np.int64)
        place, found, owner = np.concatenate(place), np.concatenate(found), np.concatenate(owner)
        by = np.argsort(place, kind="stable")
        place, ids, owner = place[by], found[by], owner[by]
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # characters that no piece covers, as bytes
            raw = [chr(c).encode() for c in self.text[place[bare]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = list(map(len, raw))
            hidden = np.repeat(ids < 0, times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[hidden] = v.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(self.length)))


def lane(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of numbers below ``2 ** bits`` as one number each, in the rows' order."""
    out = np.zeros(len(codes), np.int64)
    for k in range(codes.shape[1]):
        out <<= bits
        out |= codes[:, k]
    return out


def ahead(x: np.ndarray, k: int, left: np.ndarray) -> np.ndarray:
    """What stands ``k`` places on in the same unit, or zero; ``left`` characters of the unit are left at each place."""
    out = np.zeros_like(x)
    out[: max(len(x) - k, 0)] = x[k:]
    out[left <= k] = 0
    return out


def suffix_lanes(codes: np.ndarray, left: np.ndarray, width: int, bits: int) -> list[np.ndarray]:
    """The first ``width - 1`` characters of each suffix, and a zero, as lanes of as many as fit one number; lengths double."""
    each = 63 // bits
    powers = [codes]  # the first 1, 2, 4, ... characters
    while 2 << len(powers) - 1 <= min(each, width - 1):
        half = 1 << len(powers) - 1
        powers.append(powers[-1] << half * bits | ahead(powers[-1], half, left))
    out = []
    for k in range(0, width, each):
        stop = min(k + each, width)
        part, m = np.zeros_like(codes), k
        for j in reversed(range(len(powers))):
            if min(stop, width - 1) - k >> j & 1:
                part = part << (bits << j) | (ahead(powers[j], m, left) if m else powers[j])
                m += 1 << j
        out.append(part << (stop - m) * bits)
    return out


def sorted_suffixes(text: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
    """Suffix array of the units in ``text`` (code points plus one; ``left`` characters of the unit from each place on), by
    prefix doubling; the suffixes in that order as lanes; and the rank of each code point in the batch's alphabet, with its bits."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)], np.zeros(1, np.int64), 1
    # as many characters, by their rank in the batch's alphabet, as fit one number; from there on lengths double
    seen = np.zeros(int(text.max()) + 1, bool)
    seen[text] = True
    place, bits = np.cumsum(seen) * seen, int(seen.sum()).bit_length()
    step = min(width, 63 // bits)
    lanes = suffix_lanes(place[text], left, width, bits)
    order = np.argsort(lanes[0])
    sorted_ = lanes[0][order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
    while step < width - 1:
        # of equal rank, and not at their ends: those that have ended are equal for good
        open_ = (np.bincount(rank)[rank] > 1) & (left >= step)
        tied = np.flatnonzero(open_)
        if not len(tied):
            break
        key = rank[tied] * (n + 2) + np.where(left[tied] > step, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, who = key[by], tied[by]
        slots = np.flatnonzero(open_[order])
        order[slots] = who
        step *= 2
        if step < width - 1:
            fresh = np.r_[True, rank[order][1:] != rank[order][:-1]]
            fresh[slots[1:]] |= key[1:] != key[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
    return order, [x[order] for x in lanes], place, bits


def ranges(lanes: list[np.ndarray], letters: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes that begin with each piece start and end in the suffix array.

    A piece's range is found by bisection in the first lane, and inside it in the next ones.
    """
    codes = place[np.minimum(letters, len(place) - 1)] * (letters < len(place))
    absent = ((letters > 0) & (codes == 0)).any(1)
    above = np.where(letters > 0, codes, (1 << bits) - 1)  # at the end of a piece, any character
    each = 63 // bits
    low = np.searchsorted(lanes[0], lane(codes[:, :each], bits), "left")
    high = np.searchsorted(lanes[0], lane(above[:, :each], bits), "right")
    high[absent] = low[absent]
    size = (letters > 0).sum(1)
    for k, held in enumerate(lanes[1:], 1):
        who = np.flatnonzero((size > k * each) & (low < high))
        part = slice(k * each, (k + 1) * each)
        start = within(held, lane(codes[who, part], bits), low[who], high[who])
        high[who] = within(held, lane(above[who, part], bits) + 1, low[who], high[who])
        low[who] = start
    return low, high


def within(held: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place from ``low`` on, before ``high``, at which ``held`` is not below each wanted number."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        below = held[mid] < wanted[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


class Codec:
    """Encodes batches of texts, each through the lattice of its own distinct units; pairs' verdicts are kept."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)

    def units(self, text: str) -> list[str]:
        """The text with its leading space, cut before each run of spaces; without the last space of a run."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, gap = [], 0
        for part in parts:
            if part:
                out.append(SPACE * gap + part)
                gap = 0
            else:
                gap += 1
        return [*out, SPACE * (gap - 1)] if gap else out

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [self.units(t) if t else [] for t in texts]
        number = dict.fromkeys(chain.from_iterable(cut))
        ids, ends = Lattice([SPACE + u.replace(" ", SPACE) for u in number], self.vocabulary).relax()
        number = dict(zip(number, range(len(number))))
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        size = np.diff(ends, prepend=0)[which]
        stops = np.cumsum(size)
        raw = ids[np.arange(size.sum()) + np.repeat(ends[which] - stops, size)].tobytes()
        own = (4 * np.r_[0, stops][np.cumsum([0, *map(len, cut)])]).tolist()
        for start, stop in zip(own, own[1:]):
            yield raw[start:stop]

    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the leading space; bytes that are no UTF-8 become U+FFFD."""
        output = self.vocabulary.output
        text = b"".join(map(output.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` for every whole text."""

    def f(part: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec(path)(part.column("text").to_pylist())]
        return {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return map_slices(docs, ["doc_id", "text"], f, "doc_id long, ids array<int>", limit=BATCH)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path)
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Number and CRC-32 of a text's ids, its byte pieces, and what decoding them gives."""

    def f(part: pa.RecordBatch) -> dict:
        own = codec(path)
        texts = part.column("text").to_pylist()
        ids = list(own(texts))
        back = [own.decode(x) for x in ids]
        is_byte = np.zeros(len(own.vocabulary.piece), bool)
        is_byte[own.vocabulary.byte] = True
        return {
            "doc_id": part.column("doc_id"),
            "n_pieces": [len(x) // 4 for x in ids],
            "ids_crc32": [zlib.crc32(x) for x in ids],
            "n_bytes": [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids],
            "decoded_crc32": [zlib.crc32(x.encode()) for x in back],
            "round_trip": [b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts)],
        }

    return map_slices(docs, ["doc_id", "text"], f, SCHEMA, limit=BATCH)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES["op2_sentencepiece"] = op2_sentencepiece
