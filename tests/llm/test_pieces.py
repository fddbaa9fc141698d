"""Whole batches of hard texts against the library; very long words; index ranges against plain search."""

import gc
import random
import time

import numpy as np
import pytest

from spanloom.llm import pieces

PATH = pieces.default_vocabulary()
LIBRARY = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
OWN = pieces.Codec(PATH)


def equal(texts):
    for text, ids in zip(texts, OWN(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (LIBRARY.encode(text) if text else []), (text or "")[:80]


def test_random_texts_equal_library():
    rng = random.Random(2)
    signs = ["a", "b", "e", "t", "h", " ", " ", "  ", "\n", "1", "é", "日", "😀", "́", ".", "<s>", "ing", "tion", "▁x"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    equal([t.replace("▁", " ") for t in texts])


def test_long_words_and_lines_equal_library():
    rng = random.Random(3)
    equal(["x" * 3000, "ab" * 2500, "=" * 4000, "é" * 1000, "".join(rng.choice("abcdehinorst") for _ in range(20_000)), "word " * 20_000, " " * 3000, "\n" * 3000])


def test_batches_do_not_matter():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "quick", "über", "brown,", "x9", ""]) for _ in range(40)) for _ in range(60)] + [None, ""] * 3
    together = list(OWN(texts))
    assert together == [x for t in texts for x in OWN([t])] and list(OWN([])) == []


def test_ranges_hold_every_occurrence():
    v = OWN.vocabulary
    units = [pieces.SPACE + u for u in ("banana", "bandana", "thinking", "the", "é日x", "aaaa")]
    lattice = pieces.Lattice(units, v)
    text = "".join(units)
    got = {(int(s), int(p)) for s, p in zip(lattice.start, lattice.piece)}
    want, base = set(), 0
    for u in units:
        for s in range(len(u)):
            want |= {(base + s, v.id[u[s:e]]) for e in range(s + 1, len(u) + 1) if u[s:e] in v.id}
        base += len(u)
    assert got == want and len(text) == base


def test_one_run_of_five_million_letters():
    """A run without a space takes time in proportion to its length, and equals the library's pieces."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(5_000_000))
    equal([text[:60_000] + " and " + text[60_000:61_000], text[:3000]])
    began = time.perf_counter()
    (ids,) = OWN([text])
    assert time.perf_counter() - began < 120
    assert OWN.decode(ids) == text


def test_suffixes_in_order():
    """Suffixes come in the order of their first characters, in lanes and in the array, whatever the size of the alphabet."""
    rng = random.Random(8)
    for signs in ("ab", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x3041, 0x3041 + 700)))):
        units = ["".join(rng.choice(signs[: rng.choice([2, 700])]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
        text = np.array([ord(c) + 1 for u in units for c in u], np.uint32)
        left = np.array([k for u in units for k in range(len(u), 0, -1)])
        heads = [u[k : k + 16] for u in units for k in range(len(u))]
        order, lanes, place, bits = pieces.sorted_suffixes(text, left, 17)
        assert sorted(order.tolist()) == list(range(len(text)))
        assert [heads[k] for k in order.tolist()] == sorted(heads)
        rows = list(zip(*(x.tolist() for x in lanes)))
        assert rows == sorted(rows) and len(set(rows)) == len(set(heads))


def test_ended_suffixes_are_not_sorted_again(monkeypatch):
    """Suffixes that are equal to their ends stay tied: only those that go on are sorted by what follows."""
    rng = random.Random(9)
    units = list({pieces.SPACE + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + rng.choice(["ing", "tion"]) for _ in range(5000)})
    sizes, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(0 if k else len(x)) or real(x, *a, **k))
    pieces.Lattice(units, OWN.vocabulary)
    assert sizes[0] > 40_000 and sum(sizes[1:]) < 0.3 * sizes[0]


def test_rows_without_text():
    assert list(OWN([None, "", None])) == [b""] * 3
    assert list(OWN([None, "a", ""])) == [b"", np.array(LIBRARY.encode("a"), "<u4").tobytes(), b""]


def test_arrays_go_with_their_batch():
    """Nothing of a batch waits for the collector of cycles, which arrays' sizes do not start."""
    gc.collect()
    gc.disable()
    try:
        list(OWN(["one batch of words"]))
        assert gc.collect() == 0
    finally:
        gc.enable()
