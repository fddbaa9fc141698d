"""License scans against a whole longest-common-subsequence table, and slices without a hit."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)
SIZE = {name: len(words) for name, words in zip(INDEX.names, INDEX.words)}


def words_of(text):
    return [w for w in licenses.plain_words(pa.array(text.split(), pa.string())).to_pylist() if w]


def common(a, b):
    """Length of the longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(now[j], row[j + 1]))
        row = now
    return row[-1]


def longest_run(template, text):
    """Longest run of template words that the text has in a row."""
    best, row = 0, [0] * (len(text) + 1)
    for x in template:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(text))]
        best = max(best, *row)
    return best


def brute(text):
    """``{template: (matched words, longest run)}`` of a text that holds at most one copy of a template."""
    out = {}
    own = words_of(text)
    for name, body in licenses.TEMPLATES.items():
        template = words_of(body)
        n = common(template, own)
        if n >= 0.8 * len(template):
            out[name] = n, longest_run(template, own)
    return out


def edited(body, rng, split):
    words = body.split()
    for _ in range(rng.randint(0, len(words) // 8)):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"qq{rng.randrange(99)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"qq{rng.randrange(99)}")
    if split:  # one long insertion, up to three quarters of the template
        at = rng.randrange(1, len(words))
        words[at:at] = [f"zz{rng.randrange(99)}" for _ in range(rng.randint(1, 1 + len(words) * 3 // 4))]
    return " ".join(words)


@pytest.mark.parametrize("split", [False, True])
def test_scan_equals_whole_table(split):
    rng = random.Random(3)
    texts = []
    for _ in range(5):
        for body in licenses.TEMPLATES.values():
            before, after = (" ".join(f"xx{rng.randrange(99)}" for _ in range(rng.randint(0, 30))) for _ in range(2))
            texts.append(f"{before} {edited(body, rng, split)} {after}")
    found = {}
    for row, t, first, last, n in licenses.matches(pa.array(texts), INDEX, 0.8):
        assert first <= last and (row, INDEX.names[t]) not in found
        found[row, INDEX.names[t]] = n
    every = {(row, name): n for row, text in enumerate(texts) for name, n in brute(text).items()}
    assert found.keys() <= every.keys()
    # other templates' words scattered over a long notice are no copy: compare the planted ones
    planted = lambda key: key[1] == INDEX.names[key[0] % len(INDEX.names)]
    found = {key: n for key, n in found.items() if planted(key)}
    want = {key: n for key, (n, run) in every.items() if planted(key) and (run >= INDEX.width + 1 or key in found)}
    assert len(want) > 25
    if not split:
        assert found == want
    for key in found.keys() | want.keys():  # fewer than four words in a row, cut off by the insertion, have no fingerprint
        size = SIZE[key[1]]
        assert 0 <= want[key] - found.get(key, -(-8 * size // 10)) <= 3


def test_known_words_without_a_hit():
    assert licenses.matches(pa.array(["the software the software the"]), INDEX, 0.8) == []
    texts = pa.array(["the software the software the", "", None, "of the of the of the software"])
    assert licenses.matches(texts, INDEX, 0.8) == []
    for k in range(len(texts)):
        assert licenses.matches(texts.slice(k, 1), INDEX, 0.8) == []


@pytest.mark.parametrize("foreign", [25, 60, 86])
def test_foreign_words_in_the_middle(foreign):
    words = licenses.TEMPLATES["mit"].split()
    text = " ".join(["xx"] * 9 + words[:43] + ["foreign"] * foreign + words[43:])
    assert licenses.matches(pa.array([text]), INDEX, 0.8) == [(0, INDEX.names.index("mit"), 9, 8 + len(words) + foreign, len(words))]


def test_repeats_and_long_texts(spark):
    body = licenses.TEMPLATES["isc"]
    filler = "plain " * 200_000
    rows = [(1, f"{filler}{body} {filler}", "a"), (2, body, "b"), (2, body, "b"), (None, body, "c"), (3, "w" * 1_000_000, "d")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, template string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "None"]
    assert {r["template"] for r in got} == {"isc"} and {r["coverage"] for r in got} == {1.0}
    first = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][first["start"] : first["end"]] == body[: body.rindex(".") + 1]


def test_alignment_breaks_ties_tightly():
    template, text = np.array([1, 2]), np.array([1, 1, 2, 2])
    assert licenses.align(template, text, -2, 4) == (2, 1, 2)
    assert licenses.align(template, np.array([3, 3]), -2, 2) == (0, -1, -1)
