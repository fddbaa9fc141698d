"""The classifier and the toxicity network against plain loops; the pipeline from end to end on odd tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from spanloom.llm import toxicity, weak

SPACES = " \t\n\v\f\r"


def split(text):
    return (text or "").encode().split()


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "AND", "über", "x1", "42", "$$$", "wow!!", "a", "b", "tion,", "“q”", "END.", "###"]
    out = [" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    return [x.replace(" a ", "\n") for x in out] + [None, "", " \t\n", "one", "w" * 200_000, "same line\nsame line\n same line"]


def plain_measures(text):
    w, raw = split(text), (text or "").encode()
    some = max(len(w), 1)
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b >= 128
    c, pairs = Counter(w), list(zip(w, w[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return [
        len(w),
        sum(raw.count(bytes([s])) for s in weak.SYMBOLS) / some,
        sum(x[-1] in weak.ENDS for x in w) / some,
        sum(65 <= b <= 90 for b in raw) / max(sum(map(letter, raw)), 1),
        raw.count(b"!") / some,
        max(c.values(), default=0) / some if len(w) >= 20 else 0,
        len(c) / some / min(1, (60 / some) ** 0.5) if len(w) >= 20 else 1,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(not any(map(letter, x)) for x in w) / some,
        sum(a == b for a, b in pairs) / some,
        (len(pairs) - len(set(pairs))) / max(len(pairs), 1),
    ]


def test_measures_equal_plain_ones():
    texts = texts_of(1)
    got = weak.measures(weak.Words(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_measures(t) for t in texts])


def plain_shape(word):
    out = []
    for b in word:
        s = "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "9" if 48 <= b <= 57 else b
        if not out or out[-1] != s:
            out.append(s)
    return bytes(x if isinstance(x, int) else ord(x) for x in out)


def test_linear_scores_equal_plain_ones():
    texts, rng = texts_of(2), np.random.default_rng(3)
    weights, bias = rng.standard_normal(weak.COLUMNS), 0.3
    mask = (1 << weak.BITS) - 1
    want = []
    for t in texts:
        w, z = split(t), 0.0
        for k, x in enumerate(w):
            z += weights[xxhash.xxh64_intdigest(bytes(b + 32 if 65 <= b <= 90 else b for b in x), 1) & mask]
            z += weights[(1 << weak.BITS) + (xxhash.xxh64_intdigest(plain_shape(x), 2) & mask)]
            z += weights[-1] if k and w[k - 1] == x else 0
        want.append(1 / (1 + np.exp(-(z / max(len(w), 1) + bias))))
    assert np.allclose(weak.linear(weak.Words(pa.array(texts, pa.string())), weights, bias), want)


def test_em_by_pattern_equals_em_by_row():
    """Counted patterns give what a loop over all rows gives."""
    rng = np.random.default_rng(5)
    n = len(weak.LABELLERS)
    votes = np.where(rng.random((400, n)) < 0.2, weak.BAD, weak.NONE)
    votes[:40] = weak.BAD
    rows = (votes * 3 ** np.arange(n)).sum(1)
    pattern, count = np.unique(rows, return_counts=True)
    folded = weak.estimate(pattern, count.astype(float), rounds=15)
    # one row at a time, from the documented start
    share = 0.85
    seed = np.array([[[0.6, 0.4, 0], [0.98, 0.02, 0]] if good is None else [[0.3, 0.4, 0.3], [0.23, 0.02, 0.75]] for _, _, good, _ in weak.LABELLERS])
    chance = seed.copy()
    for _ in range(15):
        total, good_sum = np.zeros_like(chance), 0.0
        for row in votes:
            like = [(1 - share), share]
            for k, v in enumerate(row):
                for c in (0, 1):
                    like[c] *= chance[k, c, v] + 1e-12
            good = like[1] / (like[0] + like[1])
            good_sum += good
            for k, v in enumerate(row):
                total[k, 0, v] += 1 - good
                total[k, 1, v] += good
        total += (1 + 0.002 * len(votes)) * seed
        new = total / total.sum(2, keepdims=True)
        for k in range(n):  # a labeller objects to 3 % of the good texts at most
            false = new[k, 1, weak.BAD]
            if false > 0.03:
                new[k, 1, [weak.NONE, weak.GOOD]] *= 0.97 / (1 - false)
                new[k, 1, weak.BAD] = 0.03
        share, done = (good_sum + 0.85) / (len(votes) + 1), np.abs(new - chance).max() < 1e-7
        chance = new
        if done:
            break
    assert abs(folded.share - share) < 1e-6 and np.allclose(folded.chance, chance, atol=1e-6)


def test_classifier_rows_and_ties(spark):
    rows = [(k, "plain words of a text " * 20, "x", k) for k in range(30)] + [(5, "plain words of a text " * 20, "x", 1), (None, None, None, None), (7, "w" * 500_000, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern string, score int")
    model = weak.fit(docs)
    again = weak.fit(docs.repartition(7))
    assert np.allclose(model.weights, again.weights) and model.bias == pytest.approx(again.bias)
    got = weak.quality_classifier(docs, model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)
    assert weak.keep_good(docs).columns == docs.columns


def plain_score(net, text, size, step):
    """Score of one text: every window by a loop over its words."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    h_ = toxicity.HIDDEN

    def vector(word):
        x = b"<" + bytes(b + 32 if 65 <= b <= 90 else b for b in word).strip(b"\"'`.,;:!?()[]{}<>#*$%&|~^=+-_/\\") + b">"
        grams = [x[k : k + 3] for k in range(max(len(x) - 2, 1))]
        ids = [xxhash.xxh64_intdigest(g, 13) & ((1 << toxicity.GRAM_BITS) - 1) for g in grams]
        return np.r_[p["words"][xxhash.xxh64_intdigest(x, 11) & ((1 << toxicity.WORD_BITS) - 1)], p["grams"][ids].mean(0)]

    def direction(xs, u, lo):
        h, out = np.zeros(h_), []
        for x in xs:
            g, a = (x @ p["wx"] + p["bx"])[lo : lo + 3 * h_], h @ u
            r, z = sig(g[:h_] + a[:h_]), sig(g[h_ : 2 * h_] + a[h_ : 2 * h_])
            h = z * h + (1 - z) * np.tanh(g[2 * h_ :] + r * a[2 * h_ :])
            out.append(h)
        return out

    words = split(text)
    starts = {min(k, max(len(words) - size, 0)) for k in range(0, max(len(words) - size, 0) + step, step)} or {0}
    best = -np.inf
    for s in starts:
        xs = [vector(w) for w in words[s : s + size]]
        logit = p["bo"][0]
        if xs:
            h = np.c_[direction(xs, p["uf"], 0), direction(xs[::-1], p["ub"], 3 * h_)[::-1]]
            e = np.tanh(h @ p["wa"]) @ p["va"]
            e = np.exp(e - e.max())
            logit += (e / e.sum()) @ h @ p["wo"]
        best = max(best, logit)
    return sig(best)


def test_network_equals_plain_forward_pass():
    net, rng = toxicity.Network(3), np.random.default_rng(4)
    net.p = {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in net.p.items()}
    texts = [t for t in texts_of(6, 40) if t is None or len(t) < 10_000] + [" ".join(f"w{k % 37}" for k in range(300)), "... !!! ---"]
    got = toxicity.score_texts(net, pa.array(texts, pa.string()), 48, 32)
    assert np.allclose(got, [plain_score(net, t, 48, 32) for t in texts], atol=2e-4)


def test_labels_of_one_class_repeated_and_null(spark):
    docs = spark.createDataFrame([(k, f"some words number {k} of a text", "x") for k in range(40)] + [(None, None, None)], "doc_id long, text string, toxic string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(k, toxic, 1) for k in range(40)] + [(1, toxic, 1), (None, 1 - toxic, 1), (3, None, 1)], "doc_id long, toxic int, text int")
        assert toxicity.fit(docs, labels) == float(toxic)
        assert {r["score"] for r in toxicity.toxicity(docs, float(toxic)).collect()} == {float(toxic)}
    both = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(docs, both)
    got = toxicity.toxicity(docs.unionByName(docs), model).collect()
    assert len(got) == 82 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, chosen_id int, kept string"


def test_pipeline_from_end_to_end_on_odd_tables(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("the", "an", "re", "over", "st", "qu") for b in ("tion", "ing", "able", "er", "s", "al", "ment")]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(80, 160))) for _ in range(60)]
    long = " ".join(f"{rng.choice(words)}{rng.randrange(400)}" for _ in range(20_000))
    rows = [(k, t, "en", "hot", len(t), "a", k, None) for k, t in enumerate(good)]
    rows += [rows[3], rows[3], (None, good[7], None, None, None, None, None, None), (None, None, "en", "s", 0, "x", 1, "y"), (100, "", "en", "s", 0, "x", 1, "y"), (101, long, "en", "s", len(long), "x", 1, "y")]
    rows += [(200 + k, good[9], "en", "hot", len(good[9]), "x", 1, "y") for k in range(50)]
    for name, part in (("odd", rows), ("none", [])):
        spark.createDataFrame(part, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in got} == {*range(60), 101}
    assert sum(r["piece"] == 0 for r in got) == 61 and sum(r["doc_id"] == 101 for r in got) > 10
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
