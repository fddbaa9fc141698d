"""Subword windows against the tokenizer's own, labels against all pairs, Bloom anti-joins against a set."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import bloom, corpus, sequence, spans, subwords

P = pytest.importorskip("public_tokenizers")
SHAPE = subwords.Windows(16, 5, 50256, 50256)
BITS = ["Straße", "née", "naïve", "word", "你好", "\U0001f600", "don't", "x1", "  ", "\n\n", "\t", "12345", "…", "longerword"]


def texts(rng, n=40):
    return ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "one", " x"]


def path():
    return P.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path())


def test_windows_equal_the_tokenizers_own(spark):
    rows = list(enumerate(texts(random.Random(1)))) + [(7, "again 7"), (None, "no id"), (99, None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, win string").repartition(3)
    got = subwords.subword_windows(df, path(), SHAPE, rows=4).collect()
    t = tokenizer()
    t.enable_truncation(14, stride=5)
    want = []
    for k, text in rows:
        if text is None:
            continue
        first = t.encode(text, add_special_tokens=False)
        for win, e in enumerate([first, *first.overflowing]):
            starts = []
            for a, b in e.offsets:
                rest = text[a:b].lstrip()
                starts.append(b - len(rest) if rest else a)
            want.append((k, win, [50256, *e.ids, 50256], [0, *starts, 0], [0, *(b for _, b in e.offsets), 0]))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert subwords.subword_windows(df.limit(0), path(), SHAPE).count() == 0
    with pytest.raises(ValueError):
        subwords.subword_windows(df, path(), subwords.Windows(16, 14))


def test_long_texts_in_stretches_equal_whole_ones():
    t = tokenizer()
    rng = random.Random(3)
    for text in [*texts(rng, 30), "x" * 500, " ".join(["word"] * 400)]:
        for size in (1, 7, 50):
            parts = list(subwords.stretches(text, size))
            assert "".join(p for _, p in parts) == text
            whole = t.encode(text, add_special_tokens=False)
            got = [(i, a + at, b + at) for at, p in parts for e in [t.encode(p, add_special_tokens=False)] for i, (a, b) in zip(e.ids, e.offsets)]
            assert got == [(i, a, b) for i, (a, b) in zip(whole.ids, whole.offsets)]


def marks(rng, rows):
    return [(k, rng.choice(["ORG", "NAME", "GEO"]), s, s + rng.randint(1, 9)) for k, t in rows for _ in range(rng.randint(0, 3)) for s in [rng.randint(0, max(len(t) - 1, 0))]]


@pytest.mark.parametrize("scheme", ["bio", "bilou"])
def test_labelled_windows_equal_all_pairs_and_the_column_form(spark, scheme):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    gold = marks(rng, rows) + [(3, "ORG", None, 4), (5000, "ORG", 0, 3)]
    marked = spark.createDataFrame(gold, "doc_id long, label string, start int, end int")
    windows = subwords.subword_windows(docs, path(), SHAPE)
    names = spans.tags(scheme)
    want = {}
    for r in windows.collect():
        own = sorted((s, e, x) for k, x, s, e in gold if k == r["doc_id"] and s is not None)
        found = []
        for a, b in zip(r["start"][1:-1], r["end"][1:-1]):
            hit = [(s, e, x) for s, e, x in own if e > a and s < b]
            if not hit:
                found.append(0)
                continue
            s, e, x = hit[0]
            first, last = a <= s < b, a < e <= b
            prefix = ("B" if first else "I") if scheme == "bio" else "U" if first and last else "B" if first else "L" if last else "I"
            found.append(names.index(f"{prefix}-{x}"))
        if any(found):
            want[r["doc_id"], r["win"]] = [-100, *found, -100]
    labelled = subwords.labelled_windows(docs, marked, path(), SHAPE, scheme)
    assert {(r["doc_id"], r["win"]): r["tag"] for r in labelled.collect()} == want
    # tokens of the windows, each once, through the column operators
    tokens = sequence.document_tokens(subwords.window_tokens(windows))
    tags = spans.encode(spans.align(tokens, marked), scheme).collect()
    by = {}
    for r in labelled.collect():
        for a, b, t in zip(r["start"], r["end"], r["tag"]):
            if t > 0:
                by[r["doc_id"], a, b] = names[t]
    assert {(r["doc_id"], r["start"], r["end"]): r["tag"] for r in tags if r["tag"] != "O"} == by


def test_windows_through_average_categories_and_viterbi(spark):
    """Scores of overlapping windows are averaged token by token, decoded, and give back the spans of the tags they favour."""
    rows = [(k, " ".join(w) + ".") for k, w in enumerate([["Alpha", "met", "Zyxwvut", "at", "Brno"] * 4, ["nothing", "here"] * 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gold = [(0, "NAME", i, i + 7) for i in range(len(rows[0][1])) if rows[0][1].startswith("Zyxwvut", i)]
    marked = spark.createDataFrame(gold, "doc_id long, label string, start long, end long")
    names = spans.tags("bilou")
    tokens = subwords.window_tokens(subwords.subword_windows(docs, path(), SHAPE))
    tagged = spans.encode(spans.align(sequence.document_tokens(tokens), marked)).select("doc_id", "start", "end", "tag")
    each = tokens.join(tagged.withColumnRenamed("tag", "own"), ["doc_id", "start", "end"]).select("*", F.explode(F.array(*map(F.lit, names))).alias("tag"))
    probs = each.withColumn("p", F.when(F.col("tag") == F.col("own"), 0.9 - F.col("win") * 0.01).otherwise(0.01))
    mean = sequence.average(probs).groupBy("doc_id", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("tag", "p"))).alias("m"))
    kinds = F.array(*map(F.lit, sequence.CATEGORIES))
    cats = sequence.categories(mean.select("doc_id", "start", "end"), docs).withColumn("category", (F.array_position(kinds, F.col("category")) - 1).cast("int"))
    ready = mean.select("doc_id", "start", "end", F.array(*[F.col("m")[x] for x in names]).alias("probs")).join(cats, ["doc_id", "start", "end"])
    log_t = sequence.transition_array(sequence.log_transitions(sequence.transition_counts(tagged.join(cats.withColumn("category", F.get(kinds, F.col("category"))), ["doc_id", "start", "end"])), "bilou"), "bilou", 0.4)
    decoded = spans.decode(sequence.viterbi(ready, log_t, names).withColumn("pos", F.lit(0)))
    assert sorted((r["doc_id"], r["label"], r["start"], r["end"]) for r in decoded.collect()) == sorted(gold)


def test_calibration_counts_tokens(spark):
    rows = list(enumerate(texts(random.Random(9)))) + [(-1, None)]
    got = corpus.calibrate(spark.createDataFrame(rows, "seq long, text string"), "seq", 20, 90, subwords.token_counter(spark, path())).first()
    t, first = tokenizer(), [x[:90] for _, x in rows[:19]]
    assert (got["chars"], got["tokens"]) == (sum(map(len, first)), sum(len(t.encode(x).ids) for x in first))


@pytest.mark.parametrize("most_bits,least", [(1 << 20, 4096), (64, 4096), (1 << 20, 3), (64, 3)])
def test_anti_join_equals_a_set(spark, most_bits, least):
    """Also with a filter that lets everything pass, and where keys are frequent, excluded or not."""
    rng = random.Random(least)
    keys = [f"k{rng.randint(0, 300)}" for _ in range(1500)] + ["hot"] * 700 + ["free"] * 700 + [None] * 5 + [""]
    out = [f"k{k}" for k in range(0, 300, 3)] * 2 + ["hot", None, "elsewhere"]
    rows = spark.createDataFrame([(k, x, "y") for k, x in enumerate(keys)], "seq long, digest string, _hot string").repartition(4)
    left = bloom.without(rows, spark.createDataFrame([(x, 1) for x in out], "digest string, seq int"), most_bits=most_bits, least=least, most=20)
    assert left.columns == rows.columns
    assert sorted(r["seq"] for r in left.collect()) == [k for k, x in enumerate(keys) if x is None or x not in out]
    assert bloom.without(rows, rows.limit(0)).count() == len(keys) and bloom.without(rows.limit(0), rows).count() == 0


def test_rows_that_cannot_be_excluded_are_not_shuffled(spark):
    known = spark.range(20_000).select(F.concat(F.lit("in"), "id").alias("k"))
    held = bloom.bloom(known, "k", 20_000)
    assert known.where(~held.may_hold(F.col("k"))).count() == 0
    others = spark.range(50_000).select(F.concat(F.lit("out"), "id").alias("k")).where(held.may_hold(F.col("k")))
    assert others.count() < 1000


def test_spans_are_cleaned_document_by_document(spark):
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(texts(rng))] + [(60, "«Acme» (Inc.) of J. Smith-"), (61, None)]
    found = marks(rng, [r for r in rows if r[1]]) + [(60, "ORG", 0, 6), (60, "NAME", 17, 26), (60, "ORG", None, 3), (61, "ORG", 0, 3), (62, "ORG", 0, 1)]
    got = spans.postprocess(spark.createDataFrame(found, "doc_id long, label string, start int, end int"), spark.createDataFrame(rows, "doc_id long, text string"))
    want = []
    for k, t in rows:
        clean = {(*b, x) for o, x, s, e in found if o == k and t is not None and s is not None for b in [spans.boundaries(t, s, e)] if b}
        kept = []
        for s, e, x in sorted(clean, key=lambda c: (c[0] - c[1], c[0], c[1], c[2])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, x))
        want += [(k, x, s, e) for s, e, x in kept]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most_bits,least", [(1 << 20, 4096), (64, 2)])
def test_counts_of_clean_keys_equal_a_set(spark, most_bits, least):
    rng = random.Random(6)
    rows = [(k % 20, [rng.choice(["hot", "free", "a", "b", f"k{rng.randint(0, 90)}"]) for _ in range(rng.randint(0, 12))]) for k in range(60)]
    rows += [(None, ["a", "zz"]), (50, None), (51, []), (52, ["hot"]), (53, ["zz"])]
    out = ["hot", "a", *(f"k{k}" for k in range(0, 90, 2)), None]
    want = {}
    for k, own in rows:
        want[k] = want.get(k, 0) + sum(x not in out for x in own or [])
    got = bloom.clean_counts(spark.createDataFrame(rows, "doc_id long, keys array<string>"), "keys", spark.createDataFrame([(x,) for x in out], "key string"), "key", most_bits=most_bits, least=least, most=20)
    assert {r["doc_id"]: r["n_clean"] for r in got.collect()} == {k: n for k, n in want.items() if n}
