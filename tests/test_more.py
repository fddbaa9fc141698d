"""Strict input, runs and shards, votes, augmentation, whole corpus build, frequent keys."""

import json
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import augment, corpus, dedup, ensemble, metrics, passages, sequence, spans
from spanloom.sources import readers, writers

SPANS = "doc_id long, label string, start long, end long"


def line(**fields):
    return json.dumps(fields, ensure_ascii=False)


def entity(label="ORG", start=0, end=1):
    return {"label": label, "start": start, "end": end}


NEGATIVE = [
    ("empty", "   "), ("json", "{oops"), ("json", "[1]"), ("key", line(text="x", entities=[])), ("text", line(hash="a", text=5, entities=[])),
    ("entities", line(hash="a", text="abc", entities={"label": "ORG"})), ("label", line(hash="a", text="abc", entities=[entity("X")])),
    ("offset", line(hash="a", text="abc", entities=[entity(start="0")])), ("offset", line(hash="a", text="abc", entities=[entity(start=True)])),
    ("offset", line(hash="a", text="abc", entities=[entity(start=0.5)])), ("offset", line(hash="a", text="abc", entities=[entity(start=1, end=1)])),
    ("offset", line(hash="a", text="abc", entities=[entity(end=9)])), ("duplicate", line(hash="a", text="abc", entities=[entity(), entity()])),
    ("overlap", line(hash="a", text="abcdef", entities=[entity(start=0, end=3), entity("GEO", 2, 5)])),
]

@pytest.mark.parametrize(("name", "bad"), NEGATIVE)
def test_strict_reader_names_the_error(spark, tmp_path, name, bad):
    (tmp_path / "x.jsonl").write_text(line(hash="z", text="ok", entities=[]) + "\n" + bad + "\n" + line(hash="y", text="ok ok", entities=[entity("ORG", 0, 2), entity("GEO", 3, 5)]) + "\n")
    with pytest.raises(readers.InputError, match=f"line 2: {name}$"):
        readers.read_strict(spark, str(tmp_path / "x.jsonl"))
    assert readers.read_strict(spark, str(tmp_path / "x.jsonl"), limit=1).count() == 1


def test_strict_reader_keeps_fields_and_lines(spark, tmp_path):
    body = [line(hash=str(k), text="abc", entities=[entity()], more={"a": k}) for k in range(3000)]
    (tmp_path / "x.jsonl").write_text("\n".join(body) + "\n")
    got = readers.read_strict(spark, str(tmp_path / "x.jsonl"), all_fields=True)
    assert got.where(F.try_variant_get("fields", "$.more.a", "int") == F.col("hash").cast("int")).count() == 3000
    (tmp_path / "x.jsonl").write_text("\n".join([*body[:2500], "oops", *body[2501:]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        with pytest.raises(readers.InputError, match="line 2501: json$"):
            readers.read_strict(spark, str(tmp_path / "x.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_runs_shards_sources_and_sidecars(spark, tmp_path):
    assert readers.resolve_run("/a/run-1/") == ("run-1", "/a/run-1/dev_predictions.jsonl")
    assert readers.resolve_run("/a/run-1/dev_predictions.jsonl")[0] == "run-1" and readers.resolve_run("/a/other.v2.jsonl") == ("other.v2", "/a/other.v2.jsonl")
    (tmp_path / "one" / "best").mkdir(parents=True)
    (tmp_path / "one" / "dev_predictions.jsonl").write_text(line(hash="a", entities=[entity()]) + "\n")
    (tmp_path / "two.jsonl").write_text(line(hash="a", entities=[entity(end=2), entity("GEO", 5, 6)]) + "\n")
    got = readers.read_predictions(spark, [str(tmp_path / "one"), str(tmp_path / "two.jsonl")])
    assert {(r["run"], r["end"]) for r in got.collect()} == {("one", 1), ("two", 2), ("two", 6)}
    (tmp_path / "one" / "run_config.json").write_text('{"a": 1}')
    assert readers.read_sidecar(spark, str(tmp_path / "one" / "best"), "run_config.json").count() == 1
    with pytest.raises(readers.InputError):
        readers.read_sidecar(spark, str(tmp_path / "one"), "none.json")
    for name, text in (("c1/data/train-0.parquet", "one"), ("c1/data/dev-0.parquet", "no"), ("c2/train/0.parquet", "two"), ("c2/train/1.parquet", "three")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"content": [text, "", None]}).to_parquet(tmp_path / name)
    registry = {"c1": readers.Source(str(tmp_path / "c1")), "c2": readers.Source(str(tmp_path / "c2"), foreign=True)}
    got = readers.read_sources(spark, registry, corpus.parse_sources(["c2:1", "c1"], registry))
    assert sorted((r["ordinal"], r["source"], r["text"]) for r in got.collect()) == [(0, "c2", "two"), (1, "c1", "one")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456789, None), ("bb", 2.0, 7)], "name string, f double, n long")
    assert writers.rendered(df.orderBy("name")).split("\n") == ["name       f  n", "a     0.1235  -", "bb    2.0000  7"]
    writers.write_csv(df.select("name", "f"), str(tmp_path / "c"), digits=3)
    assert {r["f"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"0.123", "2.0"}
    made = []
    for _ in range(2):
        assert writers.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or df).count() == 2
    assert len(made) == 1
    (tmp_path / "input.txt").write_text("one")
    for k, text in enumerate(["one", "one", "other words"]):  # a changed input or setting makes a table of its own
        (tmp_path / "input.txt").write_text(text) if k == 2 else None
        writers.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or df, [str(tmp_path / "input.txt")], {"window": 3})
    assert len(made) == 3
    writers.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or df, [str(tmp_path / "input.txt")], {"window": 4})
    assert len(made) == 4
    rows = spark.createDataFrame([("abcdef", [("ORG", 3, 9), ("GEO", 2, 4), ("X", 0, 1), ("GEO", 2, 4), ("ORG", 0, 2)])], f"text string, e array<{readers.SPAN}>")
    assert [tuple(x) for x in rows.select(writers.contract(F.col("text"), F.col("e")).alias("e")).first()["e"]] == [("ORG", 0, 2), ("GEO", 2, 4)]


def greedy(spans_, key):
    kept = []
    for s in sorted(set(spans_), key=key):
        if all(s[1] >= o[2] or o[1] >= s[2] for o in kept):
            kept.append(s)
    return {s[:3] for s in kept}


@pytest.mark.parametrize("prefer_votes", [True, False])
def test_elected_equals_sequential_choice(spark, prefer_votes):
    rng, data, want = random.Random(2), [], set()
    for doc in range(60):
        spans_ = {(label, s, s + n): rng.randint(1, 3) for label, s, n in ((rng.choice(["ORG", "GEO"]), rng.randint(0, 30), rng.randint(1, 5)) for _ in range(12))}
        data += [(run, doc, *s) for s, n in spans_.items() for run in range(n)]
        tagged = [(*s, n) for s, n in spans_.items()]
        key = (lambda s: (-s[3], s[1] - s[2], s[1], s[2], s[0])) if prefer_votes else (lambda s: (s[1] - s[2], -s[3], s[1], s[2], s[0]))
        want |= {(doc, *s) for s in greedy(tagged, key)}
    df = spark.createDataFrame(data, f"run int, {SPANS}")
    got = ensemble.elected(ensemble.votes(df), 1, prefer_votes).select("doc_id", "label", "start", "end")
    assert {tuple(r) for r in got.collect()} == want


def test_projection_and_search():
    assert ensemble.projection("bilou", "bio") == {
        "O": "O", **{f"{p}-{x}": f"{q}-{x}" for x in spans.LABELS for p, q in (("B", "B"), ("I", "I"), ("L", "I"), ("U", "B"))}
    }
    assert ensemble.projection("bio", "bio") == {t: t for t in spans.tags("bio")}
    jobs = []

    def score_all(trials):
        jobs.append(len(trials))
        return [-abs(t["a"] - 4) - abs(t["b"]) for t in trials]

    assert ensemble.weight_search(None, ["a", "b"], score_all=score_all) == ({"a": 4.0, "b": 0.0}, 0.0)
    assert len(jobs) == 5


def test_blends_in_one_job(spark):
    parts = spark.createDataFrame([(m, 1, 0, 2, t, p, 2.0) for m, t, p in (("a", "O", 1.0), ("a", "B", 1.0), ("b", "O", 0.2), ("b", "B", 1.8))], "model string, doc_id long, start long, end long, tag string, total double, weight double")
    trials = [{"a": 1.0, "b": 1.0}, {"a": 3.0, "b": 0.0}, {"a": 0.0, "b": 0.0}]
    both = ensemble.blend_all(parts, trials).collect()
    for k, t in enumerate(trials):
        one = {r["tag"]: r["p"] for r in ensemble.blend(parts, t).collect()}
        assert {r["tag"]: r["p"] for r in both if r["trial"] == k} == one


def test_numbered_forms_and_swap(spark):
    rng = random.Random(5)
    data = [(k, rng.choice(["ORG", "GEO"]), 0, 0, rng.choice(["Tosh", "Bux", "Сам", "Нук"]) + rng.choice(["", "ga", "dan", "да"]) + rng.choice("abcdef")) for k in range(400)]
    m = spark.createDataFrame([(d, x, 0, len(w), w) for d, x, _, _, w in data], f"{SPANS}, mention string")
    forms = augment.numbered(m, buckets=3).collect()
    wide = {(r["level"], r["label"], r["script"] or "", r["affix"] or ""): r["forms"] for r in augment.gazetteer(m).collect()}
    by = {}
    for r in forms:
        by.setdefault((r["level"], r["label"], r["script"], r["affix"]), {})[r["k"]] = (r["form"], r["n"])
    assert by.keys() == wide.keys()
    for key, x in by.items():
        assert sorted(x) == list(range(len(wide[key]))) and sorted(f for f, _ in x.values()) == wide[key] and {n for _, n in x.values()} == {len(x)}
    all_ = augment.swap(m, augment.numbered(m), 3, share=1.0)
    half = augment.swap(m, augment.numbered(m), 3)
    same = lambda df: df.where("replacement = mention").count() / 400
    assert all_.count() == half.count() == 400 and same(all_) < 0.3 and 0.4 < same(half) < 0.75
    known = {w for *_, w in data}
    assert all(r["replacement"].lower() in {w.lower() for w in known} for r in all_.collect())


def test_augmented_epochs(spark):
    docs = spark.createDataFrame([(k, f"Ali{k} va Toshkent{k % 7} keldi") for k in range(200)], "doc_id long, text string")
    m = spark.createDataFrame([(k, "NAME", 0, len(f"Ali{k}"), f"Ali{k}") for k in range(200)], f"{SPANS}, mention string")
    forms = augment.numbered(m)
    seen = []
    for epoch in (0, 0, 1):
        text, moved = augment.augmented(docs, m, forms, 1, epoch)
        texts = {r["doc_id"]: r["text"] for r in text.collect()}
        assert len(texts) == 200
        for r in moved.collect():
            assert texts[r["doc_id"]][r["start"] : r["end"]] == r["mention"]
        seen.append(texts)
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert seen[0] == seen[1] != seen[2]
    assert 20 < sum(t.lower() != old[k].lower() for k, t in seen[0].items()) < 120 and any(t == old[k] for k, t in seen[0].items())
    plain, _ = augment.augmented(docs, m, forms, 1, swap_probability=0.0, case_probability=0.0)
    assert {r["doc_id"]: r["text"] for r in plain.collect()} == old


def test_normalize_full(spark):
    pairs = [("ﬁn", "fin"), ("ＡＢＣ１", "abc1"), ("a b", "a b"), ("ΟΔΟΣ", "οδος"), ("ШКОЛА  Ў`", "школа ў'"), ("Straße", "STRASSE"), ("é", "é"), ("x`y", "X'Y"), (" a\x1cb\x0bc ", "a b c")]
    df = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, None), ("", " ")], "a string, b string")
    for r in df.select(T.normalize_full("a").alias("x"), T.normalize_full("b").alias("y"), "a").collect():
        assert r["x"] == r["y"]
        if r["a"] is not None:
            want = unicodedata.normalize("NFKC", r["a"]).casefold().translate(str.maketrans(dict.fromkeys(T.APOSTROPHES, "'")))
            assert r["x"] == " ".join(want.split())
    plain = spark.createDataFrame([("Some ASCII\ttext`s ",), (None,)], "a string")
    assert [r[0] for r in plain.select(T.normalize_full("a")).collect()] == ["some ascii text's", None]


def test_frequent_keys_in_stream_order(spark):
    rows = spark.range(0, 100_000, 1, 6).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("digest"))
    got = dedup.exact_duplicates(rows)
    assert got.where("is_dup").count() == 33_333 and got.count() == 100_000
    keys = rows.select("seq", F.lit(0).alias("band"), F.col("digest").alias("key"))
    assert dedup.bucket_links(keys).where("a = 0").count() == 33_333
    assert dedup.first_in_bucket(keys).where("near_dup").count() == 33_333
    assert dedup.greedy_near_duplicates(keys).where("near_dup").count() == 33_333


def test_quota_in_ranges(spark):
    rng = random.Random(4)
    data = [(k * k, rng.choice(["hot", "hot", "b", None]), rng.randint(1, 50)) for k in range(300)]
    df = spark.createDataFrame(data, "seq long, source string, n_chars long")
    want, used = set(), {}
    for seq, source, n in data:
        if used.get(source, 0) < 500:
            want.add(seq)
        used[source] = used.get(source, 0) + n
    for rows in (7, 1_000_000):
        assert {r["seq"] for r in corpus.quota_cut(df, 500, block_rows=rows).collect()} == want


def test_blocks_carry_and_whole(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([3, 0, 700, 509, 1, 10])], "seq long, n_tokens long")
    got = sequence.blocks(sizes, 510, carry=7, whole=True)
    by = {r["block"]: r["n"] for r in got.groupBy("block").agg(F.sum(F.col("to") - F.col("from")).alias("n")).collect()}
    assert by == {0: 503, 1: 510}


def test_checks_and_reports(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    assert [r[0] for r in metrics.text_differences(gold, spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (9, "q")], gold.schema)).collect()] == [2]
    ask = spark.createDataFrame([(k, h) for k, h in enumerate("abc")], "pos long, hash string")
    answer = spark.createDataFrame([(0, "a"), (1, "c"), (3, "z")], "pos long, hash string")
    assert sorted(tuple(r) for r in metrics.response_problems(ask, answer).collect()) == [(1, "order"), (2, "missing"), (3, "extra")]
    df = spark.createDataFrame([(x,) for x in "abbccd"], "w string")
    assert [tuple(r) for r in metrics.most_common(df, "w", n=3).collect()] == [("b", 2), ("c", 2), ("a", 1)]


def test_predictor_and_viterbi_batches(spark):
    records = spark.createDataFrame([(f"h{k}", "x" * k) for k in range(50)], "hash string, text string")
    assert sequence.predicted(records).where("size(entities) = 0").count() == 50
    got = sequence.predicted(records, lambda b: [[{"label": "ORG", "start": 0, "end": len(t)}] for t in b["text"]], batch=7)
    assert got.where("entities[0].end = cast(substring(hash, 2) as int)").count() == 50
    rng = np.random.default_rng(1)
    data = [(d, k, k + 1, int(rng.integers(0, 2)), rng.random(3).tolist()) for d in range(40) for k in range(rng.integers(1, 9))]
    log_t = np.log(rng.random((2, 3, 3)))
    df = spark.createDataFrame(data, "doc_id long, start long, end long, category int, probs array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["doc_id"], r["start"]): r["tag"] for r in sequence.viterbi(df, log_t, ["O", "B", "I"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in range(40):
        own = [x for x in data if x[0] == d]
        path = sequence.viterbi_path(np.array([x[4] for x in own]), np.array([x[3] for x in own]), log_t)
        assert [got[d, x[1]] for x in own] == [["O", "B", "I"][k] for k in path]


def test_words_with_offsets(spark):
    texts = ["one  two three ", "", None, " é 😀x y", "single", "    "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]): (r["w"], r["start"], r["end"], r["next_w"], r["next_end"]) for r in spans.words_with_offsets(df, following=True).collect()}
    want = {}
    for k, t in enumerate(texts):
        at, own = 0, []
        for pos, w in enumerate((t or "").split(" ") if t is not None else []):
            if w:
                own.append((pos, w, at, at + len(w)))
            at += len(w) + 1
        for a, b in zip(own, [*own[1:], (None, None, None, None)]):
            want[k, a[0]] = (a[1], a[2], a[3], b[1], b[3])
    assert got == want
