"""Golden cases, invariants and sequential counterparts of the operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import augment, corpus, dedup, ensemble, metrics, passages, sequence, spans
from spanloom.sources import readers, writers
from spanloom.streaming.dedup import drop_counts, first_copies

SPANS = "doc_id long, label string, start long, end long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    ("text", "start", "end", "want"),
    [
        ("«EVOS»ga chiqdik", 1, 5, "EVOS"), ("«EVOS»ga chiqdik", 0, 6, "EVOS"), ("KFC da edik", 0, 3, "KFC"), ("Toshkentda bo'ldi", 0, 8, "Toshkentda"),
        ("Farg'ona viloyati bor", 0, 17, "Farg'ona viloyati"), ("Bugun biz Samarqand.", 10, 20, "Samarqand"), ("#Toshkent shahri", 0, 9, "Toshkent"),
        ("@mobiuz xabari", 0, 7, "mobiuz"), ("Mobiuz'dan keldi", 0, 6, "Mobiuz'dan"), ("Oqtepa Lavash Xadra", 0, 13, "Oqtepa Lavash"), ("2024 yil", 0, 4, None),
        ("(G)I-DLE keldi", 0, 8, "(G)I-DLE"), ("Zverev A. keldi", 0, 9, "Zverev A."), ("abc", 2, 2, None), ("...", 0, 3, None),
    ],
)
def test_boundaries(text, start, end, want):
    got = spans.boundaries(text, start, end)
    assert (got and text[got[0] : got[1]]) == want


def test_normalize_span_column(spark):
    df = spark.createDataFrame([("#Toshkent", 0, 9), (None, 0, 1), ("12", 0, 2)], "text string, start int, end int")
    got = [r[0] for r in df.select(spans.normalize_span("text", "start", "end")).collect()]
    assert tuple(got[0]) == (1, 9)
    assert got[1] is None or got[1][0] is None


def test_overlaps_longest_first(spark):
    df = spark.createDataFrame([(1, "GEO", 0, 8), (1, "GEO", 0, 17), (1, "ORG", 18, 26)], SPANS)
    one = df.groupBy("doc_id").agg(F.collect_list(F.struct("label", "start", "end")).alias("s"))
    got = one.select(F.explode(spans.without_overlaps(F.col("s"))).alias("s")).select("s.*")
    assert rows(got, "start", "end", "label") == [(0, 17, "GEO"), (18, 26, "ORG")]


@pytest.mark.parametrize("scheme", ["bio", "bilou"])
def test_tag_round_trip(spark, scheme):
    offsets = [(0, 0), (0, 10), (11, 17), (18, 24), (25, 32), (0, 0)]
    tok = spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate(offsets)], "doc_id long, pos int, start long, end long")
    gold = spark.createDataFrame([(1, "GEO", 0, 10), (1, "ORG", 11, 24)], SPANS)
    got = spans.decode(spans.encode(spans.align(tok, gold), scheme))
    assert rows(got, "label", "start", "end") == [("GEO", 0, 10), ("ORG", 11, 24)]


def decode_in_order(tags):
    """One pass over tags; the counterpart of the islands."""
    out, now = [], None
    for k, tag in enumerate(tags):
        prefix, _, label = tag.partition("-")
        if prefix == "O":
            now = None
            continue
        if prefix in "BU" or now is None or now[0] != label:
            now = [label, k, k + 1]
            out.append(now)
        now[2] = k + 1
        if prefix in "LU":
            now = None
    return sorted(tuple(x) for x in out)


def test_decode_random_tags(spark):
    rng, data, want = random.Random(1), [], []
    for doc in range(200):
        tags = [rng.choice(spans.tags("bilou")) for _ in range(rng.randint(1, 12))]
        data += [(doc, k, k, k + 1, t) for k, t in enumerate(tags)]
        want += [(doc, *x) for x in decode_in_order(tags)]
    df = spark.createDataFrame(data, "doc_id long, pos int, start long, end long, tag string")
    assert rows(spans.decode(df), "doc_id", "label", "start", "end") == sorted(want)


def test_metric_identity(spark):
    counts = {"ORG": (2304, 293, 355), "NAME": (2044, 182, 275), "GEO": (2474, 229, 246)}
    df = metrics.with_ratios(spark.createDataFrame([(k, *v) for k, v in counts.items()], "label string, tp long, fp long, fn long"))
    by = {r["label"]: r for r in df.collect()}
    assert round(by["ORG"]["f1"], 4) == 0.8767 and round(by["GEO"]["precision"], 4) == 0.9153
    micro = metrics.with_ratios(df.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).first()
    assert round(micro["f1"], 4) == 0.8962


def test_empty_metrics(spark):
    none = spark.createDataFrame([], SPANS)
    got = {r["scope"]: r for r in metrics.evaluate(none, none).collect()}
    assert set(got) == {"ORG", "NAME", "GEO", "micro", "macro"} and got["micro"]["f1"] == 0.0


def greedy(keys):
    """Accept in order what shares no key with an accepted row."""
    taken, out = set(), {}
    for seq in sorted(keys):
        out[seq] = bool(keys[seq] & taken)
        if not out[seq]:
            taken |= keys[seq]
    return out


def test_greedy_near_duplicates(spark):
    rng = random.Random(3)
    keys = {k: {(b, str(rng.randint(0, 25))) for b in range(4)} for k in range(150)}
    keys |= {1000: {(0, "x")}, 1001: {(0, "x"), (1, "y")}, 1002: {(1, "y")}}  # a chain: its ends stay
    df = spark.createDataFrame([(s, b, v) for s, x in keys.items() for b, v in x], "seq long, band int, key string")
    got = {r["seq"]: r["near_dup"] for r in dedup.greedy_near_duplicates(df).collect()}
    assert got == greedy(keys)
    assert got[1001] and not got[1002]


def test_paragraph_rule(spark):
    a, b = "a" * 90, "b" * 90
    df = spark.createDataFrame([(1, f"{a}\n\n{b}"), (2, a), (3, f"{a}\n\nnew {b}"), (4, "short")], "seq long, passage string")
    got = {r["seq"]: r["paragraph_dup"] for r in dedup.paragraph_duplicates(passages.paragraphs(df)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_funnel_accounts_for_every_passage(spark):
    good = "Some words that make one passage of letters. " * 8
    df = spark.createDataFrame([(1, good), (2, good.upper()), (3, "short"), (4, "1234 " * 80), (5, good + "x"), (6, "a1 " * 20 + good)], "seq long, passage string")
    barred = spark.createDataFrame([(good + "x",)], "t string").select(T.digest(T.normalize(F.col("t"))).alias("digest"))
    assert rows(corpus.funnel(df, barred), "seq", "reason") == [(1, "accepted"), (2, "exact"), (3, "short"), (4, "alphabet"), (5, "excluded"), (6, "ocr")]


def test_quota_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(k, "s", 10) for k in range(5)], "seq long, source string, n_chars long")
    assert rows(corpus.quota_cut(df, 25), "seq") == [(0,), (1,), (2,)]
    assert rows(corpus.quota_cut(df, 0), "seq") == [(0,)]
    assert corpus.group_quotas(100, 0.2, ["a", "b"], ["c"]) == {"a": 40, "b": 40, "c": 20}
    with pytest.raises(ValueError):
        corpus.parse_sources(["nope"], {"a": 1})


def test_passages():
    assert passages.passage_list("short", 10) == ["short"]
    assert passages.passage_list("aaaa\n\nbbbb\n\ncccc", 9) == ["aaaa\nbbbb", "cccc"]
    assert passages.passage_list("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert passages.passage_list("aa\nbb\n" + "c" * 12, 6) == ["aa\nbb", "c" * 6, "c" * 6]


def test_text_functions(spark):
    data = [("İstanbul va Toshkent",), ("straße  ʻx",), ("О'зbek a1 b",), ("",), (None,)]
    df = spark.createDataFrame(data, "t string")
    t = F.col("t")
    got = df.select(
        F.length(T.same_length_case(t, False)).alias("n"), T.normalize(t).alias("norm"), T.normalize_full("t").alias("full"), T.script_of(t).alias("script"),
        F.round(T.ocr_noise(t)[0], 3).alias("noise"), T.title_case(t).alias("title"), T.detect_language(t).alias("lang"),
    ).collect()
    assert got[0]["n"] == 20
    assert got[1]["norm"] == got[1]["full"] == "strasse 'x"
    assert got[2]["script"] == "both" and got[2]["noise"] > 0.3
    assert got[3]["noise"] == 1.0 and got[3]["lang"] == "undetermined"
    assert got[4]["norm"] is None
    case = df.limit(1).select(T.case_like(F.lit("Tosh"), F.lit("ABC")).alias("a"), T.case_like(F.lit("Tosh"), F.lit("abc")).alias("b"), T.case_like(F.lit("Tosh"), F.lit("Abc")).alias("c")).first()
    assert tuple(case) == ("TOSH", "tosh", "Tosh")


def every_path(p, category, log_t):
    """Best path by trying all."""
    from itertools import product

    def score(path):
        total, before = 0.0, 0
        for k, tag in enumerate(path):
            total += np.log(max(p[k, tag], 1e-12)) + log_t[category[k], before, tag]
            before = tag
        return total

    return max(product(range(p.shape[1]), repeat=len(p)), key=score)


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, category, log_t = rng.random((4, 3)), rng.integers(0, 2, 4), np.log(rng.random((2, 3, 3)))
        assert tuple(sequence.viterbi_path(p, category, log_t)) == every_path(p, category, log_t)
    assert len(sequence.viterbi_path(np.zeros((0, 3)), np.zeros(0, int), np.zeros((2, 3, 3)))) == 0


def test_blocks_cover_every_token(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([3, 0, 700, 509, 1, 10])], "seq long, n_tokens long")
    got = sequence.blocks(sizes, 510, buckets=2)
    assert got.agg(F.sum(F.col("to") - F.col("from"))).first()[0] == 1223
    assert got.groupBy("block").agg(F.sum(F.col("to") - F.col("from")).alias("n")).where("block < 2").where("n <> 510").isEmpty()
    with pytest.raises(ValueError):
        sequence.windows(spark.createDataFrame([(1,)], "doc_id long"), 10, 8)


def test_votes_and_projection(spark):
    df = spark.createDataFrame([(0, 1, "GEO", 0, 4), (1, 1, "GEO", 0, 4), (2, 1, "GEO", 0, 9)], f"run int, {SPANS}")
    assert rows(ensemble.elected(ensemble.votes(df), 1), "start", "end") == [(0, 4)]
    assert rows(ensemble.elected(ensemble.votes(df), 1, prefer_votes=False), "start", "end") == [(0, 9)]
    assert ensemble.projection("bilou", "bio")["U-GEO"] == "B-GEO"
    with pytest.raises(ValueError):
        ensemble.projection("bio", "bilou")
    best, top = ensemble.weight_search(lambda w: -abs(w["a"] - 3) - abs(w["b"] - 0.5), ["a", "b"])
    assert best == {"a": 3.0, "b": 0.5} and top == 0


def test_swap_keeps_offsets(spark):
    docs = spark.createDataFrame([(1, "Ali va Vali keldi"), (2, "no entities here")], "doc_id long, text string")
    m = spark.createDataFrame([(1, "NAME", 0, 3, "Ali", "Xurshid"), (1, "NAME", 7, 11, "Vali", "Bo")], f"{SPANS}, mention string, replacement string")
    text = {r["doc_id"]: r["text"] for r in augment.swapped_text(docs, m).collect()}
    assert text == {1: "Xurshid va Bo keldi", 2: "no entities here"}
    for r in augment.swapped_offsets(m).collect():
        assert text[1][r["new_start"] : r["new_end"]] == r["replacement"]
    changed = augment.distort_case(docs, m.drop("replacement"), seed=1).join(docs.withColumnRenamed("text", "old"), "doc_id")
    assert changed.where("length(text) <> length(old) or lower(text) <> lower(old)").isEmpty()


def test_mask_share(spark):
    tok = spark.createDataFrame([(1, k // 2, k) for k in range(40)], "block long, word_id long, pos long")
    got = augment.mask_words(tok, 0.15, seed=1)
    assert got.where("action is not null").select("word_id").distinct().count() == 3


def line(**fields):
    return json.dumps(fields, ensure_ascii=False)


def test_strict_reader(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join([line(hash="a", text="Ali😀", entities=[{"label": "NAME", "start": 0, "end": 4}]), line(hash="b", text="x", entities=[])]) + "\n")
    assert readers.read_strict(spark, str(good)).count() == 2
    broken = {
        "empty": "", "json": "{oops", "key": line(hash="", text="x", entities=[]), "text": line(hash="a", text=5, entities=[]),
        "label": line(hash="a", text="abc", entities=[{"label": "X", "start": 0, "end": 1}]),
        "offset": line(hash="a", text="abc", entities=[{"label": "ORG", "start": 0, "end": 9}]),
    }
    for name, bad in broken.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text(line(hash="z", text="ok", entities=[]) + "\n" + bad + "\n" + line(hash="y", text="ok", entities=[]) + "\n")
        with pytest.raises(readers.InputError, match=name):
            readers.read_strict(spark, str(path))
    boolean = tmp_path / "bool.jsonl"
    boolean.write_text(line(hash="a", text="abc", entities=[{"label": "ORG", "start": True, "end": 2}]) + "\n")
    with pytest.raises(readers.InputError, match="offset"):
        readers.read_strict(spark, str(boolean))
    twice = tmp_path / "twice.jsonl"
    twice.write_text((line(hash="a", text="x", entities=[]) + "\n") * 2)
    with pytest.raises(readers.InputError, match="repeated"):
        readers.read_strict(spark, str(twice))


def test_runs_and_sinks(spark, tmp_path):
    for name, f1 in (("b", 0.5), ("a", 0.5), ("c", 0.7)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "dev_metrics.json").write_text(json.dumps({"micro": {"f1": f1}}))
    (tmp_path / "runs" / "a" / "run_config.json").write_text(json.dumps({"tag_scheme": "bio"}))
    table = readers.run_table(readers.read_runs(spark, str(tmp_path / "runs")))
    assert [r["run"] for r in table.orderBy(F.desc("micro_f1"), "run").collect()] == ["c", "a", "b"]
    writers.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "ORG", 0, 1)], SPANS)
    writers.write_json_lines(writers.predictions(docs, one), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    report = json.loads(writers.metrics_json(metrics.evaluate(one, one), 2))
    assert report["micro"]["f1"] == 1.0 and set(report["by_label"]) == {"ORG", "NAME", "GEO"}


def test_shards(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f"text {k}"), (k, "")], "n int, Content string").coalesce(1).write.parquet(str(tmp_path / f"train-{k}.parquet"))
    got = readers.read_shards(spark, [str(tmp_path / f"train-{k}.parquet") for k in range(3)], limit=2)
    assert sorted(r["text"] for r in got.collect()) == ["text 0", "text 1"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("Same text", "2024-01-01 00:00:00"), ("same  TEXT", "2024-01-01 00:01:00"), ("other", "2024-01-01 00:02:00")], "text string, ts string").select(
        "text", F.to_timestamp("ts").alias("ts")
    ).write.parquet(str(src))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(src))
    for name, df, mode, n in (("firsts", first_copies(stream), "append", 2), ("drops", drop_counts(stream), "complete", 1)):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
        assert spark.table(name).count() == n
