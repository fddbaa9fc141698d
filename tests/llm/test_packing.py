"""Packing of repeated rows, very long texts and vocabularies with another pre-tokeniser."""

import json
import random
import shutil

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import packing


def test_equal_rows_share_no_window(spark):
    rows = spark.range(0, 100_000, 1, 6).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = packing.pack(rows, bucket_rows=1000)
    by = got.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("o"))
    shapes = {tuple(r["o"]): r["n"] for r in by.groupBy("o").agg(F.count("*").alias("n")).collect()}
    assert shapes == {(0, 300, 600): 33_333, (0,): 1}


def test_very_long_texts(spark):
    texts = ["w" * 300_000, "line " * 60_000, "\n" * 50_000, "é" * 100_000]
    own = packing.encoder(packing.default_vocabulary())
    want = [np.array(x.ids, "<u4").tobytes() for x in own.model.encode_batch(texts, add_special_tokens=False)]
    assert list(own(texts)) == want
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(packing.pieces(docs, packing.default_vocabulary())).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {k: len(x) // 4 + 1 for k, x in enumerate(want)}


def test_other_pre_tokenisers_code_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    setup = json.loads(Tokenizer.from_file(packing.default_vocabulary()).to_str())
    setup["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(setup))
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["one", "two,", "x  y", "né", ""]) for _ in range(20)) for _ in range(50)]
    own = packing.Encoder(str(path))
    assert not own.cuts
    assert list(own(texts)) == [np.array(x.ids, "<u4").tobytes() for x in own.model.encode_batch(texts, add_special_tokens=False)]


def test_long_parts_do_not_stay_in_the_cache():
    own = packing.Encoder(packing.default_vocabulary())
    texts = ["start " + "w" * 500_000 + " " + "x9" * 200_000 + "!" * 90_000 + " end", "plain words"]
    want = [np.array(x.ids, "<u4").tobytes() for x in own.model.encode_batch(texts, add_special_tokens=False)]
    assert own(texts) == want and own.long
    assert own(["plain words again", "more of them"]) and not own.long
    assert max(map(len, [*own, *own.known])) <= own.LONG and "words" in own


def test_the_pipeline_leaves_no_encoder_in_the_workers(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    path = shutil.copy(packing.default_vocabulary(), tmp_path / "own.json")
    docs = spark.createDataFrame([(k, f"word{k} and word{k % 7} again, and again") for k in range(200)], "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, packing.pieces(docs, packing.default_vocabulary()).collect()))
    monkeypatch.setattr(packing, "default_vocabulary", lambda: str(path))
    got = corpus_pipeline.best_fit_packing(spark, docs, "").select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want == sorted(map(tuple, packing.pieces(docs, packing.default_vocabulary(), most=10).collect()))

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kept": pa.array([str(path) in packing._encoders] * batch.num_rows)})

    assert spark.range(0, 64, 1, 16).mapInArrow(kept, "kept boolean").where("kept").count() == 0
