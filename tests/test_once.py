"""What is costly to make is made once, and batches are worked on in bounded parts."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import dedup, spans


@pytest.mark.parametrize("operator", [dedup.bucket_links, dedup.first_in_bucket])
def test_band_keys_are_made_once(spark, operator):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        made.add(1)
        return str(x % 7)

    keys = spark.range(40).select(F.col("id").alias("seq"), F.lit(0).alias("band"), key("id").alias("key"))
    got = operator(keys)
    assert got.count() == (33 if operator is dedup.bucket_links else 40)
    assert made.value == 40


def test_clean_spans_hold_numbers_only():
    """200,000 spans of one batch; as dictionaries they took about 80 MB."""
    text, n = " ".join(f"Word{k:03d}," for k in range(100)), 2000
    own = [{"label": "ORG", "start": 9 * k, "end": 9 * k + 8} for k in range(100)]
    kind = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    flat = pa.concat_arrays([pa.array(own, kind)] * n)
    batch = pa.ListArray.from_arrays(pa.array(range(0, 100 * n + 1, 100), pa.int32()), flat)
    texts = pa.array([text] * n)
    tracemalloc.start()
    got = spans.clean_spans.func(texts, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert len(got) == n and got[7].as_py() == [{"start": 9 * k, "end": 9 * k + 7, "label": "ORG"} for k in range(100)]


def test_clean_spans_of_odd_rows():
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    one = lambda s, e, label="ORG": {"label": label, "start": s, "end": e}
    rows = [[one(0, 4)], None, [], [one(None, 3), one(0, None), one(2, 9, None)], [one(0, 3)]]
    got = spans.clean_spans.func(pa.array(["Tosh.", "a", "b", "a Toshkent b", None]), pa.array(rows, kind))
    assert got.to_pylist() == [[{"start": 0, "end": 4, "label": "ORG"}], [], [], [{"start": 2, "end": 10, "label": None}], []]
    assert spans.clean_spans.func(pa.array(["x", "Tosh."]), pa.array(rows, kind)[3:5]).to_pylist()[1] == [{"start": 0, "end": 4, "label": "ORG"}]  # a slice of a batch


def test_words_are_made_of_bounded_parts():
    texts = ["a" * 600, None, "b" * 600, "", "c" * 5000, "d", "e"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts})
    parts = [p.column(0).to_pylist() for p in spans.stretches(batch, rows=2, size=1000)]
    assert parts == [[0, 1], [2, 3], [4], [5, 6]]
    assert [p.num_rows for p in spans.stretches(batch.slice(2, 5))] == [5]


def test_subword_parts_are_coded_once():
    """Texts of a few words, many times over: only what is new reaches the tokenizer, and the tokens are those of whole texts."""
    from pathlib import Path

    from spanloom.operators import subwords
    from spanloom.plans.subword import vocabulary

    real = subwords._tokenizer(Path(vocabulary()).read_text(encoding="utf-8"))

    class Counted:
        coded = 0

        def __getattr__(self, name):
            return getattr(real, name)

        def encode(self, text, **options):
            self.coded += len(text)
            return real.encode(text, **options)

    rng = random.Random(5)
    words = ["Tosh", "the", "don't", "漢字", "a\nb", "x,y.", "😀!", " ", "\n", "\x85", "12", "<|endoftext|>", "ÉT,é", "end.  "]
    counted = Counted()
    coder = subwords.Coder(counted, most=400)  # parts are forgotten now and then
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for text in texts:
        whole = real.encode(text, add_special_tokens=False)
        offsets = np.array(whole.offsets, np.int64).reshape(-1, 2)
        ids, start, end = coder.coded(text)
        assert ids.tolist() == whole.ids and end.tolist() == offsets[:, 1].tolist() and coder.count(text) == len(ids)
        assert start.tolist() == subwords.trimmed(text, offsets[:, 0], offsets[:, 1]).tolist()
    assert counted.coded < sum(map(len, texts)) / 2


@pytest.mark.parametrize("name", ["entity_swap", "augmented_epoch"])
def test_mentions_are_found_once(spark, name, monkeypatch):
    """Mentions, which come from a count of the texts that were split, are made once for all joins that read them."""
    from spanloom.plans import annotation

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    real = annotation.D.mentions
    monkeypatch.setattr(annotation.D, "mentions", lambda s, d: real(s, d).withColumn("mention", seen("mention")))
    sf = "/root/testdata/sf0.001"
    rows = annotation.D.gold(spark, sf).count()
    getattr(annotation, name)(spark, sf).collect()
    assert made.value == rows


@pytest.mark.parametrize("name", ["forbidden_transitions", "transition_log_conditional"])
def test_transitions_deal_no_tokens(spark, name):
    """Only counts of tags are shuffled: nothing is dealt by document, and texts are read once."""
    from spanloom.plans import catalog, registry  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and plan.count("Scan parquet") == 1
