"""The quality classifier where texts repeat, ids are null or equal, and there is little to learn from."""

import random

from spanloom.llm import weak

JUNK = "$$$ BUY NOW !!! #### *** $$$ CLICK %%% " * 20
DOCS = "doc_id long, text string"


def prose(rng):
    words = [a + b + c for a in ("th", "st", "r", "pl", "w") for b in "aeiou" for c in ("n", "r", "nd", "st", "m")]
    return ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 20))).capitalize() for _ in range(rng.randint(8, 14)))


def test_one_junk_text_ten_thousand_times(spark):
    for ids in (lambda k: k, lambda k: 7, lambda k: None):
        df = spark.createDataFrame([(ids(k), JUNK) for k in range(10_000)], DOCS).repartition(4)
        out = weak.quality_classifier(df, weak.fit(df))
        assert out.where("kept").count() == 0


def test_junk_as_nine_tenths_of_the_rows(spark):
    rng = random.Random(3)
    good = [prose(rng) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good)] + [(1000 + k, JUNK) for k in range(30_000)], DOCS)
    kept = {r["doc_id"] for r in weak.quality_classifier(df, weak.fit(df)).where("kept").collect()}
    assert not any(k >= 1000 for k in kept)
    assert len(kept) >= 195


def test_good_text_that_repeats_is_kept(spark):
    rng = random.Random(4)
    good = prose(rng)
    junk = ["!!! " * 30 + f"### $$$ {k} " * 30 for k in range(60)]
    df = spark.createDataFrame([(k, good) for k in range(8000)] + [(9000 + k, prose(rng)) for k in range(300)] + [(20_000 + k, t) for k, t in enumerate(junk)], DOCS)
    kept = {r["doc_id"] for r in weak.quality_classifier(df, weak.fit(df)).where("kept").collect()}
    assert set(range(8000)) <= kept and not any(k >= 20_000 for k in kept)
