"""Queries of subword tokens, of windows over them, and of exclusion through a Bloom filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import bloom, corpus, dedup, subwords
from spanloom.plans import derived as D
from spanloom.plans.curation import WORDS, norm, whole_corpus
from spanloom.plans.registry import query

#: ids of the vocabulary's end token, which opens and closes a window
END = 50256
SHAPE = subwords.Windows(512, 128, END, END)
#: words in a window of a text that must not be in the corpus
WIDTH = 13


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# no SQL for any of the three: the merges of the vocabulary are beyond it
@query("subword_windows")
def subword_windows(spark, d):
    """All windows of all texts: their tokens, the characters they span, and a digest of their ids."""
    rows = subwords.subword_windows(D.dealt(D.docs(spark, d).select("doc_id", "text")), vocabulary(), SHAPE)
    inner = lambda name, f: f(F.filter(name, lambda x, k: (k > 0) & (k < F.size(name) - 1)))
    return rows.select(
        "doc_id", "win", F.size("token").alias("n"), inner("start", F.array_min).alias("first"), inner("end", F.array_max).alias("last"),
        F.md5(F.array_join(F.col("token").cast("array<string>"), ",")).alias("digest"),
    )


@query("subword_labelled_windows")
def subword_labelled_windows(spark, d):
    """Training windows that hold a labelled token: their tags, special tokens included."""
    rows = subwords.labelled_windows(D.docs(spark, d), D.gold(spark, d), vocabulary(), SHAPE)
    labelled = F.size(F.filter("tag", lambda t: t > 0)).alias("labelled")
    return rows.select("doc_id", "win", F.size("tag").alias("n"), labelled, F.md5(F.array_join(F.col("tag").cast("array<string>"), ",")).alias("digest"))


@query("subword_calibration")
def subword_calibration(spark, d):
    """Characters for each subword token over the first 200 passages of the corpus."""
    built = whole_corpus(spark, d)
    first = built.decided.where("split = 'train'").select("seq").orderBy("seq").limit(200)
    texts = built.passages().join(F.broadcast(first), "seq").select("seq", F.col("passage").alias("text"))
    return corpus.calibrate(texts, "seq", tokens=subwords.token_counter(spark, vocabulary()))


def windows_sql(table: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(list_distinct(list_transform(range(0, greatest(len(w) - {WIDTH}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + {WIDTH}], ' ')))) AS s
    FROM (SELECT {key}, {WORDS.replace('{0}', norm())} AS w FROM {table})"""


@query(
    "bloom_clean_windows",
    f"""WITH d AS ({windows_sql('documents', 'doc_id')}), b AS (SELECT DISTINCT s FROM ({windows_sql('benchmark', 'text')}))
    SELECT doc_id, count(*) AS n_clean FROM d ANTI JOIN b USING (s) GROUP BY doc_id""",
)
def bloom_clean_windows(spark, d):
    """Windows of words of each document that are in no benchmark text."""
    windows = dedup.shingles(T.normalize(F.col("text")), WIDTH)
    barred = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(windows).alias("window"))
    return bloom.clean_counts(D.docs(spark, d).select("doc_id", windows.alias("windows")), "windows", barred, "window")
