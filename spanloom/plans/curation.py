"""Queries of corpus curation: filters, duplicates, funnel, quotas and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.digests import normalized_digest
from spanloom.operators import corpus, dedup, passages
from spanloom.plans import derived as D
from spanloom.plans.registry import query
from spanloom.sources import readers


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


APOS = q(T.APOSTROPHES)
NORM = "trim(regexp_replace(translate(replace(lower({0}), 'ß', 'ss'), " + APOS + ", " + q("'" * len(T.APOSTROPHES)) + r"), '[\s\x{00A0}]+', ' ', 'g'))"
DIGEST = "md5(" + NORM + ")"


def norm(x: str = "text") -> str:
    return NORM.replace("{0}", x)


def dig(x: str = "text") -> str:
    return DIGEST.replace("{0}", x)


BUCKET = "CASE WHEN length(text) < 200 THEN '<200' WHEN length(text) < 1000 THEN '200-999' WHEN length(text) < 3000 THEN '1000-2999' ELSE '>=3000' END"
LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
ALPHABET = LETTERS + r" >= 0.4 * length(text) AND regexp_matches(text, '[\x{0400}-\x{04FF}A-Za-z]')"
WORDS = r"regexp_extract_all({0}, '[^\s\x{00A0}]+')"
NOISY = rf"len(list_filter({WORDS}, lambda w: regexp_matches(w, '{T.MIXED}|{T.LETTER_DIGIT}')))"
SINGLE = rf"len(list_filter({WORDS}, lambda w: regexp_matches(w, '{T.SINGLE}')))"


def noise(x: str = "text") -> str:
    w = WORDS.replace("{0}", x)
    return f"CASE WHEN len({w}) = 0 THEN 1.0::DOUBLE ELSE {NOISY.replace('{0}', x)}::DOUBLE / len({w}) END"


def single(x: str = "text") -> str:
    w = WORDS.replace("{0}", x)
    return f"CASE WHEN len({w}) = 0 THEN 1.0::DOUBLE ELSE {SINGLE.replace('{0}', x)}::DOUBLE / len({w}) END"


@query("length_bucket_hist", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def length_bucket_hist(spark, d):
    return D.docs(spark, d).groupBy(T.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("min_length_truncate", "SELECT doc_id, length(substr(text, 1, 5000)) AS n, md5(substr(text, 1, 5000)) AS digest FROM documents WHERE length(text) >= 200")
def min_length_truncate(spark, d):
    cut = passages.truncated(F.col("text"), 5000)
    return D.docs(spark, d).where(F.length("text") >= 200).select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


@query("letter_ratio_filter", f"SELECT doc_id, {LETTERS}::BIGINT AS letters, {ALPHABET} AS ok FROM documents")
def letter_ratio_filter(spark, d):
    return D.docs(spark, d).select("doc_id", T.letters(F.col("text")).cast("long").alias("letters"), T.alphabet_ok(F.col("text")).alias("ok"))


@query("ocr_noise_flags", f"SELECT doc_id, round({noise()}, 6) AS noise, round({single()}, 6) AS single, {noise()} > 0.01 OR {single()} > 0.06 AS rejected FROM documents")
def ocr_noise_flags(spark, d):
    counts = T.ocr_counts(F.col("text"))
    n, s = T.ocr_shares({k: F.col(k) for k in counts})
    return D.docs(spark, d).withColumns(counts).select("doc_id", F.round(n, 6).alias("noise"), F.round(s, 6).alias("single"), ((n > 0.01) | (s > 0.06)).alias("rejected"))


SCRIPT = r"CASE WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') AND regexp_matches(text, '[A-Za-z]') THEN 'both' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'cyr' ELSE 'lat' END"


@query("script_class", f"SELECT {SCRIPT} AS script, lang, count(*) AS n FROM documents GROUP BY ALL")
def script_class(spark, d):
    return D.docs(spark, d).groupBy(T.script_of(F.col("text")).alias("script"), "lang").agg(F.count("*").alias("n"))


def _language_sql() -> str:
    cyr, lat = r"regexp_matches(text, '[\x{0400}-\x{04FF}]')", "regexp_matches(text, '[A-Za-z]')"
    names = list(T.STOP_WORDS)
    shares = []
    for k in names:
        stop = "[" + ", ".join(q(w) for w in T.STOP_WORDS[k]) + "]"
        share = f"CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains({stop}, x)))::DOUBLE / len(w) END"
        if k == "uz-cyrl":
            share = f"{share} + CASE WHEN regexp_matches(text, '[ўқғҳЎҚҒҲ]') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"
        shares.append(f"CASE WHEN {cyr if k in ('uz-cyrl', 'ru') else lat} THEN {share} ELSE 0.0::DOUBLE END AS s{len(shares)}")
    top = f"greatest({', '.join(f's{k}' for k in range(len(names)))})"
    cases = " ".join(f"WHEN s{k} = {top} THEN '{n}'" for k, n in enumerate(names))
    return rf"""SELECT doc_id, CASE WHEN len(w) = 0 OR {top} < 0.03 THEN 'undetermined' {cases} END AS language
      FROM (SELECT *, {', '.join(shares)} FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents))"""


@query("stopword_language", _language_sql())
def stopword_language(spark, d):
    return D.docs(spark, d).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("normalize_digest", f"SELECT doc_id, {dig()} AS digest, length({norm()})::BIGINT AS n FROM documents")
def normalize_digest(spark, d):
    x = T.normalize(F.col("text"))
    return D.docs(spark, d).select("doc_id", T.digest(x).alias("digest"), F.length(x).cast("long").alias("n"))


@query("normalize_full")
def normalize_full(spark, d):
    return D.docs(spark, d).select("doc_id", T.digest(T.normalize_full("text")).alias("digest"))


def keyed(spark, d):
    return D.docs(spark, d).select(F.col("doc_id").alias("seq"), "text", "source", "n_chars", T.digest(T.normalize(F.col("text"))).alias("digest"))


@query("exact_dedup", f"SELECT doc_id AS seq, doc_id > min(doc_id) OVER (PARTITION BY {dig()}) AS is_dup FROM documents")
def exact_dedup(spark, d):
    return dedup.exact_duplicates(keyed(spark, d)).select("seq", "is_dup")


@query(
    "paragraph_dedup",
    rf"""WITH p AS (SELECT doc_id AS seq, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+\z', '', 'g') AS paragraph FROM documents),
    k AS (SELECT seq, {dig('paragraph')} AS key FROM p WHERE length(paragraph) > 80),
    f AS (SELECT *, min(seq) OVER (PARTITION BY key) AS first FROM k)
    SELECT seq, coalesce(n, 0) AS n_long, coalesce(all_seen, FALSE) AS paragraph_dup FROM (SELECT DISTINCT seq FROM p)
    LEFT JOIN (SELECT seq, count(*) AS n, bool_and(first < seq) AS all_seen FROM f GROUP BY seq) USING (seq)""",
)
def paragraph_dedup(spark, d):
    rows = D.docs(spark, d).select(F.col("doc_id").alias("seq"), F.col("text").alias("passage"))
    return dedup.paragraph_duplicates(passages.paragraphs(rows, pattern="\n"))


SHINGLES = rf"""sh AS (SELECT seq, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s
  FROM (SELECT doc_id AS seq, {WORDS.replace('{0}', norm())} AS w FROM documents))"""
MASKS = dedup.masks()
SIGNATURE = (
    SHINGLES
    + ", h AS (SELECT seq, ('0x' || substr(md5(s), 1, 15))::BIGINT AS h FROM sh), sig AS (SELECT seq, ["
    + ", ".join(f"min(xor(h, {m}::BIGINT))" for m in MASKS)
    + "] AS signature FROM h GROUP BY seq)"
)
BANDS = (
    "keys AS (SELECT seq, unnest(range(0, 8)) AS band, unnest(["
    + ", ".join(f"md5(array_to_string(signature[{4 * b + 1} : {4 * b + 4}], ','))" for b in range(8))
    + "]) AS key FROM sig)"
)


@query("shingle_counts", f"WITH {SHINGLES} SELECT seq, count(*) AS n FROM sh GROUP BY seq")
def shingle_counts(spark, d):
    rows = D.docs(spark, d).select(F.col("doc_id").alias("seq"), F.size(dedup.shingles(T.normalize(F.col("text")))).cast("long").alias("n"))
    return rows


def signatures(spark, d):
    rows = D.dealt(D.docs(spark, d).select(F.col("doc_id").alias("seq"), "text"))
    return dedup.minhash(rows, T.normalize(F.col("text")))


@query("minhash_signature", f"WITH {SIGNATURE} SELECT seq, md5(array_to_string(signature, ',')) AS signature FROM sig")
def minhash_signature(spark, d):
    return signatures(spark, d).select("seq", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature"))


@query("lsh_band_keys", f"WITH {SIGNATURE}, {BANDS} SELECT seq, band::INTEGER AS band, key FROM keys")
def lsh_band_keys(spark, d):
    return dedup.band_keys(signatures(spark, d))


@query("lsh_bucket_links", f"WITH {SIGNATURE}, {BANDS} SELECT DISTINCT a, seq AS b FROM (SELECT seq, min(seq) OVER (PARTITION BY band, key) AS a FROM keys) WHERE a < seq")
def lsh_bucket_links(spark, d):
    return dedup.bucket_links(dedup.band_keys(signatures(spark, d)))


CLASSES = "reps AS (SELECT seq, min(seq) OVER (PARTITION BY signature) AS rep FROM sig), own AS (SELECT k.* FROM keys k JOIN reps r ON r.seq = k.seq AND r.rep = r.seq)"


@query("lsh_signature_classes", f"WITH {SIGNATURE} SELECT seq, min(seq) OVER (PARTITION BY signature) AS rep FROM sig")
def lsh_signature_classes(spark, d):
    return dedup.signature_classes(signatures(spark, d))


@query("lsh_candidate_pairs", f"WITH {SIGNATURE}, {BANDS}, {CLASSES} SELECT DISTINCT a.seq AS a, b.seq AS b FROM own a JOIN own b ON a.band = b.band AND a.key = b.key AND a.seq < b.seq")
def lsh_candidate_pairs(spark, d):
    """Pairs of representatives of equal signatures; the membership is ``lsh_signature_classes``."""
    return dedup.candidate_pairs(signatures(spark, d))


@query(
    "near_dedup_first_in_bucket",
    f"WITH {SIGNATURE}, {BANDS} SELECT seq, bool_or(first < seq) AS near_dup FROM (SELECT seq, min(seq) OVER (PARTITION BY band, key) AS first FROM keys) GROUP BY seq",
)
def near_dedup_first_in_bucket(spark, d):
    return dedup.first_in_bucket(dedup.band_keys(signatures(spark, d)))


@query("near_dedup_greedy")
def near_dedup_greedy(spark, d):
    return dedup.greedy_near_duplicates(dedup.band_keys(signatures(spark, d)))


@query("contamination_anti_join", f"SELECT doc_id AS seq FROM documents WHERE {dig()} NOT IN (SELECT {dig()} FROM benchmark)")
def contamination_anti_join(spark, d):
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(T.digest(T.normalize(F.col("text"))).alias("digest"))
    return dedup.without(keyed(spark, d), bench).select("seq")


REASON = f"""CASE WHEN length(text) < 200 THEN 'short' WHEN NOT ({ALPHABET}) THEN 'alphabet' WHEN {noise()} > 0.01 OR {single()} > 0.06 THEN 'ocr'
  WHEN {dig()} IN (SELECT {dig()} FROM benchmark) THEN 'excluded' END"""
FUNNEL = f"""r AS (SELECT doc_id AS seq, text, source, n_chars, {dig()} AS digest, {REASON} AS early FROM documents),
  funnel AS (SELECT *, coalesce(early, CASE WHEN seq > min(seq) FILTER (early IS NULL) OVER (PARTITION BY digest) THEN 'exact' END, 'accepted') AS reason FROM r)"""


def funnel(spark, d):
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(T.digest(T.normalize(F.col("text"))).alias("digest"))
    rows = D.docs(spark, d).select(F.col("doc_id").alias("seq"), F.col("text").alias("passage"), "source", "n_chars")
    return corpus.funnel(rows, bench)


@query("drop_reason_funnel", f"WITH {FUNNEL} SELECT reason, count(*) AS n FROM funnel GROUP BY reason")
def drop_reason_funnel(spark, d):
    return funnel(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def accepted(spark, d):
    return funnel(spark, d).where("reason = 'accepted'")


@query(
    "source_quota_cut",
    f"""WITH {FUNNEL}, a AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
      row_number() OVER (PARTITION BY source ORDER BY seq) AS nth FROM funnel WHERE reason = 'accepted')
    SELECT seq, source, used FROM a WHERE nth = 1 OR used < 40000""",
)
def source_quota_cut(spark, d):
    return corpus.quota_cut(accepted(spark, d), 40_000).select("seq", "source", "used")


@query("holdout_split", f"WITH {FUNNEL} SELECT seq FROM funnel WHERE reason = 'accepted' ORDER BY seq LIMIT 100")
def holdout_split(spark, d):
    return corpus.holdout(accepted(spark, d), 100).select("seq")


def whole_corpus(spark, d, quota=None, held=0, limit=8000):
    """The corpus of ``documents``, whose sources stand for the sources of the stream, and the texts of ``benchmark`` excluded."""
    rows = D.docs(spark, d).select("source", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), "doc_id", "text")
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(normalized_digest("text").alias("digest"))
    rows = D.dealt(rows)
    sources = [r["source"] for r in rows.select("source").where("source is not null").distinct().orderBy("source").collect()]  # one row a source
    return corpus.build(rows, bench, sources, quota and dict.fromkeys(sources, quota), held, limit)


# no SQL: the greedy near rule is beyond it
@query("drop_reason_whole_funnel")
def drop_reason_whole_funnel(spark, d):
    return whole_corpus(spark, d).decided.groupBy("reason").agg(F.count("*").alias("n"))


@query("source_quota_cut_whole_funnel")
def source_quota_cut_whole_funnel(spark, d):
    return whole_corpus(spark, d, 40_000).decided.where("split = 'train'").select("source", "doc_id", "passage_no", "n_chars")


@query("holdout_split_whole_funnel")
def holdout_split_whole_funnel(spark, d):
    return whole_corpus(spark, d, held=100).decided.where("split = 'holdout'").select("source", "doc_id", "passage_no", "n_chars")


@query("corpus_build")
def corpus_build(spark, d):
    """Split, six tests, paragraph and near rules, quotas of sources, holdout; without SQL for the greedy near rule."""
    decided = whole_corpus(spark, d, 400_000, 100, 2000).decided
    return decided.select("source", "shard", "row", "doc_id", "passage_no", "n_chars", "script", "reason", "split")


@query("script_histogram", f"SELECT {SCRIPT} AS script, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def script_histogram(spark, d):
    return corpus.scripts(D.docs(spark, d))


@query(
    "source_share_manifest",
    """SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / (SELECT sum(length(text)) FROM documents), 4) AS share,
    floor(sum(length(text)) / 2.6::DOUBLE)::BIGINT AS tokens FROM documents GROUP BY source""",
)
def source_share_manifest(spark, d):
    return corpus.manifest(D.docs(spark, d))


@query(
    "chars_per_token_calibration",
    f"""WITH s AS (SELECT substr(text, 1, 20000) AS t FROM documents ORDER BY doc_id LIMIT 200)
    SELECT sum(length(t))::BIGINT AS chars, sum(len({WORDS.replace('{0}', 't')}))::BIGINT AS tokens, round(sum(length(t)) / sum(len({WORDS.replace('{0}', 't')})), 6) AS chars_per_token FROM s""",
)
def chars_per_token_calibration(spark, d):
    return corpus.calibrate(D.docs(spark, d), "doc_id")


@query("step_budget", "SELECT source, greatest(1000, floor(sum(n_chars) * 100 / (4 * 2 * 512)))::BIGINT AS steps FROM documents GROUP BY source")
def step_budget(spark, d):
    return D.docs(spark, d).groupBy("source").agg(corpus.step_budget(F.sum("n_chars") * 100, 4, 2).alias("steps"))


@query("shard_scan", "SELECT count(*) AS rows, sum(length(text))::BIGINT AS chars, min(doc_id) AS low FROM documents WHERE text IS NOT NULL AND text <> ''")
def shard_scan(spark, d):
    rows = readers.read_shards(spark, [f"{d}/documents.parquet"])
    low = D.docs(spark, d).where("text is not null and text <> ''").agg(F.min("doc_id").alias("low"))
    return rows.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).crossJoin(F.broadcast(low))  # one row each


@query("shard_assignment", "SELECT doc_id % 8 AS shard, count(*) AS n FROM documents GROUP BY ALL")
def shard_assignment(spark, d):
    return passages.sharded(D.docs(spark, d), "doc_id", 8).groupBy("shard").agg(F.count("*").alias("n"))


@query("split_passages")
def split_passages(spark, d):
    return passages.split_passages(D.docs(spark, d).select("doc_id", "text"), 2000)


@query(
    "paragraph_quantifiers",
    r"""SELECT doc_id, bool_or(length(p) > 80) AS any_long, bool_and(length(p) > 80) AS all_long, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id""",
)
def paragraph_quantifiers(spark, d):
    lines = F.split("text", "\n")
    long = lambda p: F.length(p) > 80
    return D.docs(spark, d).select(
        "doc_id", F.exists(lines, long).alias("any_long"), F.forall(lines, long).alias("all_long"), F.size(lines).cast("long").alias("n")
    )
