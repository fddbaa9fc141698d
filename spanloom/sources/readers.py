"""Readers of corpora, annotated records, runs and sidecar files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = "struct<label:string,start:int,end:int>"
RECORD = f"hash string, text string, entities array<{SPAN}>"
TEXT_COLUMNS = ("text", "content", "body")


class InputError(ValueError):
    """What is wrong with an input, with the lines or keys concerned."""


def read_lenient(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines; blank lines are skipped and unknown fields dropped."""
    return spark.read.schema(schema).json(path)


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its parsed record, all of its ``fields``, its place, and ``error``, null if it has none.

    Errors by name: empty, json, key, text, entities, label, offset, duplicate, overlap.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    kind = lambda path: F.schema_of_variant(F.try_variant_get("fields", path, "variant"))
    rows = lines.withColumn("fields", F.try_parse_json("value")).withColumn("record", F.from_json("value", RECORD))
    raw = F.from_json("value", "entities string").getField("entities")
    rows = rows.withColumn("items", F.from_json(raw, "array<struct<label:variant,start:variant,end:variant>>"))
    whole = lambda x: F.coalesce(F.schema_of_variant(x) == "BIGINT", F.lit(False))
    bad_type = F.exists("items", lambda s: s.isNull() | ~whole(s["start"]) | ~whole(s["end"]))
    spans = F.array_sort(F.transform("record.entities", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    bad_offset = bad_type | F.exists(
        "record.entities", lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length("record.text"))
    )
    bad_label = F.exists("record.entities", lambda s: s["label"].isNull() | ~s["label"].isin("ORG", "NAME", "GEO"))
    overlap = F.exists(
        F.arrays_zip(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))).alias("a"), F.slice(spans, 2, F.size(spans)).alias("b")), lambda x: x["b"]["start"] < x["a"]["end"]
    )
    none = F.lit(False)
    error = (
        F.when(F.trim("value") == "", "empty")
        .when(F.col("fields").isNull() | ~F.startswith(F.schema_of_variant("fields"), F.lit("OBJECT")), "json")
        .when(F.coalesce(kind("$.hash") != "STRING", F.lit(True)) | (F.length("record.hash") == 0), "key")
        .when(F.coalesce(kind("$.text") != "STRING", F.lit(True)), "text")
        .when(raw.isNotNull() & (F.col("items").isNull() | ~F.startswith(kind("$.entities"), F.lit("ARRAY"))), "entities")
        .when(F.coalesce(bad_label, none), "label")
        .when(F.coalesce(bad_offset, none), "offset")
        .when(F.coalesce(F.size(spans) > F.size(F.array_distinct(spans)), none), "duplicate")
        .when(F.coalesce(overlap, none), "overlap")
    )
    return rows.select("file", "block", "place", "record", "fields", error.alias("error"))


def _numbered(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` rows of ``lines`` with ``line``, the number in their file, from 1."""
    chunks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select("file", "block", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return chosen.join(base, ["file", "block"]).withColumn("line", F.col("base") + F.col("place") - F.col("low") + 1)


def read_strict(spark: SparkSession, path: str, require_entities: bool = False, limit: int | None = None, all_fields: bool = False) -> DataFrame:
    """JSON lines with every rule checked; the first broken ones are named in an ``InputError``.

    One pass counts errors and keys; only a broken input is read again, to name its lines.
    ``limit`` keeps the first records; later lines are then not checked. ``all_fields`` adds
    every field of a record as the variant ``fields``.
    """
    lines = parsed_lines(spark, path)
    if limit is not None:
        lines = lines.orderBy("file", "block", "place").limit(limit)
    lines = lines.withColumn("error", F.coalesce("error", F.when(F.lit(require_entities) & F.col("record.entities").isNull(), "entities")))
    per = lines.groupBy("record.hash").agg(F.count("*").alias("n"), F.count("error").alias("bad"))
    n, bad, twice = per.agg(F.sum("n"), F.sum("bad"), F.count_if((F.col("n") > 1) & (F.col("bad") == 0))).first()
    if bad:
        few = lines.where("error is not null").orderBy("file", "block", "place").limit(5).select("file", "block", "place", "error")
        named = _numbered(parsed_lines(spark, path), few).orderBy("file", "line").collect()
        raise InputError("; ".join(f"line {r['line']}: {r['error']}" for r in named))
    if twice:
        raise InputError(f"repeated keys: {[r['hash'] for r in per.where('n > 1').orderBy('hash').limit(5).collect()]}")
    if not n:
        raise InputError("no records")
    return lines.select("record.*", *(["fields"] if all_fields else []))


def text_column(columns: list[str]) -> str:
    """The first column named like a text, whatever its case; else the first column."""
    return next((c for c in columns if c.lower() in TEXT_COLUMNS), columns[0])


def files_below(spark: SparkSession, root: str, name: str = "*.parquet") -> list[str]:
    """Paths of the files below ``root`` in name order; only names reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return sorted(r["path"] for r in files.select("path").collect())


def split_shards(paths: list[str], split: str, root: str = "") -> list[str]:
    """The shards of a split, ``.../{split}-*`` or ``{split}/...`` below ``root``, in name order."""
    below = lambda p: p.split(root, 1)[-1].lstrip("/") if root else p
    return sorted(p for p in paths if p.endswith(".parquet") and (f"/{split}-" in f"/{below(p)}" or below(p).startswith(f"{split}/")))


def read_shards(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """``(shard, row, text)`` of the first ``limit`` files in name order; empty texts are skipped."""
    chosen = sorted(paths)[:limit]
    if not chosen:
        raise InputError("no shards")
    rows = spark.read.parquet(*chosen)
    text = F.col(text_column(rows.columns)).cast("string")
    return rows.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), text.alias("text")).where("text is not null and text <> ''")


@dataclass(frozen=True)
class Source:
    """A named corpus: where its shards are, which split is read, and whether it counts as foreign."""

    root: str
    split: str = "train"
    foreign: bool = False


def read_sources(spark: SparkSession, registry: dict[str, Source], chosen: list[tuple[str, int | None]]) -> DataFrame:
    """``(source, ordinal, shard, row, text)`` of the chosen sources, each with its number of shards, in the order given."""
    out = None
    for ordinal, (name, limit) in enumerate(chosen):
        source = registry[name]
        paths = split_shards(files_below(spark, source.root), source.split, source.root)
        if not paths:
            raise InputError(f"{name}: no shards of split {source.split}")
        rows = read_shards(spark, paths, limit).select(F.lit(name).alias("source"), F.lit(ordinal).alias("ordinal"), "shard", "row", "text")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise InputError("no sources")
    return out


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``(run, metrics, config)`` of every directory with ``dev_metrics.json``; the config may be missing."""

    def one(name: str, alias: str) -> DataFrame:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
        return files.select(parent_name(F.col("_metadata.file_path")).alias("run"), F.try_parse_json("value").alias(alias))

    metrics = one("dev_metrics.json", "metrics")
    return metrics.join(one("run_config.json", "config"), "run", "left")


def run_table(runs: DataFrame) -> DataFrame:
    """One row for each run with its settings and scores."""
    get = lambda c, p, t: F.try_variant_get(c, p, t)
    return runs.select(
        "run", get("config", "$.model_name", "string").alias("model"), get("config", "$.tag_scheme", "string").alias("scheme"),
        get("metrics", "$.micro.precision", "double").alias("precision"), get("metrics", "$.micro.recall", "double").alias("recall"),
        get("metrics", "$.micro.f1", "double").alias("micro_f1"), get("metrics", "$.macro.f1", "double").alias("macro_f1"),
        get("config", "$.total_seconds", "double").alias("seconds"),
    )


def resolve_run(path: str) -> tuple[str, str]:
    """``(name, file)`` of a run: a directory holds ``dev_predictions.jsonl`` and names it, a file's stem names itself."""
    path = path.rstrip("/")
    folder, _, last = path.rpartition("/")
    stem, dot, _ = last.rpartition(".")
    if last == "dev_predictions.jsonl":
        return folder.rpartition("/")[2], path
    return (stem, path) if dot and stem else (last, f"{path}/dev_predictions.jsonl")


def read_predictions(spark: SparkSession, paths: list[str] | dict[str, str]) -> DataFrame:
    """``(run, hash, label, start, end)`` of several runs' JSON lines; a later run of a name replaces an earlier one."""
    named = paths if isinstance(paths, dict) else dict(map(resolve_run, paths))
    out = None
    for run, path in named.items():
        rows = read_lenient(spark, path).select(F.lit(run).alias("run"), "hash", F.explode("entities").alias("s")).select("run", "hash", "s.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise InputError("no runs")
    return out


def read_sidecar(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A small JSON document of a model's folder, or of the one above it, as one variant ``value``."""
    folder = folder.rstrip("/")
    for place in (folder, folder.rpartition("/")[0]):
        try:
            return spark.read.option("wholetext", True).text(f"{place}/{name}").select(F.try_parse_json("value").alias("value"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise InputError(f"no {name} in {folder} or above it")
