"""Writers of JSON lines, CSV and small JSON reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.spans import LABELS


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are, null fields left out."""
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a header; floating numbers are rounded."""
    rounded = {c: F.round(c, digits) for c, t in rows.dtypes if t in ("double", "float")}
    rows.withColumns(rounded).write.option("header", True).csv(path)


def metrics_json(rows: DataFrame, records: int, scope: str = "scope") -> str:
    """The few rows of an evaluation as one indented JSON document."""
    by = {r[scope]: {k: v for k, v in r.asDict().items() if k != scope and v is not None} for r in rows.collect()}
    micro, macro = by.pop("micro"), by.pop("macro")
    return json.dumps({"schema_version": 1, "matching": "exact", "records": records, "by_label": by, "micro": micro, "macro": macro}, indent=2, ensure_ascii=False)


def predictions(records: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, entities)`` with sorted spans; records without spans get an empty array."""
    one = F.array_sort(F.collect_list(F.struct("start", "end", "label")))
    per = spans.groupBy(key).agg(one.alias("s"))
    shaped = F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end")))
    empty = F.array().cast("array<struct<label:string,start:bigint,end:bigint>>")
    return records.select(key).join(per, key, "left").select(key, F.coalesce(shaped, empty).alias("entities"))


def rendered(rows: DataFrame, digits: int = 4) -> str:
    """The few rows of a report as an aligned text table: numbers to the right, null as a dash."""
    def cell(x) -> str:
        return "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    table = [list(map(cell, r)) for r in rows.collect()]
    right = [t not in ("string", "boolean") for _, t in rows.dtypes]
    width = [max(map(len, column)) for column in zip(rows.columns, *table)]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, width, right)).rstrip()
    return "\n".join([line(rows.columns), *map(line, table)])


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: list[str] | None = None, settings: dict | None = None) -> DataFrame:
    """The Parquet table of these inputs and settings below ``path``, made and written first where there is none.

    The table's folder is named by the settings and by path, size and time of change of every input file, so a
    changed input or setting makes a table of its own instead of reusing an old one. A table counts once it is written whole.
    """
    marks = []
    for place in inputs or []:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place).select("path", "length", F.col("modificationTime").cast("string"))
        marks += [tuple(r) for r in files.orderBy("path").collect()]  # names, sizes and times of the files, which the driver lists anyway
    key = hashlib.sha256(json.dumps([marks, settings or {}], sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{path.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def contract(text: Column, entities: Column) -> Column:
    """The entities as the contract has them: label, start and end only, known labels inside the text, sorted, each once."""
    fine = F.filter(entities, lambda s: s["label"].isin(*LABELS) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
    order = F.array_sort(F.array_distinct(F.transform(fine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))))
    return F.transform(order, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
