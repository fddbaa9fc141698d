"""Strict JSON lines as a data source of its own: ``spark.read.format("strict_jsonl")``.

Files are planned as byte ranges; a range holds the lines that begin in it, so every line is read
by one task, and tasks say where in the file each line begins. With ``limit`` the plan ends at the range in
which the last wanted line is, found by counting line ends from the front: later lines are never read,
so what is wrong with them does not matter. Records are checked one by one where they are read;
keys that repeat are found across the cluster by ``read_records``, which names what is wrong.

Any file system that ``pyarrow.fs`` can open by URI will do; files are read in pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.operators.spans import LABELS
from spanloom.sources.readers import InputError

SCHEMA = "file string, at long, hash string, text string, entities array<struct<label:string,start:int,end:int>>, fields string, error string"
PIECE = 1 << 20


class Range(InputPartition):
    """Lines that begin at ``start`` or later and before ``stop``, ``most`` of them at most (None: all)."""

    def __init__(self, path: str, start: int, stop: int, most: int | None) -> None:
        self.path, self.start, self.stop, self.most = path, start, stop, most


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes below ``path``, in name order; hidden ones are left out."""
    system, place = opened(path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "._")


def lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """``(first byte, line)`` of a range's lines without their ends."""
    system, place = opened(part.path)
    left = part.most
    with system.open_input_file(place) as f:
        at, held = part.start, b""
        if at:  # a line that began before belongs to another range
            f.seek(at - 1)
            skip = f.read(1) != b"\n"
            while skip and (piece := f.read(PIECE)):
                end = piece.find(b"\n")
                if end >= 0:
                    at, skip = at + end + 1, False
                    held = piece[end + 1 :]
                else:
                    at += len(piece)
            if skip:
                return
        parts, last = [held], False
        while at < part.stop and (left is None or left > 0):
            end = parts[-1].find(b"\n")
            if end < 0 and not last:
                piece = f.read(PIECE)
                last = not piece
                parts.append(piece)
                continue
            line = b"".join([*parts[:-1], parts[-1][:end] if end >= 0 else parts[-1]])
            if last and not line and end < 0:
                return
            yield at, line
            at += len(line) + 1
            parts = [parts[-1][end + 1 :]] if end >= 0 else [b""]
            if left is not None:
                left -= 1


def whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def checked(line: bytes, require_entities: bool) -> tuple[dict | None, str | None]:
    """The record of a line, and the name of the first rule that it breaks.

    Names: empty, json, key, text, entities, label, offset, duplicate, overlap.
    """
    if not line.strip():
        return None, "empty"
    try:
        record = json.loads(line)
    except ValueError:
        return None, "json"
    if not isinstance(record, dict):
        return None, "json"
    if not isinstance(record.get("hash"), str) or not record["hash"]:
        return record, "key"
    if not isinstance(record.get("text"), str):
        return record, "text"
    spans = record.get("entities")
    if spans is None:
        return record, "entities" if require_entities else None
    if not isinstance(spans, list) or not all(isinstance(s, dict) for s in spans):
        return record, "entities"
    if any(s.get("label") not in LABELS for s in spans):
        return record, "label"
    size = len(record["text"])
    if not all(whole(s.get("start")) and whole(s.get("end")) and 0 <= s["start"] < s["end"] <= size for s in spans):
        return record, "offset"
    order = sorted((s["start"], s["end"], s["label"]) for s in spans)
    if len(set(order)) < len(order):
        return record, "duplicate"
    return record, "overlap" if any(b[0] < a[1] for a, b in zip(order, order[1:])) else None


class StrictReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit = options["path"], int(options["limit"]) if "limit" in options else None
        self.size = int(options.get("rangebytes", 64 << 20))
        self.require = str(options.get("requireentities", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        out, left = [], self.limit
        for path, size in files(self.path):
            for start in range(0, size, self.size):
                if left is not None and left <= 0:
                    return out
                part = Range(path, start, min(start + self.size, size), left)
                if left is not None:
                    left -= sum(1 for _ in lines(part))
                out.append(part)
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        for at, line in lines(partition):
            record, error = checked(line, self.require)
            spans = [(s["label"], s["start"], s["end"]) for s in record.get("entities") or []] if error is None else None
            text = lambda k: record[k] if record and isinstance(record.get(k), str) else None
            fields = json.dumps(record, ensure_ascii=False) if record is not None else None
            yield partition.path, at, text("hash"), text("text"), spans if error is None and record.get("entities") is not None else None, fields, error


class StrictJsonLines(DataSource):
    """Options: path, limit, rangeBytes, requireEntities."""

    @classmethod
    def name(cls) -> str:
        return "strict_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StrictReader:
        return StrictReader({k.lower(): v for k, v in self.options.items()})


def line_number(path: str, at: int) -> int:
    """From 1: the line ends before a byte, counted in pieces."""
    system, place = opened(path)
    n = 1
    with system.open_input_file(place) as f:
        while at > 0 and (piece := f.read(min(PIECE, at))):
            n, at = n + piece.count(b"\n"), at - len(piece)
    return n


def read_records(spark: SparkSession, path: str, limit: int | None = None, require_entities: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """``(hash, text, entities, fields)`` of checked lines; the first broken ones are named in an ``InputError``.

    One pass counts errors and keys. Only a broken input's files are looked at again, up to
    the lines that are named.
    """
    spark.dataSource.register(StrictJsonLines)
    reader = spark.read.format("strict_jsonl").option("path", path).option("rangeBytes", range_bytes).option("requireEntities", require_entities)
    rows = (reader if limit is None else reader.option("limit", limit)).load()
    per = rows.groupBy("hash").agg(F.count("*").alias("n"), F.count("error").alias("bad"))
    n, bad, twice = per.agg(F.sum("n"), F.sum("bad"), F.count_if((F.col("n") > 1) & (F.col("bad") == 0))).first()
    if bad:
        few = rows.where("error is not null").orderBy("file", "at").limit(5).select("file", "at", "error").collect()
        raise InputError("; ".join(f"line {line_number(r['file'], r['at'])}: {r['error']}" for r in few))
    if twice:
        raise InputError(f"repeated keys: {[r['hash'] for r in per.where('n > 1').orderBy('hash').limit(5).collect()]}")
    if not n:
        raise InputError("no records")
    return rows.select("hash", "text", "entities", "fields")
