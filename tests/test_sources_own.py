"""The library's own source and sink: every rejected line by name, ranges of any size, and commits that fail."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.sources import jsonlines, sink
from spanloom.sources.readers import InputError
from tests.test_more import NEGATIVE

GOOD = {"hash": "a", "text": "Ali Toshkentda", "entities": [{"label": "NAME", "start": 0, "end": 3}]}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(tmp_path, size):
    rng = random.Random(size)
    for text in ("", "\n", "a", "a\n", "\n\nb", "".join(rng.choice("ab\n") for _ in range(300)), "é" * 50 + "\n" + "x" * 200):
        path = tmp_path / "f.jsonl"
        path.write_text(text)
        raw = text.encode()
        got = [x for s in range(0, len(raw), size) for x in jsonlines.lines(jsonlines.Range(str(path), s, min(s + size, len(raw)), None))]
        want, at = [], 0
        for line in raw.split(b"\n") if not raw.endswith(b"\n") else raw.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == (want if raw else [])
        assert [jsonlines.line_number(str(path), at) for at, _ in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("name, bad", NEGATIVE)
def test_rejected_by_name(name, bad):
    assert jsonlines.checked(bad.encode(), False)[1] == name


def test_reader_limit_and_errors(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    rows = [GOOD | {"hash": f"h{k}", "more": [k]} for k in range(50)]
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows) + "broken\n" + json.dumps({"hash": "z"}) + "\n")
    with pytest.raises(InputError, match="line 51: json; line 52: text"):
        jsonlines.read_records(spark, str(path), range_bytes=300)
    got = jsonlines.read_records(spark, str(path), limit=50, range_bytes=300).orderBy("hash").collect()  # what is behind is never read
    assert len(got) == 50 and json.loads(got[0]["fields"])["more"] == [0] and got[0]["entities"][0]["label"] == "NAME"
    path.write_text("".join(json.dumps(r) + "\n" for r in [GOOD, GOOD]))
    with pytest.raises(InputError, match="repeated keys"):
        jsonlines.read_records(spark, str(path))
    path.write_text("")
    with pytest.raises(InputError, match="no records"):
        jsonlines.read_records(spark, str(path))
    path.write_text(json.dumps({"hash": "q", "text": "t"}) + "\n")
    assert jsonlines.read_records(spark, str(path)).first()["entities"] is None
    with pytest.raises(InputError, match="line 1: entities"):
        jsonlines.read_records(spark, str(path), require_entities=True)


def test_sink_commits_all_or_nothing(spark, tmp_path):
    out = str(tmp_path / "corpus")
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("tekst ’ "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 10, "holdout").otherwise("train").alias("split"))
    got = sink.write_committed(rows, out)
    assert {s: sum(x["rows"] for x in got if x["split"] == s) for s in ("train", "holdout")} == {"train": 90, "holdout": 10}
    read = lambda s: sorted(r["text"] for r in spark.read.json(f"{out}/{s}").collect())
    assert read("holdout") == sorted(f"tekst ’ {k}" for k in range(10)) and len(read("train")) == 90
    before = sorted(p.name for p in (tmp_path / "corpus").rglob("*") if p.is_file())

    @F.udf("string")
    def killed(text):
        if text.endswith("77"):
            raise RuntimeError("task lost")
        return text

    with pytest.raises(Exception, match="task lost"):
        sink.write_committed(rows.withColumn("text", killed("text")), out)
    assert sorted(p.name for p in (tmp_path / "corpus").rglob("*") if p.is_file()) == before
    assert len(sink.write_committed(rows.limit(5), out)) > len(got)
    again = sink.write_committed(rows.where("split = 'train'").limit(3), out, "overwrite")
    assert sum(x["rows"] for x in again) == 3 and len(read("train")) == 3
