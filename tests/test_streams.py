"""Streams with state: equal to the batch rule, across restarts, expiry and batches run again."""

import time

from pyspark.sql import functions as F

from spanloom.functions import digests
from spanloom.operators.seen import SeenState
from spanloom.streaming import state
from tests.test_corpus import one_loop, stream

ROWS = "seq long, source string, text string"


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{name}")


def read(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_first_copies_across_a_restart(spark, tmp_path):
    texts = ["One two", "one  TWO", "three", None, "ｏｎｅ two", "four", "Three"]
    (tmp_path / "in").mkdir()

    def run():
        rows = state.first_by_digest(read(spark, str(tmp_path / "in")))
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(300)

    write(spark, tmp_path / "in", [(k, "s", t) for k, t in enumerate(texts[:4])], "a")
    state.with_rocksdb(spark, run)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2]
    write(spark, tmp_path / "in", [(k, "s", t) for k, t in enumerate(texts) if k >= 4], "b")
    state.with_rocksdb(spark, run)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 5]


def test_least_of_each_digest_whatever_the_order_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = {}

    def each(rows, number):
        for r in rows.collect():
            got[r["digest"]] = min(r["seq"], got.get(r["digest"], r["seq"]))

    def run():
        rows = state.least_by_digest(read(spark, str(tmp_path / "in")))
        rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)

    write(spark, tmp_path / "in", [(5, "s", "x Y"), (6, "s", "z"), (7, "s", None)], "a")
    state.with_rocksdb(spark, run)
    write(spark, tmp_path / "in", [(2, "s", "X  y"), (8, "s", "Z"), (9, "s", "w")], "b")
    state.with_rocksdb(spark, run)
    assert sorted(got.values()) == [2, 6, 9]


def test_query_keeps_no_state_key_by_key(spark, monkeypatch):
    """The stateful operator is Spark's own: nothing is sent to a Python worker and back for a digest."""
    from spanloom.plans import catalog, registry  # noqa: F401

    monkeypatch.setattr(state, "FirstCopies", None)
    got = registry.QUERIES["stream_first_copies"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.distinct().count() > 0


def test_state_expires(spark, tmp_path):
    """Timers make another batch all the time, so the stream is stopped once it is some batches past the rows."""
    (tmp_path / "in").mkdir()
    got = []

    def run():
        want = len(got) + 1
        rows = state.first_by_digest(read(spark, str(tmp_path / "in")), ttl_ms=1500)
        sink = rows.writeStream.foreachBatch(lambda df, n: got.extend((n, r["seq"]) for r in df.collect()))
        query = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while time.time() < end and (len(got) < want or (query.lastProgress or {"batchId": 0})["batchId"] <= got[-1][0] + 1):
            time.sleep(0.3)
        query.stop()

    write(spark, tmp_path / "in", [(0, "s", "x"), (1, "s", "x")], "a")
    state.with_rocksdb(spark, run)
    time.sleep(2)
    write(spark, tmp_path / "in", [(2, "s", "x")], "b")
    state.with_rocksdb(spark, run)
    assert [seq for _, seq in got] == [0, 2]


def test_curated_stream_equals_the_batch_rule(spark, tmp_path):
    docs, barred = stream(21, 36)
    rows = [(k, d[0], d[4]) for k, d in enumerate(docs)]
    excluded = spark.createDataFrame([(barred,)], "t string").select(digests.normalized_digest("t").alias("digest"))
    quotas, order = {"s0": 2500}, ["s0", "s1", "s2", "s3"]
    (tmp_path / "in").mkdir()
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        source = read(spark, str(tmp_path / "in")).withColumnRenamed("text", "passage")
        state.curate(source, excluded, folder, checkpoint, order, quotas, 4).awaitTermination(300)

    # one source after the other, so that the stream's order is that of the rule; s0 in two batches
    first = [r for r in rows if r[1] == "s0"]
    for name, part in (("a", first[: len(first) // 2]), ("b", first[len(first) // 2 :])):
        write(spark, tmp_path / "in", part, name)
        run()
    write(spark, tmp_path / "in", [r for r in rows if r[1] != "s0"], "c")
    run()
    want = one_loop([(s, "f", k, None, t) for k, s, t in rows if t], {" ".join(barred.casefold().split())}, order, quotas, 4, 10**6, 10**6)
    got = {(r["source"], r["seq"]): (r["reason"], r["split"]) for r in spark.read.parquet(f"{folder}/decided").collect() if rows[r["seq"]][2]}
    assert got == {(s, k): v for (s, _, k, _), v in want.items()}
    texts = {r["seq"]: r["passage"] for r in spark.read.parquet(f"{folder}/text").collect()}
    assert texts == {k: rows[k][2] for (s, _, k, _), (_, split) in want.items() if split}
    # a batch that is run again registers and writes the same
    again = SeenState(spark, f"{folder}/state")
    assert again.progress()[0] == 3 and again.progress(2)[0] == 2 and set(again.progress(2)[1]) == set(order)


def test_query_equals_exact_dedup(spark):
    from spanloom.plans import catalog, registry  # noqa: F401

    got = registry.QUERIES["stream_first_copies"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = docs.select("doc_id", digests.normalized_digest("text").alias("d")).groupBy("d").agg(F.min("doc_id").alias("doc_id"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in first.where("d is not null").collect())
