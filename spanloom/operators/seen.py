"""Incremental duplicate state: what earlier batches have registered, probed and extended by later ones.

Three sets only grow: digests of accepted passages, digests of paragraphs, and band keys of
accepted passages. They are kept as bucketed tables in a folder that all executors share, so that
a batch's few distinct keys move to the buckets and the tables stay where they are. Every
row carries the number of its batch, and a batch probes earlier batches only: a batch that
broke off may be run again, and a new session opens the folder and goes on.

``settle`` decides a batch rule for rule as a loop over its rows would; see there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.checkpoint import cut, shared_folder
from spanloom.operators.running import running_totals
from spanloom.operators.dedup import greedy_near_duplicates
from spanloom.operators.joins import firsts, joined_by_count

KINDS = {"digest": "string", "paragraph": "string", "band": "string"}


class SeenState:
    """The three tables and the list of finished batches, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = (folder or f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}").rstrip("/")
        # tables are named by their folder: two states of a session do not meet
        self.prefix = f"seen_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"
        for kind, type_ in KINDS.items():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.prefix}_{kind} (key {type_}, batch INT) USING parquet "
                f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.folder}/{kind}'"
            )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.prefix}_done (batch INT, source STRING, chars BIGINT, held BIGINT) USING parquet LOCATION '{self.folder}/done'")

    def table(self, name: str) -> DataFrame:
        """One of the tables as it is now: another session, such as that of a stream, may have added to it."""
        self.spark.catalog.refreshTable(f"{self.prefix}_{name}")
        return self.spark.table(f"{self.prefix}_{name}")

    def known(self, kind: str, keys: DataFrame, batch: int) -> DataFrame:
        """The distinct ``key`` rows of ``keys`` that a batch before this one has registered."""
        held = self.table(kind).where(F.col("batch") < batch).select("key")
        return keys.select("key").where("key is not null").distinct().join(held.hint("shuffle_hash"), "key", "left_semi")

    def add(self, kind: str, keys: DataFrame, batch: int) -> None:
        """Register the distinct ``key`` rows; one file for each bucket."""
        rows = keys.select("key").where("key is not null").distinct().repartition(self.buckets, "key").select("key", F.lit(batch).alias("batch"))
        rows.write.insertInto(f"{self.prefix}_{kind}")

    def finish(self, batch: int, chars: dict[str, int], held: int) -> None:
        """Mark a batch as done, with the characters that each source has in all and the rows held out in all."""
        rows = [(batch, source, n, held) for source, n in chars.items()] or [(batch, None, 0, held)]
        self.spark.createDataFrame(rows, "batch int, source string, chars long, held long").coalesce(1).write.insertInto(f"{self.prefix}_done")

    def progress(self, batch: int | None = None) -> tuple[int, dict[str, int], int]:
        """The next batch's number, the characters taken of each source, and the rows held out so far.

        With ``batch``, what they were before it, done or not.
        """
        done = self.table("done").where(F.lit(True) if batch is None else F.col("batch") < batch)
        last = F.max(F.struct("batch", "chars", "held")).alias("last")
        rows = done.groupBy("source").agg(last).collect()  # a row for each source
        chars = {r["source"]: r["last"]["chars"] for r in rows if r["source"] is not None}
        newest = max((r["last"] for r in rows), key=lambda x: x["batch"], default=None)
        return (newest["batch"] + 1 if newest and batch is None else batch or 0), chars, (newest["held"] if newest else 0)

    def forget(self) -> None:
        """Drop the tables' names and files."""
        for kind in (*KINDS, "done"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{kind}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def among(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``seq`` of the rows whose ``key`` is in ``found(key)``; the rows of a frequent key never meet in one task."""
    counted = found.join(rows.groupBy(key).agg(F.count("*").alias("_n")), key)
    return joined_by_count(rows.select("seq", key), counted, key, "_n", total).select("seq").distinct()


def _paragraph_copies(rows: DataFrame, state: SeenState, batch: int) -> DataFrame:
    """Of registering ``rows(seq, paragraphs)``, those with long paragraphs that all were registered before."""
    each = rows.select("seq", F.explode("paragraphs").alias("key"))
    first = cut(each.groupBy("key").agg(F.min("seq").alias("seq")))
    fresh = first.join(state.known("paragraph", first, batch), "key", "left_anti").select("seq").distinct()
    return rows.where(F.size("paragraphs") > 0).select("seq").join(fresh, "seq", "left_anti")


def _near_copies(rows: DataFrame, state: SeenState, batch: int) -> DataFrame:
    """Of ``rows(seq, bands)``, those that share a band with an earlier accepted row, of this batch or one before."""
    keys = cut(rows.select("seq", F.posexplode("bands").alias("band", "value")).select("seq", "band", F.concat_ws(":", "band", "value").alias("key")))
    old = cut(among(keys, state.known("band", keys, batch), "key", keys.count()))
    left = keys.join(old, "seq", "left_anti")
    return old.unionByName(greedy_near_duplicates(left).where("near_dup").select("seq"))


def settle(
    rows: DataFrame, state: SeenState, batch: int = 0, quotas: dict[str, int] | None = None, used: dict[str, int] | None = None, held: int = 0
) -> tuple[DataFrame, dict[str, int | None]]:
    """Outcomes of one batch, and the last row that is read of each source (null: all).

    ``rows``: seq, source, n_chars, digest, paragraphs, bands of passages that passed the
    tests on a text alone; ``seq`` is their order over all sources. The outcome is ``exact`` if
    an accepted earlier passage has the digest; else ``paragraph`` if it has long paragraphs
    and each was registered by an earlier passage that got this far; else ``near`` if an
    accepted earlier passage shares a band; else ``accepted``. The first ``held`` accepted rows
    are held out; the others count towards their source's quota, and what comes after the accepted
    row at which a source has its quota is ``unread`` and registers nothing.

    What an outcome depends on comes before it in the stream, except for two things: whether
    a passage that differs from an earlier one of its digest only in its paragraphs is exact,
    and where sources end. Both are guessed (no, nowhere), everything is decided at once, and the guess
    is corrected until it stands. Each pass settles at least one more guess in the order of the
    stream, so the fixed point is the loop's result; copies with equal paragraphs need no guess.
    """
    used, ends = dict(used or {}), dict.fromkeys(quotas or {})
    rows = cut(rows)
    total = rows.count()
    old = cut(among(rows, state.known("digest", rows.select(F.col("digest").alias("key")), batch).withColumnRenamed("key", "digest"), "digest", total))
    candidates = cut(rows.join(old, "seq", "left_anti").withColumn("form", F.xxhash64(F.array_sort("paragraphs"))))
    exact = cut(rows.select("seq").limit(0))
    while True:
        live = candidates.where(read_up_to(ends))
        first = firsts(live, "digest", "form")
        forms = cut(live.join(first, "seq"))
        reg = forms.join(exact, "seq", "left_anti")
        paragraph = cut(_paragraph_copies(reg, state, batch))
        tried = reg.join(paragraph, "seq", "left_anti")
        near = cut(_near_copies(tried, state, batch))
        accepted = cut(tried.join(near, "seq", "left_anti").select("seq", "source", "n_chars", "digest"))
        # forms are distinct paragraph lists of a digest, so those of one digest are few, whatever the copies
        winner = accepted.select("digest", F.col("seq").alias("winner"))
        now = cut(forms.select("seq", "digest").join(winner, "digest").where(F.col("seq") > F.col("winner")).select("seq").distinct())
        same = now.count() == exact.count() and now.join(exact, "seq", "left_anti").isEmpty()
        found = _ends(accepted, quotas, used, held)
        if same and found == ends:
            break
        exact, ends = now, found
    won = accepted.groupBy("digest").agg(F.min("seq").alias("winner"))
    copies = cut(live.join(first, "seq", "left_anti").select("seq", "digest", (F.size("paragraphs") > 0).alias("has")))
    counted = won.join(copies.groupBy("digest").agg(F.count("*").alias("_n")), "digest")
    late = joined_by_count(copies.select("seq", "digest"), counted, "digest", "_n", total).where(F.col("seq") > F.col("winner")).select("seq")
    late = cut(late)
    name = lambda df, reason: df.select("seq", F.lit(reason).alias("reason"))
    # a copy of a rejected passage: its paragraphs, if any, are registered; else its bands are
    rest = copies.join(late, "seq", "left_anti").select("seq", F.when(F.col("has"), "paragraph").otherwise("near").alias("reason"))
    told = name(old.join(rows.where(read_up_to(ends)).select("seq"), "seq"), "exact").unionByName(name(exact, "exact")).unionByName(name(late, "exact"))
    told = told.unionByName(name(paragraph, "paragraph")).unionByName(name(near, "near")).unionByName(rest).unionByName(name(accepted, "accepted"))
    out = rows.select("seq").join(told, "seq", "left").select("seq", F.coalesce("reason", F.lit("unread")).alias("reason"))
    state.add("digest", accepted.select(F.col("digest").alias("key")), batch)
    state.add("paragraph", reg.select(F.explode("paragraphs").alias("key")), batch)
    taken = rows.join(accepted.select("seq"), "seq")
    state.add("band", taken.select(F.posexplode("bands").alias("band", "value")).select(F.concat_ws(":", "band", "value").alias("key")), batch)
    return cut(out), ends


def read_up_to(ends: dict[str, int | None]) -> Column:
    """Whether a row is not behind the last one that is read of its source."""
    stops = {s: e for s, e in ends.items() if e is not None}
    if not stops:
        return F.lit(True)
    end = F.create_map(*[F.lit(x) for s, e in stops.items() for x in (s, F.lit(e).cast("long"))])[F.col("source")]
    return end.isNull() | (F.col("seq") <= end)


def _ends(accepted: DataFrame, quotas: dict[str, int] | None, used: dict[str, int], held: int) -> dict[str, int | None]:
    """Of each source with a quota, the accepted row at which it has it; one row a source reaches the driver."""
    if not quotas:
        return {}
    rows = running_totals(accepted.withColumn("all", F.lit(0)), "all", "seq", "n_chars").drop("used").withColumnRenamed("nth", "place")
    rows = rows.withColumn("own", F.when(F.col("place") > held, F.col("n_chars")).otherwise(0))
    rows = running_totals(rows, "source", "seq", "own")
    left = F.create_map(*[F.lit(x) for s, q in quotas.items() for x in (s, F.lit(q - used.get(s, 0)).cast("long"))])[F.col("source")]
    full = rows.where(F.col("used") + F.col("own") >= left).groupBy("source").agg(F.min("seq").alias("end"))
    return dict.fromkeys(quotas) | {r["source"]: r["end"] for r in full.collect()}
