"""Corpus assembly: drop reasons, quotas, holdout and manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.checkpoint import cut
from spanloom.functions import text as T
from spanloom.functions.digests import passage_keys
from spanloom.operators.passages import split_passages, truncated
from spanloom.operators.running import running_totals
from spanloom.operators.seen import SeenState, among, read_up_to, settle


def stateless_reason(
    text: Column, min_chars: int = 200, max_noise: float = 0.01, max_single: float = 0.06, counts: dict[str, Column] | None = None
) -> Column:
    """First stateless test that a passage fails, in order: short, alphabet, ocr; null if none.

    ``counts`` are ``ocr_counts`` that the caller has as columns.
    """
    noise, single = T.ocr_shares(counts or T.ocr_counts(text))
    return F.when(F.length(text) < min_chars, "short").when(~T.alphabet_ok(text), "alphabet").when((noise > max_noise) | (single > max_single), "ocr")


def funnel(passages: DataFrame, excluded: DataFrame) -> DataFrame:
    """One ``reason`` for each passage: the stateless tests, then excluded, exact, else accepted.

    ``passages`` has ``seq`` and ``passage``; its other columns are kept. ``excluded`` holds
    normalised digests. Later copies count as exact whether or not the first one is accepted.
    Texts are tested once, and digests made of what passes the cheap tests; from there on only
    numbers and digests move. ``outcomes`` has all of the rules.
    """
    counts = T.ocr_counts(F.col("passage"))
    rows = passages.withColumns(counts).withColumn("early", stateless_reason(F.col("passage"), counts={k: F.col(k) for k in counts}))
    rows = cut(rows.withColumn("digest", F.when(F.col("early").isNull(), T.digest(T.normalize(F.col("passage"))))).drop("passage", *counts))
    barred = excluded.select("digest").where("digest is not null").distinct()
    found = rows.where("digest is not null").select("seq", "digest")
    free = found.join(barred, "digest", "left_anti").groupBy("digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    hit = found.join(barred, "digest", "left_semi").select("seq", F.lit(True).alias("is_barred"))
    rows = rows.join(free, "seq", "left").join(hit, "seq", "left")
    late = F.when(F.col("is_barred"), "excluded").when(F.col("is_first").isNull(), "exact")
    return rows.withColumn("reason", F.coalesce("early", late, F.lit("accepted"))).drop("early", "digest", "is_first", "is_barred")


def quota_cut(accepted: DataFrame, quota: int | Column, group: str = "source", order: str = "seq", size: str = "n_chars", block_rows: int = 1_000_000) -> DataFrame:
    """Rows up to and with the one that reaches the group's quota of characters.

    ``quota`` may be a column, such as a map's value for the group; a null quota has no end.
    """
    most = quota if isinstance(quota, Column) else F.lit(quota)
    rows = running_totals(accepted, group, order, size, block_rows)
    return rows.where((F.col("nth") == 1) | (F.col("used") < most) | most.isNull()).drop("nth")


def holdout(accepted: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` accepted rows."""
    return accepted.orderBy(order).limit(n)


def group_quotas(budget: int, foreign_share: float, native: list[str], foreign: list[str]) -> dict[str, int]:
    """Characters for each source: a group's share split evenly by whole division."""
    theirs = int(budget * foreign_share)
    out = {s: (budget - theirs) // max(len(native), 1) for s in native}
    if foreign_share > 0:
        out |= {s: theirs // max(len(foreign), 1) for s in foreign}
    return out


def parse_sources(spec: list[str], known: dict) -> list[tuple[str, int | None]]:
    """``name:count`` or ``name:all`` entries; a bare name means all."""
    out = []
    for item in spec:
        name, _, count = item.partition(":")
        if name not in known:
            raise ValueError(f"unknown source {name!r}")
        out.append((name, None if count in ("", "all") else int(count)))
    return out


def manifest(rows: DataFrame, chars_per_token: float = 2.6) -> DataFrame:
    """Documents, characters, share of characters and estimated tokens of each source."""
    per = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    total = per.agg(F.sum("chars").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(  # one row of totals
        "source", "docs", "chars", F.round(F.col("chars") / F.col("total"), 4).alias("share"), F.floor(F.col("chars") / chars_per_token).alias("tokens")
    )


def scripts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``(script, docs, chars)`` of the manifest's histogram."""
    return rows.groupBy(T.script_of(F.col(text)).alias("script")).agg(F.count("*").alias("docs"), F.sum(F.length(text)).alias("chars"))


def outcomes(
    passages: DataFrame, excluded: DataFrame, chosen: list[str], quotas: dict[str, int] | None = None, held: int = 0,
    total: Callable[[DataFrame], int] | int | None = None, state: SeenState | None = None, together: int | None = None, batch: int | None = None,
) -> DataFrame:
    """``passages`` without its text, with ``n_chars, script, reason, split``: one reason for each passage.

    ``passages`` has ``seq``, its place in the whole stream, ``source`` and ``passage``; ``chosen``
    names the sources in the order of the stream, others are not read. Reasons, in order: short,
    alphabet, ocr, excluded, then those of ``seen.settle``: exact, paragraph, near, accepted, and
    unread for what is behind a quota, or behind ``total`` characters, which stop the stream
    between sources only. ``excluded`` holds ``functions.digests`` of texts. The first ``held``
    accepted passages have split ``holdout`` and count towards no quota; the others ``train``.

    Sources go through ``state`` in batches of ``together``, or all at once without it; the result is
    the same. With ``total`` they go one by one; it may be a function of the rows accepted so far.
    A state that holds earlier batches goes on from them: a source that has its quota is not read
    any further. ``batch`` names the one batch that all of this is, for one that may be run again.
    """
    if batch is not None and (total is not None or together is not None):
        raise ValueError("a named batch is one batch")
    rows = cut(_tested(passages.where(F.col("source").isin(*chosen)), excluded))
    own = state or SeenState(passages.sparkSession)
    batch, chars, gone = own.progress(batch)
    visited = set(chars)
    width = 1 if total is not None else together or max(len(chosen), 1)
    out = rows.withColumns({"reason": F.lit("unread"), "split": F.lit(None).cast("string")}).limit(0)
    full = False
    for k in range(0, len(chosen), width):
        names = chosen[k : k + width]
        part = rows.where(F.col("source").isin(*names))
        if full:
            out = out.unionByName(part.withColumns({"reason": F.lit("unread"), "split": F.lit(None).cast("string")}))
            continue
        limits = {s: q for s, q in (quotas or {}).items() if s in names and q is not None}
        left = max(held - gone, 0)
        candidates = part.where("early is null").select("seq", "source", "n_chars", "digest", "paragraphs", "bands")
        told, ends = settle(_first_documents(candidates, part, limits, chars, visited), own, batch, limits, chars, left)
        told = part.join(told, "seq", "left")
        reason = F.when(read_up_to(ends), F.coalesce("reason", "early", F.lit("unread"))).otherwise("unread")
        told = _first_documents(told, part, limits, chars, visited, reason)
        last = told.where("reason = 'accepted'").select("seq").orderBy("seq").limit(left).agg(F.max("seq"), F.count("*")).first() if left else (None, 0)
        split = F.when(F.col("reason") == "accepted", F.when(F.col("seq") <= F.lit(last[0]), "holdout").otherwise("train"))
        told = cut(told.withColumn("split", split))
        gone += last[1]
        for r in told.where("split = 'train'").groupBy("source").agg(F.sum("n_chars").alias("n")).collect():
            chars[r["source"]] = chars.get(r["source"], 0) + r["n"]
        chars = dict.fromkeys(names, 0) | chars
        own.finish(batch, chars, gone)
        out, batch = out.unionByName(told), batch + 1
        if total is not None:
            full = sum(chars.values()) >= (total(out) if callable(total) else total)
    if state is None:
        own.forget()
    return out.drop("early", "digest", "paragraphs", "bands")


def _tested(passages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Passages as numbers and keys: what a text shows by itself, and whether it is excluded."""
    text = F.col("passage")
    counts = T.ocr_counts(text)
    rows = passages.withColumns(counts).withColumn("early", stateless_reason(text, counts={k: F.col(k) for k in counts}))
    keys = passage_keys(F.when(F.col("early").isNull(), text))
    rows = rows.withColumns({"n_chars": F.length(text).cast("long"), "script": T.script_of(text), "keys": keys}).drop("passage", *counts)
    rows = cut(rows.select("*", "keys.digest", "keys.paragraphs", "keys.bands").drop("keys"))
    barred = excluded.select("digest").where("digest is not null").distinct()
    hit = among(rows.where("digest is not null"), barred, "digest", rows.count()).withColumn("hit", F.lit(True))
    return rows.join(hit, "seq", "left").withColumn("early", F.coalesce("early", F.when(F.col("hit"), "excluded"))).drop("hit")


def _first_documents(
    rows: DataFrame, part: DataFrame, quotas: dict[str, int], chars: dict[str, int], visited: set[str], reason: Column | None = None
) -> DataFrame:
    """``rows`` that are read at all: a source without any quota is read up to the end of its first document.

    One that got its quota in an earlier batch is not read any further. With ``reason``, all rows, with what is not read by name. One row a source reaches the driver.
    """
    done = [s for s, q in quotas.items() if q <= chars.get(s, 0)]
    skip = F.lit(False)
    if done:
        skip = F.col("source").isin(*[s for s in done if s in visited])
        ends = part.where(F.col("source").isin(*[s for s in done if s not in visited])).groupBy("source").agg(F.min("document").alias("document")).collect()
        for r in ends:
            last = part.where((F.col("source") == r["source"]) & (F.col("document") == r["document"])).agg(F.max("seq")).first()[0]
            skip = skip | ((F.col("source") == r["source"]) & (F.col("seq") > last))
    if reason is None:
        return rows.where(~skip)
    return rows.withColumn("reason", F.when(skip, "unread").otherwise(reason))


def stream_passages(docs: DataFrame, chosen: list[str], limit: int = 8000, max_chars: int = 100_000) -> DataFrame:
    """``docs(source, shard, row, text, ...)`` as passages in stream order: ``seq``, ``document`` and ``passage_no``.

    The order is that of ``chosen``, then shard name, row and place; ``seq`` holds all four as bits of
    a long, so that no text moves to be numbered. A document is ``max_chars`` long at most; empty
    ones are none. One row for each shard reaches the driver, which lists the files anyway.
    """
    docs = docs.where(F.col("source").isin(*chosen) & (F.col("text") != ""))
    files = [tuple(r) for r in docs.groupBy("source", "shard").agg(F.max("row")).collect()]
    shards = sorted({(chosen.index(s), f or "", s, f) for s, f, _ in files}, key=lambda x: x[:2])
    rows, places = max((r or 0 for _, _, r in files), default=0).bit_length(), max_chars.bit_length()
    if rows + places + len(shards).bit_length() > 63:
        raise ValueError("too many shards, rows and passages for a long")
    number = docs.sparkSession.createDataFrame([(s, f, k) for k, (_, _, s, f) in enumerate(shards)], "s string, f string, file long")
    docs = docs.join(F.broadcast(number), (F.col("source") == F.col("s")) & F.col("shard").eqNullSafe(F.col("f"))).drop("s", "f")
    document = F.shiftleft("file", rows).bitwiseOR(F.coalesce("row", F.lit(0)))
    docs = docs.withColumn("document", document).withColumn("text", truncated(F.col("text"), max_chars)).drop("file")
    return split_passages(docs, limit).withColumn("seq", F.shiftleft("document", places).bitwiseOR(F.col("passage_no")))


@dataclass(frozen=True)
class Budget:
    """Tokens wanted in all, and the share of foreign sources; ``tokens`` counts a text's tokens, for calibration."""

    max_tokens: int
    foreign: tuple[str, ...] = ()
    foreign_share: float = 0.0
    chars_per_token: float = 2.6
    tokens: Callable[[Column], Column] | None = None
    sample: int = 200
    sample_chars: int = 20_000


@dataclass
class Corpus:
    """A decided corpus: the documents, every passage's outcome, and what the budget came to."""

    docs: DataFrame
    decided: DataFrame
    sources: list[str]
    limit: int
    max_chars: int
    chars_per_token: float | None = None
    calibrated: bool = False
    foreign: tuple[str, ...] = ()

    def passages(self) -> DataFrame:
        return stream_passages(self.docs, self.sources, self.limit, self.max_chars)


def build(
    docs: DataFrame, excluded: DataFrame, sources: list[str], quotas: dict[str, int] | None = None, held: int = 0, limit: int = 8000,
    max_chars: int = 100_000, budget: Budget | None = None, state: SeenState | None = None, together: int | None = None,
) -> Corpus:
    """The whole corpus of ``docs(source, shard, row, text, ...)``, its sources in the order given; see ``outcomes``.

    A ``budget`` gives each source its quota (the group's share, evenly) and stops the stream between
    sources. Once ``sample`` passages are in training, their characters for each token replace the
    budget's own, for the stop, not for the quotas. Foreign sources without a share are not read.
    """
    if len(set(sources)) < len(sources):
        raise ValueError("a source is named twice")
    sources = [s for s in sources if budget is None or budget.foreign_share > 0 or s not in budget.foreign]
    corpus = Corpus(docs, docs.limit(0), sources, limit, max_chars, budget and budget.chars_per_token, foreign=budget.foreign if budget else ())
    stop = None
    if budget is not None:
        quotas = group_quotas(
            int(budget.max_tokens * budget.chars_per_token), budget.foreign_share, [s for s in sources if s not in budget.foreign], [s for s in sources if s in budget.foreign]
        )

        def stop(told: DataFrame) -> int:
            if budget.tokens is not None and not corpus.calibrated:
                first = told.where("split = 'train'").select("seq").orderBy("seq").limit(budget.sample)
                n, last = first.agg(F.count("*"), F.max("seq")).first()
                if n == budget.sample:
                    texts = corpus.passages().where(F.col("seq") <= last).join(first, "seq", "left_semi").select(F.substring("passage", 1, budget.sample_chars).alias("t"))
                    chars, tokens = texts.agg(F.sum(F.length("t")), F.sum(budget.tokens(F.col("t")))).first()
                    corpus.chars_per_token, corpus.calibrated = chars / tokens, True
            return int(budget.max_tokens * corpus.chars_per_token)

    corpus.decided = outcomes(corpus.passages(), excluded, sources, quotas, held, stop, state, together)
    return corpus


def calibrate(rows: DataFrame, order: str = "seq", sample: int = 200, max_chars: int = 20_000, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Characters per token over the first ``sample`` rows, each cut at ``max_chars``; ``tokens`` counts a text's tokens, words if not given."""
    count = tokens or (lambda t: F.size(T.words(t)))
    first = rows.orderBy(order).limit(sample).select(F.substring("text", 1, max_chars).alias("t"))
    both = first.agg(F.sum(F.length("t")).alias("chars"), F.sum(count(F.col("t"))).alias("tokens"))
    return both.select("chars", "tokens", F.round(F.col("chars") / F.col("tokens"), 6).alias("chars_per_token"))


def step_budget(tokens: Column, batch: int, accumulation: int, block: int = 512) -> Column:
    return F.greatest(F.lit(1000).cast("long"), F.floor(tokens / (batch * accumulation * block)))


REASONS = ("short", "alphabet", "ocr", "excluded", "exact", "paragraph", "near", "accepted", "unread")


def write_corpus(corpus: Corpus, folder: str) -> dict:
    """Write ``folder/split=train`` and ``folder/split=holdout`` as JSON lines, and return the manifest, also written to ``folder/manifest``.

    Counters, characters, shares and scripts are metrics that Spark collects while the passages are
    written, so the outcomes are read once. The sum of all outcomes is the number of passages.
    """
    told, seen = corpus.decided, Observation()
    train = F.col("split") == "train"
    count = lambda x, name: F.count_if(F.coalesce(x, F.lit(False))).alias(name)
    chars = lambda x, name: F.coalesce(F.sum(F.when(x, F.col("n_chars"))), F.lit(0)).alias(name)
    metrics = [F.count("*").alias("passages"), count((F.col("passage_no") == 0) & (F.col("reason") != "unread"), "documents_read")]
    metrics += [count(F.col("reason") == r, r) for r in REASONS] + [count(train, "train"), count(F.col("split") == "holdout", "holdout"), chars(train, "chars")]
    metrics += [count(train & (F.col("script") == s), f"script_{s}") for s in ("both", "cyr", "lat")]
    for k, source in enumerate(corpus.sources):
        own = train & (F.col("source") == source)
        metrics += [count(own, f"docs_{k}"), chars(own, f"chars_{k}")]
    taken = told.observe(seen, *metrics).where("split is not null").select("seq", "split")
    texts = corpus.passages().select("seq", F.col("passage").alias("text"))
    texts.join(taken, "seq").select("text", "split").write.mode("overwrite").partitionBy("split").json(folder)
    got = seen.get
    total = max(got["chars"], 1)
    by = {s: (got[f"docs_{k}"], got[f"chars_{k}"]) for k, s in enumerate(corpus.sources)}
    rate = corpus.chars_per_token or 2.6
    manifest = {
        "sources": corpus.sources, "documents": got["train"], "characters": got["chars"], "estimated_tokens": int(got["chars"] / rate),
        "chars_per_token": round(rate, 3), "calibrated": corpus.calibrated, "by_source": {s: n for s, (n, _) in by.items()},
        "share_by_source": {s: round(c / total, 4) for s, (_, c) in by.items()},
        "foreign_share": round(sum(c for s, (_, c) in by.items() if s in corpus.foreign) / total, 4),
        "by_script": {s: got[f"script_{s}"] for s in ("both", "cyr", "lat")}, "holdout_documents": got["holdout"], "passage_chars": corpus.limit,
        "filters": {"documents_read": got["documents_read"], "passages": got["passages"] - got["unread"]} | {r: got[r] for r in REASONS},
    }
    spark = told.sparkSession
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest
