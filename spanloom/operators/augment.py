"""Augmentation of annotated texts; choices come from hashes, so a seed always gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.checkpoint import cut
from spanloom.functions import text as T

# fixed values: case modes and their weights
CASE_MODES = (("entity_upper", 3), ("entity_lower", 3), ("entity_title", 2), ("document_lower", 1), ("document_upper", 1))
MIN_CANDIDATES = 5


def uniform(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) from the parts' hash."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def gazetteer(mentions: DataFrame) -> DataFrame:
    """``(level, label, script, affix, forms)``: sorted distinct forms at three key levels; short mentions go.

    Level 0 keys by label, script and affix, 1 by label and script, 2 by label. A row holds
    all forms of its key by definition: this is the report; joins go through ``numbered``.
    """
    rows = mentions.where(F.length("mention") >= 2).select(
        "label", "mention", T.span_script(F.col("mention")).alias("script"), T.affix(F.col("mention")).alias("affix")
    )
    none = F.lit(None).cast("string")
    level = lambda k, script, affix: F.struct(F.lit(k).alias("level"), script.alias("script"), affix.alias("affix"))
    keys = F.explode(F.array(level(0, F.col("script"), F.col("affix")), level(1, F.col("script"), none), level(2, none, none))).alias("k")
    distinct = rows.distinct().select("label", "mention", keys)
    return distinct.groupBy("k.level", "label", "k.script", "k.affix").agg(F.array_sort(F.collect_set("mention")).alias("forms"))


LEVELS = (("script", "affix"), ("script",), ())


def numbered(mentions: DataFrame, buckets: int = 256) -> DataFrame:
    """``(level, label, script, affix, form, k, n)``: each key's distinct forms by number from 0, and how many there are.

    Forms are numbered inside buckets of their hash, behind the buckets before, so that a
    key with many forms is not one task's.
    """
    rows = mentions.where(F.length("mention") >= 2).select(
        "label", F.col("mention").alias("form"), T.span_script(F.col("mention")).alias("script"), T.affix(F.col("mention")).alias("affix")
    ).distinct()
    keys = F.array(*[
        F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in on else F.lit("")).alias(c) for c in ("script", "affix")]) for k, on in enumerate(LEVELS)
    ])
    each = rows.select("label", "form", F.explode(keys).alias("key")).select("label", "form", "key.*").withColumn("bucket", F.pmod(F.xxhash64("form"), F.lit(buckets)))
    key = ["level", "label", "script", "affix"]
    inside = Window.partitionBy(*key, "bucket").orderBy("form")
    per = each.groupBy(*key, "bucket").agg(F.count("*").alias("c"))
    every = Window.partitionBy(*key)
    base = per.withColumn("base", F.sum("c").over(every.orderBy("bucket")) - F.col("c")).withColumn("n", F.sum("c").over(every)).drop("c")
    return each.withColumn("k", F.row_number().over(inside) - 1).join(base, [*key, "bucket"]).select(*key, "form", (F.col("k") + F.col("base")).alias("k"), "n")


def candidates(mentions: DataFrame, forms: DataFrame, least: int = MIN_CANDIDATES) -> DataFrame:
    """``mentions`` with ``level`` and ``n``: the first level with ``least`` forms, else the last, and its number of forms.

    ``forms`` is ``numbered``; its keys are labels, two scripts and the listed suffixes, so
    their counts are few at any size, and are broadcast.
    """
    count = F.broadcast(forms.groupBy("level", "label", "script", "affix").agg(F.first("n").alias("n")))
    m = mentions.withColumn("script", T.span_script(F.col("mention"))).withColumn("affix", T.affix(F.col("mention")))
    for k, on in enumerate(LEVELS):
        m = m.join(count.where(F.col("level") == k).select("label", *on, F.col("n").alias(f"n{k}")), ["label", *on], "left")
    size = lambda k: F.coalesce(f"n{k}", F.lit(0))
    pick = F.when(size(0) >= least, 0).when(size(1) >= least, 1).otherwise(2)
    return m.withColumn("level", pick).withColumn("n", F.when(pick == 0, size(0)).when(pick == 1, size(1)).otherwise(size(2))).drop("n0", "n1", "n2")


def swapped_offsets(spans: DataFrame) -> DataFrame:
    """New ``start`` and ``end`` of spans once each mention gives way to ``replacement``; spans do not overlap."""
    size = F.length("replacement")
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(size - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    rows = spans.withColumn("new_start", F.col("start") + shift)
    return rows.withColumn("new_end", F.col("new_start") + size)


def swapped_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with every span's mention replaced: pieces between spans and replacements joined in order."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    rows = spans.withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0)))
    one = F.array_sort(F.collect_list(F.struct("start", "from", "replacement", "end")))
    per = rows.groupBy("doc_id").agg(one.alias("s"))
    joined = docs.join(per, "doc_id", "left")
    part = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform("s", lambda x: F.concat(part(x["from"], x["start"]), x["replacement"]))
    tail = F.expr("substring(text, cast(element_at(s, -1).end as int) + 1, length(text))")
    return joined.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias("text"))


def swap(mentions: DataFrame, forms: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """Adds ``replacement``: with probability ``share`` a candidate chosen by hash, in the case of the mention.

    The candidate's number and key meet ``numbered`` forms in a join, a row each.
    """
    rows = candidates(mentions, forms)
    at = F.when((F.col("n") > 0) & (uniform(F.col("doc_id"), F.col("start"), seed=seed + 2) < share), F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.col("n")))
    rows = rows.withColumn("k", at)
    rows = rows.withColumn("script", F.when(F.col("level") < 2, F.col("script")).otherwise("")).withColumn("affix", F.when(F.col("level") < 1, F.col("affix")).otherwise(""))
    rows = rows.join(forms.drop("n"), ["level", "label", "script", "affix", "k"], "left")
    new = F.col("form").isNotNull() & (F.col("form") != F.col("mention"))
    return rows.withColumn("replacement", F.when(new, T.case_like(F.col("form"), F.col("mention"))).otherwise(F.col("mention"))).drop("form", "script", "affix", "k", "n")


def case_mode(key: Column, seed: int) -> Column:
    """A case mode for each record, by weight."""
    total, at, out = sum(w for _, w in CASE_MODES), 0, None
    u = uniform(key, seed=seed) * total
    for name, weight in CASE_MODES:
        at += weight
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out


def distort_case(docs: DataFrame, mentions: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """``(doc_id, mode, text)``: a whole text or some of its mentions in another case; every offset stays valid."""
    mode = docs.select("doc_id", "text", case_mode(F.col("doc_id"), seed).alias("mode"))
    m = mentions.join(mode.select("doc_id", "mode"), "doc_id")
    new = F.when(F.col("mode") == "entity_upper", T.same_length_case(F.col("mention"), True)).when(
        F.col("mode") == "entity_lower", T.same_length_case(F.col("mention"), False)
    ).when(F.col("mode") == "entity_title", T.title_case(F.col("mention")))
    touched = (uniform(F.col("doc_id"), F.col("start"), seed=seed + 1) <= share) & new.isNotNull()
    spans = m.withColumn("replacement", F.when(touched, new).otherwise(F.col("mention")))
    entity = swapped_text(mode.select("doc_id", "text"), spans.select("doc_id", "start", "end", "replacement")).withColumnRenamed("text", "changed")
    text = F.when(F.col("mode") == "document_lower", T.same_length_case(F.col("text"), False)).when(
        F.col("mode") == "document_upper", T.same_length_case(F.col("text"), True)
    ).otherwise(F.col("changed"))
    return mode.join(entity, "doc_id").select("doc_id", "mode", text.alias("text"))


def epoch_seed(seed: int, epoch: int) -> int:
    return seed * 1000 + epoch


def augmented(
    docs: DataFrame, mentions: DataFrame, forms: DataFrame, seed: int, epoch: int = 0, swap_probability: float = 0.5, swap_share: float = 0.5, case_probability: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` and ``(doc_id, label, start, end, mention)`` of an epoch.

    Records are chosen by hash for a swap of mentions, and then, on what that gives, for a
    change of case; either may fall on a record, both or none.
    """
    own = epoch_seed(seed, epoch)
    hit = lambda probability, k: uniform(F.col("doc_id"), seed=own + k) < probability
    forms = cut(forms)  # counted for each level, then joined
    plain = mentions.select("doc_id", "label", "start", "end", "mention")
    chosen = swap(plain.where(hit(swap_probability, 11)), forms, own, swap_share).select(*plain.columns, "replacement")
    spans = cut(chosen.unionByName(plain.where(~hit(swap_probability, 11)).withColumn("replacement", F.col("mention"))))
    text = swapped_text(docs.select("doc_id", "text"), spans)
    moved = swapped_offsets(spans).select("doc_id", "label", F.col("new_start").alias("start"), F.col("new_end").alias("end"), F.col("replacement").alias("mention"))
    cased = distort_case(text.where(hit(case_probability, 13)), moved, own).select("doc_id", "text")
    text = cased.unionByName(text.where(~hit(case_probability, 13)))
    mention = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return text, moved.drop("mention").join(text, "doc_id").select("doc_id", "label", "start", "end", mention.alias("mention"))


def mask_words(tokens: DataFrame, probability: float, seed: int, key: str = "block") -> DataFrame:
    """Whole-word masking: adds ``action``: mask, random or keep for chosen words' tokens, else null.

    ``tokens`` has the key, ``word_id`` and ``pos``. Of n words round(n * p), one at least,
    are chosen by hash; of their tokens eight in ten are masked and one in ten random.
    """
    words = tokens.select(key, "word_id").distinct()
    n = F.count("*").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(key, "word_id", F.lit(seed)), "word_id"))
    want = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(probability)).cast("int")), n)
    chosen = words.withColumn("chosen", rank <= want).where("chosen").select(key, "word_id", "chosen")
    u = uniform(F.col(key), F.col("pos"), seed=seed + 1)
    action = F.when(F.col("chosen"), F.when(u < 0.8, "mask").when(u < 0.9, "random").otherwise("keep"))
    return tokens.join(chosen, [key, "word_id"], "left").withColumn("action", action).drop("chosen")
