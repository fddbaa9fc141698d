"""The corpus build against one loop written from the rules, its state across batches and sessions, and digests."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import digests
from spanloom.operators import corpus, passages
from spanloom.operators.seen import SeenState

DOCS = "source string, shard string, row long, doc_id long, text string"
MASK = (1 << 64) - 1


def plain(text):
    out = unicodedata.normalize("NFKC", text).casefold()
    for mark in "'‘’ʻʼʽ`´":
        out = out.replace(mark, "'")
    return re.sub(r"\s+", " ", out).strip()


def band_keys(text):
    words = plain(text).split()
    shingles = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
    hashes = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") for s in shingles]
    low = [min(h ^ (k * 0x9E3779B97F4A7C15 & MASK) for h in hashes) for k in range(32)]
    return [(b, tuple(low[4 * b : 4 * b + 4])) for b in range(8)]


def one_loop(docs, barred, order, quotas, held, limit, max_chars=100_000, stop=None):
    """Every passage's outcome, document after document; what is behind a quota or the stop is unread."""
    seen, paragraphs, bands, chars = set(), set(), set(), Counter()
    out, held_out = {}, 0
    for source in order:
        own = sorted((x for x in docs if x[0] == source and x[4]), key=lambda x: (x[1], x[2]))
        full = lambda: source in quotas and chars[source] >= quotas[source]
        over = stop is not None and sum(chars.values()) >= stop and source != order[0]
        for _, shard, row, _, text in own:
            for k, p in enumerate(passages.passage_list(text[:max_chars], limit)):
                where = source, shard, row, k
                if over:
                    out[where] = "unread", None
                    continue
                letters = sum(c.isalpha() for c in p)
                words = p.split()
                noisy = sum(bool(re.search(r"[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[^\W\d_][0-9]|[0-9][^\W\d_]", w)) for w in words)
                single = sum(len(re.sub(r"[^\w]", "", w)) == 1 and w[0].isalpha() for w in words)
                long = [plain(x) for x in re.split(r"\n\s*\n+", p) if len(x.strip()) > 80]
                kept = None
                if len(p) < 200:
                    reason = "short"
                elif letters < 0.4 * len(p) or not re.search("[Ѐ-ӿA-Za-z]", p):
                    reason = "alphabet"
                elif noisy > 0.01 * len(words) or single > 0.06 * len(words):
                    reason = "ocr"
                elif plain(p) in barred:
                    reason = "excluded"
                elif plain(p) in seen:
                    reason = "exact"
                elif long and paragraphs.issuperset(long):
                    reason = "paragraph"
                else:
                    paragraphs.update(long)
                    if bands.isdisjoint(band_keys(p)):
                        bands.update(band_keys(p))
                        seen.add(plain(p))
                        reason = "accepted"
                        kept = "holdout" if held_out < held else "train"
                        held_out += kept == "holdout"
                        chars[source] += len(p) * (kept == "train")
                    else:
                        reason = "near"
                out[where] = reason, kept
                if reason == "accepted" and full():
                    over = True
            over = over or full()
    return out


def stream(seed, n=60):
    """Documents with copies across sources, near copies, shared paragraphs and other white space; ids repeat and are null."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    para = [some(30) for _ in range(12)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts).upper()
        elif texts and kind < 0.3:
            text = re.sub(r"\n\n|  ", lambda m: rng.choice(["\n\n", " ", "\n", "  "]), rng.choice(texts))
        elif texts and kind < 0.45:
            text = rng.choice(texts) + " " + some(1)
        elif kind < 0.5:
            text = rng.choice(["", "tiny", "1234 " * 80, "a1b " * 70])
        else:
            text = rng.choice(["\n\n", "\n", "  "]).join(rng.choice(para) if rng.random() < 0.4 else some(rng.randint(10, 50)) for _ in range(rng.randint(1, 4)))
        texts.append(text)
    return [(f"s{rng.randint(0, 3)}", f"f{rng.randint(0, 1)}", k, rng.choice([None, 1, 2]), t) for k, t in enumerate(texts)], texts[5] or texts[6]


def decided(got):
    return {(r["source"], r["shard"], r["row"], r["passage_no"]): (r["reason"], r["split"]) for r in got.collect()}


CASES = [({}, 0, None, 60), ({"s0": 3000, "s1": 900, "s2": 0, "s3": 10**9}, 3, None, 44), ({"s3": 1200, "s1": 0, "s2": 2500}, 7, 2, 44)]


@pytest.mark.parametrize("seed, case", list(enumerate(CASES)))
def test_build_equals_one_loop(spark, seed, case):
    quotas, held, together, n = case
    docs, barred = stream(seed, n)
    order = ["s2", "s0", "s3", "s1"]
    excluded = spark.createDataFrame([(barred,), (None,)], "t string").select(digests.normalized_digest("t").alias("digest"))
    limit = 400 if seed == 2 else 100_000
    got = decided(corpus.build(spark.createDataFrame(docs, DOCS), excluded, order, quotas, held, limit, together=together).decided)
    want = one_loop(docs, {plain(barred)}, order, quotas, held, limit)
    assert got == want
    if not quotas:
        assert {"exact", "paragraph", "near", "accepted", "short"} <= {x for x, _ in got.values()}


def test_state_goes_on_in_its_folder(spark, tmp_path):
    docs, barred = stream(11, 36)
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "digest string")
    want = one_loop(docs, set(), ["s0", "s1", "s2", "s3"], {"s1": 1500}, 2, 100_000)
    first = corpus.build(df, none, ["s0", "s1"], {"s1": 1500}, 2, 100_000, state=SeenState(spark, str(tmp_path / "seen"), 4)).decided
    state = SeenState(spark, str(tmp_path / "seen"), 4)  # as another session would open it
    assert state.progress()[0] == 1
    rest = corpus.build(df, none, ["s2", "s3"], {}, 2, 100_000, state=state).decided
    assert decided(first) | decided(rest) == want
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    state.add("digest", keys, 5)
    assert state.known("digest", keys, 5).count() == 0 and state.known("digest", keys, 6).count() == 2
    plan = state.known("digest", keys, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    state.forget()


def test_budget_stops_between_sources_and_calibrates(spark):
    docs, _ = stream(5, 30)
    none = spark.createDataFrame([], "digest string")
    order = ["s0", "s1", "s2", "s3"]
    tokens = lambda t: F.size(F.split(t, " "))
    free = corpus.build(spark.createDataFrame(docs, DOCS), none, order, {}, 0, 100_000).decided
    per = {r["source"]: r["n"] for r in free.where("split = 'train'").groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    budget = corpus.Budget(10**6, tokens=tokens, sample=3)
    got = corpus.build(spark.createDataFrame(docs, DOCS), none, order, None, 0, 100_000, budget=budget)
    assert got.calibrated and 4 < got.chars_per_token < 9
    small = corpus.Budget(int((per["s0"] + 1) / 2.6), foreign=("s3",))
    got = corpus.build(spark.createDataFrame(docs, DOCS), none, order, None, 0, 100_000, budget=small)
    assert got.sources == order[:3]
    quota = int(small.max_tokens * 2.6) // 3
    assert decided(got.decided) == one_loop(docs, set(), order[:3], dict.fromkeys(order[:3], quota), 0, 100_000, stop=int(small.max_tokens * 2.6))
    with pytest.raises(ValueError):
        corpus.build(spark.createDataFrame(docs, DOCS), none, ["s0", "s0"])


def test_copies_of_every_kind_are_exact(spark):
    """Ligatures, full width, em spaces, a final sigma and Cyrillic case."""
    base = "office file ОДИН ДВА ΛΟΓΟΣ word " * 20
    forms = [base, base.replace("fi", "ﬁ"), base.replace("word", "ｗｏｒｄ"), base.replace(" ", " "), base.lower(), base.replace("ΛΟΓΟΣ", "λογος"), base.replace("ОДИН", "один")]
    docs = [("s", "f", k, None, t) for k, t in enumerate(forms)]
    got = corpus.build(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "digest string"), ["s"]).decided
    assert sorted(r["reason"] for r in got.collect()) == ["accepted"] + ["exact"] * 6


def test_empty_stream(spark):
    none = spark.createDataFrame([], "digest string")
    assert corpus.build(spark.createDataFrame([], DOCS), none, ["s0"], {"s0": 5}, 3).decided.count() == 0


def test_digests_and_signatures(spark, tmp_path):
    texts = ["", "One  two", "ﬁne É´t", None, " ".join(f"w{k % 700}" for k in range(9000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r for r in df.select("k", digests.normalized_digest("t").alias("d"), digests.minhash_signature(F.col("t")).alias("s"), digests.passage_keys(F.col("t")).alias("p")).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k]["d"] is None and got[k]["s"] is None and got[k]["p"] is None
            continue
        assert got[k]["d"] == hashlib.blake2b(plain(t).encode(), digest_size=16).hexdigest() == got[k]["p"]["digest"]
        low = [x for _, four in band_keys(t) for x in four]
        assert [(x + (1 << 63)) & MASK for x in got[k]["s"]] == low
    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    one = digests.file_digests(spark, str(tmp_path)).first()
    assert one["sha256"] == hashlib.sha256(b"abc" * 1000).hexdigest() and one["length"] == 3000


def test_manifest_from_the_write_itself(spark, tmp_path):
    docs, barred = stream(3, 40)
    excluded = spark.createDataFrame([(barred,)], "t string").select(digests.normalized_digest("t").alias("digest"))
    quotas = {"s0": 3000, "s1": 900}
    order = ["s1", "s0", "s2", "s3"]
    made = corpus.build(spark.createDataFrame(docs, DOCS), excluded, order, quotas, 3)
    got = corpus.write_corpus(made, str(tmp_path / "corpus"))
    want = one_loop(docs, {plain(barred)}, order, quotas, 3, 8000)
    filters = Counter(r for r, _ in want.values())
    assert {k: v for k, v in got["filters"].items() if k in corpus.REASONS and v} == filters
    assert sum(got["filters"][r] for r in corpus.REASONS) - filters["unread"] == got["filters"]["passages"]
    text = {(s, f, k): t for s, f, k, _, t in docs}
    kept = {where: text[where[:3]] for where, (_, split) in want.items() if split == "train"}
    assert got["documents"] == len(kept) and got["characters"] == sum(map(len, kept.values())) and got["holdout_documents"] == 3
    assert got["by_source"] == {s: sum(w[0] == s for w in kept) for s in order}
    written = spark.read.json(str(tmp_path / "corpus" / "split=train"))
    assert sorted(r["text"] for r in written.collect()) == sorted(kept.values())
    assert spark.read.json(str(tmp_path / "corpus" / "split=holdout")).count() == 3
    import json

    assert json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "corpus" / "manifest"), wholetext=True).collect())) == got
