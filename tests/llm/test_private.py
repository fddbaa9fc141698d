"""Personal data against contract patterns as written, and the bootstrapping against plain loops."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from math import floor, log1p

import pytest

from spanloom.llm import private
from tests.llm.test_llm import DOCS, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    total = sum(int(x) for x in d[-1::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])
    return total % 10 == 0


def contract(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (14 <= len(d) <= 19 and luhn(d)) or kind == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + x for x in "0123456789" if luhn(d + x))


def edged(w):
    return w.strip(".,;:!?\"'()[]{}<>")


def loops(texts, support=3, confidence=0.6, evidence=0.75, rounds=4):
    """All spans of each text, by loops over words and a dictionary of patterns."""
    held, ordinary, edges, seeds = [], Counter(), defaultdict(Counter), set()
    ok = re.compile(r"[A-Za-z0-9.+_%@/#(),:;!?\"'\[\]{}<>-]+")
    for text in texts:
        text = text or ""
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        base = contract(text)
        spans, taken = [], set()
        for s, _, e in base:
            own = [k for k, (a, b) in enumerate(words) if a < e and b > s]
            taken.update(own)
            spans.append((s, e, own[0], own[-1], True))
        k = 0
        good = lambda k: k < len(words) and k not in base_words and re.search("[0-9]", text[slice(*words[k])]) and ok.fullmatch(text[slice(*words[k])])
        base_words = set(taken)
        while k < len(words):
            if not good(k):
                k += 1
                continue
            first = k
            while good(k + 1) and text[words[k][1] : words[k + 1][0]] == " " and text[words[k][1] - 1] not in ".,;:!?":
                k += 1
            a, b = words[first][0], words[k][1]
            n = sum(c in "0123456789" for c in text[a:b])
            if k - first < 4 and n >= 4:
                head, tail = text[slice(*words[first])], text[slice(*words[k])]
                s, e = a + head.index(edged(head)), words[k][0] + len(tail.rstrip(".,;:!?\"'()[]{}<>"))
                spans.append((s, e, first, k, False))
                taken.update(range(first, k + 1))
            k += 1

        def near(k):
            return text[slice(*words[k])].lower() if 0 <= k < len(words) and k not in taken else None

        def patterns(one, two, after):
            return [x for x in (("1", one), ("2", one, two), ("3", one, after)) if None not in x]

        mine = []
        for s, e, first, last, seed in sorted(spans):
            a, b = words[first][0], words[last][1]
            one, two = (near(first - 1), near(first - 2)) if a == s else (text[a:s].lower(), near(first - 1))
            instance = text[s:e].lower()
            for p in patterns(one, two, near(last + 1) if b == e else text[e:b].lower()):
                edges[p][instance] += 1
            seeds |= {instance} if seed else set()
            mine.append((s, e, instance, seed))
        for k in range(len(words)):
            if k not in taken:
                ordinary.update(patterns(near(k - 1), near(k - 2), near(k + 1)))
        held.append((base, mine))
    known = set(seeds)
    for _ in range(rounds):
        weight = {}
        for p, x in edges.items():
            share = sum(n for i, n in x.items() if i in known) / (sum(x.values()) + ordinary[p] + 1)
            if sum(i in known for i in x) >= support and share >= confidence:
                weight[p] = floor(-log1p(-share) * 1e6)
        told = Counter()
        for p, w in weight.items():
            for i in edges[p]:
                told[i] += w
        new = {i for i, w in told.items() if w >= int(-log1p(-evidence) * 1e6)} - known
        if not new:
            break
        known |= new
    return [sorted([*base, *((s, 4, e) for s, e, i, seed in mine if not seed and i in known)]) for base, mine in held]


def corpus(seed=0):
    rng = random.Random(seed)
    words = "the of and für mañana stamp river lamp green paper over stone".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    seed_of = (
        lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f"u{rng.randint(1, 10**6)}@mail{rng.randint(1, 9)}.example.com",
        lambda: card(rng), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    )
    texts = []
    for k in range(40):
        texts.append(f"{prose(8)} please reach {rng.choice(seed_of)()} today {prose(5)}, client number: {rng.choice(seed_of)()} {prose(3)}")
    texts += [f"{prose(6)} please reach 0044-{k}77-1234 today {prose(4)} and badge no K-{k}9981 {prose(3)}" for k in range(16)]
    # what is known from the first pattern makes a second one, which no seed is in
    texts += [f"{prose(4)} my staff badge 0044-{k}77-1234 {prose(3)}" for k in range(16)] + [f"{prose(4)} my staff badge Q{k}-88123 or {prose(3)}" for k in range(3)]
    texts += [f"year {1990 + k % 30} saw {prose(6)} 12,500 {prose(3)}" for k in range(30)] + [prose(30) for _ in range(20)]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("bits", [23, 7])
def test_spans_equal_loops(spark, bits):
    texts = corpus() + ["", None, "(555) 010-1234, x", "tel:+1 (988) 555-2485.", "1.2.3.4.5 a@b.c@d.e.f 999.1.1.1"]
    got = {r["doc_id"]: r for r in private.personal_spans(frame(spark, texts), filter_bits=bits).collect()}
    want = loops(texts)
    assert [[tuple(x) for x in got[k]["spans"]] for k in range(len(texts))] == want
    assert [[tuple(x) for x in got[k]["base"]] for k in range(len(texts))] == [contract(t or "") for t in texts]
    found = {texts[k][s:e] for k, spans in enumerate(want) for s, kind, e in spans if kind == 4}
    assert {"0044-077-1234", "0044-377-1234"} <= found  # next to seeds
    assert {"Q0-88123", "Q2-88123"} <= found  # in a pattern of the second round
    assert not any(re.fullmatch(r"(19|20)\d\d|12,500|K-.*", x) for x in found)


def test_base_spans_equal_contract():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789014455+@..--  ()aZ%_é\n") for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        points = [len(raw[:k].decode(errors="ignore")) for k in range(len(raw) + 1)]
        assert [(points[s], k, points[e]) for s, k, e in private.base_spans(raw)] == contract(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in (b"a" * 3_000_000, b"1" * 3_000_000, b"1." * 1_500_000, b"a@" * 1_000_000, b"+1" * 1_000_000, b"+1" + b" " * 3_000_000, b"1 " * 1_000_000):
        private.base_spans(text)
    assert time.time() - began < 30


def test_odd_rows_and_query(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumnRenamed("kept", "_row")
    got = private.personal_spans(odd).collect()
    assert len(got) == len(ODD) and all(r["spans"] == r["base"] for r in got)
    assert private.personal_spans(spark.createDataFrame([], DOCS)).count() == 0
    out = {r["doc_id"]: r for r in private.op11_personal_data(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        base, r = contract(d["text"] or ""), out[d["doc_id"]]
        text = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]


def test_frequent_instance_and_pattern(spark):
    """One number and one context in most texts: the copies are one instance, and every mention is reported."""
    texts = ["please reach 0044-177-1234 today"] * 2000 + [f"please reach u{k}@a.example.com today" for k in range(4000)]
    got = private.personal_spans(frame(spark, texts)).where("size(spans) > size(base)").count()
    assert got == 2000
