"""The Markov part of secret scans: what is no secret, planted keys in real texts, redaction, cost."""

import random
import re
import string
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.llm import secrets

MODEL = secrets.Markov(secrets.default_samples())
DOCUMENTS = Path("/root/testdata/sf0.01/documents.parquet")
LETTERS = string.ascii_letters + string.digits
PLAIN = [
    "-" * 20, "_" * 80, "=" * 40, "+-----+------------+------+", "|---|:-----------------:|---|", "-=-=-=-=-=-=-=-=-=-=-", "a" * 20, "Z" * 60, "0" * 20,
    "hahahahahahahahahaha", "xqxqxqxqxqxqxqxqxqxq", "2024-01-02T03-04-05Z", "2024/01/02/03/04/report", "/usr/local/lib/python3/site-packages",
    "https://www.example.com/path/to/the/page-of-the-day", "getElementsByClassNameAndTagName", "MAX_CONNECTION_POOL_SIZE_LIMIT", "oueuxieraiauxeuxle",
    "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "electroencefalografista", "internationalization-and-localization",
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
]


def spans(texts):
    return [[(s, e) for s, kind, e in found if kind == 3] for found in secrets.scan(pa.array(texts, pa.string()), MODEL, 16, 8.0, 0.7)]


def test_ordinary_runs_are_no_secrets():
    assert [text for text, found in zip(PLAIN, spans(PLAIN)) if found] == []


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="no test tables")
def test_planted_keys_in_real_texts():
    table = pq.read_table(DOCUMENTS, columns=["text", "lang"]).to_pylist()
    rng = random.Random(12)
    kinds = {"alnum": (LETTERS, 24), "base64": (LETTERS + "+/", 40), "lower": (string.ascii_lowercase + string.digits, 32), "upper": (string.ascii_uppercase + string.digits, 24)}
    for lang in ("en", "de", "fr", "es"):
        own = [r["text"] for r in table if r["lang"] == lang and 50 < len(r["text"])][:120]
        clean = sum(bool(found) for found in spans(own))
        assert clean <= 0.01 * len(own)
        for alphabet, size in kinds.values():
            texts, keys = [], []
            for text in own:
                at = rng.choice([m.start() for m in re.finditer(" ", text)])
                keys.append("".join(rng.choice(alphabet) for _ in range(size)))
                texts.append(f"{text[:at]} {keys[-1]}{text[at:]}")
            hit = [any(key in text[s:e] for s, e in found) for text, key, found in zip(texts, keys, spans(texts))]
            assert np.mean(hit) > 0.95


def test_redaction_leaves_markdown(spark):
    table = "| name | size |\n|----------------------|--------------------|\n| a | b |\n\n----------------------\n\n====================\n"
    text = f"{table}key zQ8fK2mPx91LrT4vWb7NcY3d\n{table}"
    docs = spark.createDataFrame([(1, table), (2, text), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert got == {1: table, 2: f"{table}key [SECRET]\n{table}", 3: None}


def test_patterns_count_once_and_blobs_whole():
    rng = random.Random(3)
    blob = "".join(rng.choice(LETTERS + "+/") for _ in range(30_000))
    assert spans([blob, blob[:3] * 50]) == [[(0, len(blob))], []]


def test_cost_is_linear_in_spans():
    def seconds(n):
        text = " ".join(["0123456789abcdef" * 2, "token=abcdefgh", "some/long/ordinary/path-name"] * n)
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            found = secrets.scan(pa.array([text]), MODEL, 16, 8.0, 0.7)[0]
            best = min(best, time.perf_counter() - start)
        assert sum(kind < 3 for _, kind, _ in found) == 2 * n
        return best

    assert seconds(8000) < 4 * seconds(4000) + 0.2


def test_odd_rows(spark):
    wide = "w" * 2_000_000
    rows = [(1, None, 0), (2, "", 0), (None, "token=abcdefgh", 1), (3, "token=abcdefgh", 1), (3, "token=abcdefgh", 1), (4, wide, 2)]
    got = secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["spans"]) for r in got) == [
        ("1", 0, ""), ("2", 0, ""), ("3", 1, "assign:0:14"), ("3", 1, "assign:0:14"), ("4", 0, ""), ("None", 1, "assign:0:14"),
    ]


def best_segment(ratio, least, rate):
    """The highest sum above the rate of any segment of at least ``least`` characters, over all pairs of ends."""
    return max((sum(x - rate for x in ratio[a:b]), a, b) for a in range(len(ratio)) for b in range(a + least, len(ratio) + 1))


def test_segments_equal_all_pairs_of_ends():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["path", "/", "user", "_", rng.choice(LETTERS) * 1, rng.choice(LETTERS + "+/") + rng.choice(LETTERS)]) for _ in range(rng.randint(8, 22))).encode()
        ratio = MODEL.each(text).tolist()
        got = secrets.segments(text, MODEL, 16, 8.0, 0.7)
        if len(text) < 16:
            assert got == []
        elif sum(ratio) > max(8.0, 0.7 * len(text)):
            assert got == [(0, len(text))]
        else:
            total, a, b = best_segment(ratio, 16, 0.7)
            inside = sum(ratio[a:b])
            if inside > 8.0 and inside > 0.7 * (b - a) + 1e-9:
                assert any(s <= a and b <= e for s, e in got)
            else:
                assert got == []


def test_public_forms_and_names_are_no_secrets():
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    uuids = ["-".join(hexes(n) for n in (8, 4, 4, 4, 12)) for _ in range(200)]
    b64 = "".join(rng.choice(LETTERS + "+/") for _ in range(300))
    texts = [f"id {u} of" for u in uuids] + [f"see /items/{u}/view" for u in uuids] + [u.upper() for u in uuids]
    texts += [f"ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQC{b64} me@host", f"ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAI{b64[:43]} me@host"]
    texts += ["NASDAQ/NYSE/AMEX/FTSE/DAX", "Krzysztofowi_Szczepaniakowi", "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch", "UNESCO-UNICEF-OECD-NATO", "HTTP/HTTPS/TCP/UDP"]
    assert [text for text, found in zip(texts, spans(texts)) if found] == []
    key = "".join(rng.choice(LETTERS) for _ in range(40))
    assert all(found for found in spans([f"{uuids[0]} {key}", f"key={key}/{uuids[1]}"]))
