"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are counted from labelled samples: one
from random strings, one from ordinary identifiers. Runs of token characters are cut at
the base spans. What is left, of at least ``min_length`` characters, is a secret if the
random model explains it better than the other by more than ``margin`` nats in all and
``rate`` a character. Otherwise its best segment that does so is one, widened to the next
sign that is neither letter nor digit, and the parts on both sides of it are scored anew.

The default samples are made here from a fixed seed: random strings over the alphabets
that keys use, and ordinary ones: identifiers, paths, words of several languages and of
none, joined acronyms, dates, rules and borders, one sign again and again. Callers can pass labelled
samples of their own. Two kinds of random strings are public by their form, and no span of the
method reaches into them: universally unique identifiers, and public keys by their header.

Defined results: null and empty texts have no spans; texts and runs of any length are
scored whole; repeated rows give repeated results; an empty table gives no rows; further
columns of the input are not read. Of equally good segments the first is taken; spans of
equal start are listed by kind.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import map_slices, release, slices, table, text_bytes
from spanloom.llm.registry import QUERIES

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
MAY_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
TOKEN = string.ascii_letters + string.digits + "+/_=-"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: words of ordinary identifiers and prose in five languages
WORDS = (
    "account action address array attribute base batch buffer button cache change channel check class client code column command config "
    "connect context control copy count create current data date default delete device document element enable entry error event export "
    "field file filter first format function group handle head height image import index input insert item key label last layout length "
    "level line list load main map message method mode model module name network new next number object offset open option order page "
    "path pattern point position print process project query read record region remove report request reset result return row sample save "
    "search section send server session setting shape size source start state status step stream string system table task test text time "
    "total type unit update upload user value vector version view window word work write zone "
    "über straße können zwischen gesellschaft verwaltung schiff entwicklung möglich niemand "
    "château toujours beaucoup développement monsieur quelque jamais oiseaux travail nouveau "
    "corazón siempre ciudad desarrollo mañana trabajo nosotros pequeño gobierno quizás"
).split()
#: names and words of further languages
NAMES = (
    "Krzysztof Szczepan Wojciech Grzegorz Przemysław Małgorzata Katarzyna Zbigniew mieszkanie przedsiębiorstwo szczęście chrząszcz wszystkich "
    "Llanfair gwyngyll gogerych chwyrn drobwll llantysilio gwasanaeth cymdeithas ysgol prifysgol cyfrifiadur "
    "o'zbekiston qishloq xo'jaligi shahar toshkent bo'yicha kutubxona özgürlük çalışma teşekkür yükseköğretim "
    "työttömyys kansainvälinen yhteiskunta megszentségtelenített hagyományos közösség čtvrtek přátelství zmrzlina"
).split()
ACRONYMS = (
    "NASDAQ NYSE AMEX FTSE DAX CAC NIKKEI HTTP HTTPS TCP UDP SMTP IMAP POP SSH FTP DNS DHCP LDAP JSON XML YAML HTML CSS SQL CSV PDF PNG JPEG GIF "
    "NATO UNESCO UNICEF OECD WTO IMF EU UN USA UK NASA ESA CERN MIT BBC CNN NBC ABC USB HDMI RAM ROM CPU GPU SSD BIOS VPN LAN WAN RGB CMYK"
).split()
#: forms of random strings that are no secrets: UUIDs whole, and what follows the headers of public keys
PUBLIC = re.compile(
    rb"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
    rb"|(?<![A-Za-z0-9+/])AAAA(?:B3NzaC1|C3NzaC1|E2VjZHNh)[A-Za-z0-9+/=]+"
)
ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl gr pl pr qu sch sh sp st str th tr".split()
VOWELS = "a e i o u ai au ea ei eu ie io oi ou ui".split()
CODAS = ["", "", "", "l", "m", "n", "r", "s", "t", "x", "ch", "ck", "ng", "nt", "rt", "st"]


def ordinary(rng: random.Random) -> str:
    """A run of token characters that is no secret: identifiers, paths, long words, dates, rules and borders."""
    kind = rng.randrange(22)
    words = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
    if kind < 9:
        text = (
            "_".join(words), "-".join(words), "/".join(words), "".join(words),
            words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(),
        )[rng.randrange(6)]
        return text + (str(rng.randint(0, 9999)) if rng.random() < 0.2 else "")
    if kind < 14:  # long words of no language in particular
        made = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(3, 9)))
        return (made, made.title(), made.upper(), made, f"{made}-{words[0]}")[rng.randrange(5)]
    if kind < 16:
        parts = [f"{rng.randint(1950, 2035)}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}", f"{rng.randint(0, 23):02}", f"{rng.randint(0, 59):02}"]
        return rng.choice("-/_").join(parts[: rng.randint(3, 5)]) + rng.choice(["", "T", "Z", "-v1", f"_{words[0]}"])
    if kind < 18:  # rules, borders, leaders
        sign = rng.choice("-_=+/")
        text = sign * rng.randint(4, 40)
        return text if rng.random() < 0.6 else "".join(rng.choice("+-=_/") + text for _ in range(rng.randint(2, 5)))
    if kind < 19:  # one sign again and again, or all in order
        signs = rng.choice([string.ascii_lowercase, string.ascii_uppercase, string.digits + "abcdef", string.digits])
        return rng.choice([rng.choice(signs) * rng.randint(8, 40), signs[rng.randint(0, 5) :]])
    if kind < 20:  # of other languages, with an ending now and then
        own = [rng.choice(NAMES) + rng.choice(["", "", "owi", "ach", "ning", "lar", "nen"]) for _ in range(rng.randint(1, 3))]
        return rng.choice(["_", "-", "", "/"]).join(w if rng.random() < 0.6 else w.title() for w in own)
    if kind < 21:
        return rng.choice("/_-+=").join(rng.choice(ACRONYMS) for _ in range(rng.randint(2, 7)))
    return "/".join([rng.choice(["", "home", "usr", "var", "https", "www"]), *words]) + rng.choice(["", "/", "-1", "_v2", f"/{rng.randint(1, 99)}"])


def default_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """``(text, 1 if random)``: ``n`` random and twice as many ordinary ones, the same for a seed on every machine."""
    rng = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits] * 3 + [TOKEN, string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    out = []
    for _ in range(n):
        alphabet = rng.choice(alphabets)
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(16, 48))), 1))
        out += [(ordinary(rng), 0), (ordinary(rng), 0)]
    return out


class Markov:
    """Log-likelihood ratio of first-order character models: above zero looks random."""

    def __init__(self, samples: list[tuple[str, int]], smoothing: float = 0.5) -> None:
        self.code = np.zeros(256, np.int64)
        self.code[list(TOKEN.encode())] = np.arange(1, len(TOKEN) + 1)
        size = len(TOKEN) + 1  # zero: the start, and any other character
        count = np.full((2, size, size), smoothing)
        for text, label in samples:
            seen = np.r_[0, self.code[np.frombuffer(text.encode(), np.uint8)]]
            np.add.at(count[1 if label else 0], (seen[:-1], seen[1:]), 1)
        p = np.log(count / count.sum(2, keepdims=True))
        self.ratio = p[1] - p[0]

    def each(self, text: bytes, memory: int = 16) -> np.ndarray:
        """The ratio of every character, given the one before it.

        A pair of characters that was there within the last ``memory`` ones is no further
        sign of chance: patterns that repeat count once.
        """
        seen = np.r_[0, self.code[np.frombuffer(text, np.uint8)]]
        ratio = self.ratio[seen[:-1], seen[1:]]
        pair = seen[:-1] * len(self.ratio) + seen[1:]
        again = np.zeros(len(pair), bool)
        for back in range(1, min(memory, len(pair) - 1) + 1):
            again[back:] |= pair[back:] == pair[:-back]
        return np.where(again, np.minimum(ratio, 0), ratio)

    def __call__(self, text: bytes) -> float:
        return float(self.each(text).sum())


def segments(text: bytes, model: Markov, min_length: int, margin: float, rate: float) -> list[tuple[int, int]]:
    """``(start, end)`` of the secrets in a run of token characters, in order."""
    out, parts = [], [(0, len(text))]
    while parts:
        a, b = parts.pop()
        if b - a < min_length:
            continue
        ratio = model.each(text[a:b])
        if ratio.sum() > margin and ratio.sum() > rate * (b - a):
            out.append((a, b))
            continue
        # the segment of the highest sum above the rate, min_length characters or more
        above = np.r_[0, np.cumsum(ratio - rate)]
        low = np.minimum.accumulate(above[: len(above) - min_length])
        end = int(np.argmax(above[min_length:] - low)) + min_length
        start = int(np.argmin(above[: end - min_length + 1]))
        total = ratio[start:end].sum()
        if total <= margin or total <= rate * (end - start):
            continue
        s, e = a + start, a + end
        while s > a and text[s - 1 : s].isalnum():
            s -= 1
        while e < b and text[e : e + 1].isalnum():
            e += 1
        out.append((s, e))
        parts += [(a, s), (e, b)]
    return sorted(out)


def runs(raw: np.ndarray, at: np.ndarray, wanted: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end byte of the maximal runs of ``wanted`` that are ``least`` bytes or longer."""
    kind = np.zeros(256, bool)
    kind[list(wanted.encode())] = True
    inside = kind[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    long = stop - start >= least
    start, stop = start[long], stop[long]
    return np.searchsorted(at, start, "right") - 1, start, stop


def scan(texts: pa.Array, model: Markov, min_length: int, margin: float, rate: float) -> list[list[tuple[int, int, int]]]:
    """Per text, ``(start, kind, end)`` in code points; kinds by their place in ``KINDS``."""
    raw, at = text_bytes(texts)
    found: dict[int, list[tuple[int, int, int]]] = {}  # in bytes of the text
    for row, s, e in zip(*runs(raw, at, "0123456789abcdef", 24)):
        found.setdefault(int(row), []).append((int(s - at[row]), 2, int(e - at[row])))
    for row, s, e in zip(*runs(raw, at, string.ascii_uppercase + string.digits, 20)):
        k = raw[s:e].tobytes().find(b"AKIA")
        if k >= 0 and e - s - k >= 20:
            found.setdefault(int(row), []).append((int(s - at[row]) + k, 1, int(e - at[row])))
    may = pc.fill_null(pc.match_substring_regex(texts, MAY_ASSIGN), False)
    for row in np.flatnonzero(may.to_numpy(zero_copy_only=False)):
        text = texts[int(row)].as_py()
        point = byte = 0
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                byte += len(text[point : m.start()].encode())
                point = m.start()
                found.setdefault(int(row), []).append((byte, 0, byte + len(m[0].encode())))
    base = {row: sorted((s, e) for s, _, e in spans) for row, spans in found.items()}
    for spans in base.values():  # ends as far as any span before reaches, so that both ends ascend
        for k in range(1, len(spans)):
            spans[k] = spans[k][0], max(spans[k][1], spans[k - 1][1])
    for row, s, e in zip(*runs(raw, at, TOKEN, min_length)):
        row, a, b = int(row), int(s - at[row]), int(e - at[row])
        own = base.get(row, [])
        cuts = own[bisect_right(own, a, key=lambda z: z[1]) : bisect_left(own, b, key=lambda z: z[0])]
        open_ = [(a + m.start(), a + m.end()) for m in PUBLIC.finditer(raw[s:e].tobytes())]
        for x, y in [*(sorted(cuts + open_) if open_ else cuts), (b, b)]:
            if x - a >= min_length:
                part = raw[at[row] + a : at[row] + x].tobytes()
                for u, v in segments(part, model, min_length, margin, rate):
                    found.setdefault(row, []).append((a + u, 3, a + v))
            a = max(a, y)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for row, spans in found.items():
        body = raw[at[row] : at[row + 1]]
        point = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
        out[row] = sorted((int(point[s]), kind, int(point[e])) for s, kind, e in spans)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def secret_scan(
    docs: DataFrame, samples: list[tuple[str, int]] | None = None, min_length: int = 16, margin: float = 8.0, rate: float = 0.7
) -> DataFrame:
    """One row per text: counts of the base kinds, a digest of their spans, and all spans."""
    model = Markov(default_samples() if samples is None else samples)

    def f(part: pa.RecordBatch) -> dict:
        found = scan(part.column("text"), model, min_length, margin, rate)
        base = [[x for x in spans if x[1] < 3] for spans in found]
        return (
            {"doc_id": part.column("doc_id")}
            | {f"n_{KINDS[k]}": pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(3)}
            | {"base_sha256": [hashlib.sha256(written(x).encode()).hexdigest() for x in base], "spans": [written(x) for x in found]}
        )

    return map_slices(docs, ["doc_id", "text"], f, SCHEMA)


def redact(text: str | None, spans: str | None) -> str | None:
    """``text`` with every span of ``spans`` (as written above) replaced by ``[SECRET]``; overlapping spans as one."""
    if text is None or not spans:
        return text
    out, end = [], 0
    last = -1
    for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans.split(","))):
        if s > last:
            out += [text[end:s], "[SECRET]"]
        end = last = max(end, e)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, min_length: int = 16, margin: float = 8.0, rate: float = 0.7) -> DataFrame:
    """``docs`` with every span of its texts replaced; ``n_chars``, where there is one, follows the text."""
    model = Markov(default_samples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                found = scan(texts, model, min_length, margin, rate)
                if any(found):
                    clean = pa.array([redact(t, written(x)) for t, x in zip(texts.to_pylist(), found)], texts.type)
                    part = part.set_column(part.schema.get_field_index("text"), "text", clean)
                    at = part.schema.get_field_index("n_chars")
                    if at >= 0:
                        size = pc.if_else(pc.is_valid(clean), pc.utf8_length(clean).cast(part.column(at).type), part.column(at))
                        part = part.set_column(at, "n_chars", size)
                yield part
            release()

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES["op8_secret_scan"] = op8_secret_scan
