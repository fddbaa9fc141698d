"""Toxicity: a bidirectional gated recurrent network over words and their characters.

A word's input is the embedding of its hashed spelling joined to the mean embedding of
its hashed character n-grams. Two gated recurrent layers read a window of words in both
directions, attention pools their states, and a logistic unit scores the window. All of
it, gradients included, is numpy. A text's score is the highest over all of its
overlapping windows, the last of which ends at the text's end.

Training takes a bounded number of labelled documents of each class and a bounded number
of windows of each, both by hash. Labels are of documents, so windows of a toxic document
that the network itself finds clean after the first pass count as clean from then on,
except its highest one.

Defined results: null and empty texts get the score of an empty window; texts of any length
are scored in all of their windows; repeated rows get equal scores; a score of one half is
toxic; documents of equal hash are taken in the order of their ids; rows with a null doc_id are scored and count as neither held out nor used
in training; where a class has no labelled rows the score is the share of toxic ones;
labels that are null are not used; several labels of one document all count; an empty
table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import SLICE_BYTES, codes, map_slices, split_words, table, text_bytes
from spanloom.llm.registry import QUERIES
from spanloom.llm.xxh import xxh64

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD_BITS, GRAM_BITS = 15, 12
WORD_DIM, GRAM_DIM = 8, 12
HIDDEN, ATTENTION = 8, 8
EMPTY_ID = 0


def featurise(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: the hashed spelling, and hashed character n-grams with their word.

    Letters are lower-cased and punctuation at the ends dropped first. N-grams are the
    three-byte windows of ``<word>``.
    """
    plain = pc.ascii_trim(pc.ascii_lower(words), "\"'`.,;:!?()[]{}<>#*$%&|~^=+-_/\\")
    if not len(plain):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = pc.binary_join_element_wise("<", plain, ">", "")
    raw, at = text_bytes(marked)
    word = (xxh64(raw, at[:-1], np.diff(at), 11) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    sizes = np.maximum(np.diff(at) - 2, 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[:-1][owner]
    gram = xxh64(raw, start, np.minimum(3, at[1:][owner] - start), 13) & np.uint64((1 << GRAM_BITS) - 1)
    return word, gram.astype(np.int64), owner


def windows(rows: np.ndarray, n: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; a text without words has one empty window."""
    count = np.bincount(rows, minlength=n)
    base = np.cumsum(count) - count
    k = np.where(count > size, -(-(count - size) // step) + 1, 1)
    text = np.repeat(np.arange(n), k)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    start = np.minimum(nth * step, np.maximum(count[text] - size, 0))
    return base[text] + start, np.minimum(count[text], size), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward and backward passes; float32 throughout."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + GRAM_DIM

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "words": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32),
            "grams": (0.3 * rng.standard_normal((1 << GRAM_BITS, GRAM_DIM))).astype(np.float32),
            "wx": normal(inputs, 6 * HIDDEN),
            "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": normal(HIDDEN, 3 * HIDDEN),
            "ub": normal(HIDDEN, 3 * HIDDEN),
            "wa": normal(2 * HIDDEN, ATTENTION),
            "va": normal(ATTENTION, 1)[:, 0],
            "wo": normal(2 * HIDDEN, 1)[:, 0],
            "bo": np.zeros(1, np.float32),
        }

    def inputs(self, word: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words; row 0 stands for no word."""
        x = np.zeros((len(word) + 1, WORD_DIM + GRAM_DIM), np.float32)
        x[1:, :WORD_DIM] = self.p["words"][word]
        if len(word):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            share = np.diff(np.r_[first, len(owner)])[:, None]
            x[1:, WORD_DIM:] = np.add.reduceat(self.p["grams"][gram], first) / share
        return x

    def scan(self, g: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
        """States (time, window, unit) of one direction; ``g`` holds projected inputs."""
        steps, n = mask.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            a = h @ u
            rz = _sigmoid(g[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = np.tanh(g[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, r, z, c, a[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits; ``at`` (time, window) points into the rows of ``x``."""
        p, half = self.p, 3 * HIDDEN
        mask = (np.arange(len(at))[:, None] < length[None, :]).astype(np.float32)
        proj = x @ p["wx"] + p["bx"]
        g = proj[at]
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.scan(g[:, :, :half], p["uf"], mask, False, kf), self.scan(g[:, :, half:], p["ub"], mask, True, kb)], axis=2)
        q = np.tanh(h @ p["wa"])
        e = np.where(mask > 0, q @ p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        weight = e * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, h)
        if keep is not None:
            keep |= {"mask": mask, "kf": kf, "kb": kb, "h": h, "q": q, "weight": weight, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"][0]

    def backward(self, d: np.ndarray, x: np.ndarray, at: np.ndarray, k: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of ``x`` from those of the logits."""
        p, half, h, weight, q = self.p, 3 * HIDDEN, k["h"], k["weight"], k["q"]
        out = {"wo": k["pooled"].T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * p["wo"]
        dh = weight[:, :, None] * dp
        dw = np.einsum("tnh,nh->tn", h, dp)
        de = weight * (dw - (weight * dw).sum(0))
        out["va"] = np.einsum("tna,tn->a", q, de)
        dq = de[:, :, None] * p["va"] * (1 - q * q)
        out["wa"] = np.einsum("tnh,tna->ha", h, dq)
        dh += dq @ p["wa"].T
        dg = np.empty((*at.shape, 6 * HIDDEN), np.float32)
        for name, kept, lo in (("uf", k["kf"], 0), ("ub", k["kb"], 1)):
            u, du, carry = p[name], np.zeros_like(p[name]), 0
            for t, prev, r, z, c, ac, m in reversed(kept):
                dn = dh[t, :, lo * HIDDEN : (lo + 1) * HIDDEN] + carry
                dz = -m * dn * (c - prev) * z * (1 - z)
                dc = m * dn * (1 - z) * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate([dr, dz, dc * r], axis=1)
                dg[t, :, lo * half : (lo + 1) * half] = np.concatenate([dr, dz, dc], axis=1)
                du += prev.T @ da
                carry = dn * (1 - m * (1 - z)) + da @ u.T
            out[name] = du
        flat, to = dg.reshape(-1, 6 * HIDDEN), at.ravel()
        by = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0])
        dproj = np.zeros((len(x), 6 * HIDDEN), np.float32)
        dproj[to[by][first]] = np.add.reduceat(flat[by], first)
        out["wx"], out["bx"] = x.T @ dproj, dproj.sum(0)
        return out, dproj @ p["wx"].T


class Words:
    """Texts of a slice as distinct words with their features, and each word's place among them."""

    def __init__(self, texts: pa.Array) -> None:
        self.rows, words = split_words(texts)
        code, kinds = codes(words)
        self.code = code + 1
        self.features = featurise(kinds)
        self.n = len(texts)

    def grid(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(time, window) places in the input rows, row 0 behind a window's end."""
        t = np.arange(max(int(length.max(initial=0)), 1))[:, None]
        inside = t < length[None, :]
        if not len(self.code):
            return np.zeros(inside.shape, np.int64)
        return np.where(inside, self.code[np.minimum(first[None, :] + t, len(self.code) - 1)], 0)


def _pick(features: tuple[np.ndarray, np.ndarray, np.ndarray], who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words ``who`` only."""
    word, gram, owner = features
    place = np.full(len(word), -1)
    place[who] = np.arange(len(who))
    mine = place[owner] >= 0
    return word[who], gram[mine], place[owner[mine]]


def train(
    texts: list[str], doc: np.ndarray, label: np.ndarray,
    epochs: int = 5, batch: int = 128, rate: float = 0.01,
    seed: int = 5, min_docs: int = 6, drop: float = 0.1, least_steps: int = 300,
) -> Network:
    """Fit on windows: each text is one window of the document ``doc`` with its ``label``.

    Hashed spellings and n-grams of fewer than ``min_docs`` training documents keep their
    first values, and a share ``drop`` of the words is hidden at each step, so that noisy
    labels are not learnt by heart from rare words. Few windows are gone through more often,
    for ``least_steps`` steps in all.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    data = Words(pa.array(texts, pa.string()))
    size = np.bincount(data.rows, minlength=data.n)
    base = np.cumsum(size) - size
    target = label.astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    word, gram, owner = data.features
    place = np.unique(doc[data.rows] * (len(word) + 1) + data.code)
    pair = place // (len(word) + 1), place % (len(word) + 1) - 1
    common = {"words": _documents(pair[0], word[pair[1]], 1 << WORD_BITS) >= min_docs}
    sizes = np.bincount(owner, minlength=len(word))
    first = np.cumsum(sizes) - sizes
    many = sizes[pair[1]]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    common["grams"] = _documents(np.repeat(pair[0], many), gram[np.repeat(first[pair[1]], many) + nth], 1 << GRAM_BITS) >= min_docs
    step = 0
    for epoch in range(max(epochs, -(-least_steps * batch // max(data.n, 1)))):
        if epoch:
            score = _logits(net, data, base, size)
            best = np.full(doc.max() + 1, -np.inf, np.float32)
            np.maximum.at(best, doc, score)
            target = np.where((label == 1) & ((score > 0) | (score >= best[doc])), 1, 0).astype(np.float32)
        order = rng.permutation(data.n)
        for at in range(0, data.n, batch):
            own = order[at : at + batch]
            grid = data.grid(base[own], size[own])
            grid[rng.random(grid.shape) < drop] = 0
            who, places = np.unique(grid, return_inverse=True)
            who, places = (who[1:], places) if who[0] == 0 else (who, places + 1)
            word, gram, owner = _pick(data.features, who - 1)
            x, keep = net.inputs(word, gram, owner), {}
            places = places.reshape(grid.shape)
            d = (_sigmoid(net.forward(x, places, size[own], keep)) - target[own]) / len(own)
            grads, dx = net.backward(d, x, places, keep)
            dx = dx[1:]
            share = np.bincount(owner, minlength=len(word)).clip(1)[:, None]
            grads["words"] = (word, dx[:, :WORD_DIM])
            grads["grams"] = (gram, (dx[:, WORD_DIM:] / share)[owner])
            step += 1
            for name, g in grads.items():
                if isinstance(g, tuple):
                    mine = common[name][g[0]]
                    rows, back = np.unique(g[0][mine], return_inverse=True)
                    total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                    np.add.at(total, back, g[1][mine])
                    g, place = total, rows
                else:
                    place = slice(None)
                first, second = moments[name]
                first[place] = 0.9 * first[place] + 0.1 * g
                second[place] = 0.99 * second[place] + 0.01 * g * g
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[name][place] -= rate * fix * first[place] / (np.sqrt(second[place]) + 1e-6)
    return net


def _documents(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Number of documents of each key."""
    return np.bincount(np.unique(doc * n + key) % n, minlength=n)


def _logits(net: Network, data: Words, first: np.ndarray, length: np.ndarray, batch: int = 1024) -> np.ndarray:
    """Logit of each window; windows of like length run together."""
    x = net.inputs(*data.features)
    out = np.empty(len(first), np.float32)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        out[own] = net.forward(x, data.grid(first[own], length[own]), length[own])
    return out


def score_texts(net: Network, texts: pa.Array, size: int, step: int) -> np.ndarray:
    """Highest window score of each text."""
    data = Words(texts)
    first, length, text = windows(data.rows, data.n, size, step)
    best = np.full(data.n, -np.inf, np.float32)
    np.maximum.at(best, text, _logits(net, data, first, length))
    return _sigmoid(best.astype(np.float64))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame, per_class: int, per_doc: int, size: int, seed: int = 3) -> DataFrame:
    """``(doc_id, toxic, text)``: up to ``per_doc`` windows of up to ``per_class`` toxic documents and three times as many others."""
    free = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))

    def some(toxic: int, n: int) -> DataFrame:
        return free.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)

    # bounded: four times per_class rows
    chosen = some(0, 3 * per_class).unionByName(some(1, per_class)).withColumnRenamed("doc_id", "labelled_id")
    own = docs.select("doc_id", "text")  # further columns may share a name with those of the labels
    mine = own.join(F.broadcast(chosen), own["doc_id"] == chosen["labelled_id"]).select("doc_id", "toxic", "text")

    def f(part: pa.RecordBatch) -> dict:
        rows: list[int] = []
        out: list[str] = []
        for row, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
            words = (text or "").encode().split()
            starts = list(range(0, max(len(words) - size, 0) + 1, size)) or [0]
            if len(starts) > per_doc:
                starts = np.random.default_rng((seed, abs(doc))).choice(starts, per_doc, replace=False).tolist()
            out += [b" ".join(words[s : s + size]).decode() for s in sorted(starts)]
            rows += [row] * len(starts)
        take = pa.array(rows, pa.int64())
        return {"doc_id": part.column("doc_id").take(take), "toxic": part.column("toxic").take(take), "text": pa.array(out, pa.string())}

    return map_slices(mine, ["doc_id", "toxic", "text"], f, "doc_id long, toxic int, text string")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, per_doc: int = 4, size: int = 48) -> Network | float:
    """Train on the driver: at most 4 * per_class * per_doc windows of ``size`` words reach it."""
    got = training_windows(docs, labels, per_class, per_doc, size).toPandas().sort_values(["doc_id", "toxic", "text"])
    label = got["toxic"].to_numpy(dtype=np.int64)
    if not len(label) or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.0
    return train(got["text"].tolist(), np.unique(got["doc_id"].to_numpy(), return_inverse=True)[1], label)


def toxicity(docs: DataFrame, model: Network | float, size: int = 48, step: int = 32) -> DataFrame:
    """``(doc_id, score)`` over all windows of every whole text."""

    def f(part: pa.RecordBatch) -> dict:
        n = part.num_rows
        score = np.full(n, model) if isinstance(model, float) else score_texts(model, part.column("text"), size, step)
        return {"doc_id": part.column("doc_id"), "score": score}

    return map_slices(docs, ["doc_id", "text"], f, "doc_id long, score double", limit=SLICE_BYTES // 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op10_toxicity"] = op10_toxicity
