"""Digests of a batch: a text at a time as a string, and the same minima as by the plain rule."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from spanloom.functions import digests


def test_a_batch_is_not_held_as_strings():
    texts = pa.array([f"{k} " + "word " * 2000 for k in range(1000)])
    digests.normalized_digest.func(texts.slice(0, 2))
    tracemalloc.start()
    digests.normalized_digest.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 5


def test_signature_is_that_of_the_word_windows():
    for text in ("", " ", "a", "a b c d", "a b c d e", "ß é x  y z w", "one two three four five six one two three four five"):
        words = text.split()
        windows = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
        hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in windows]
        want = [min(h ^ int(m) for h in hashes) for m in digests.masks(32)]
        assert digests.signature_of(text, 32, 5).tolist() == want == np.array(want, np.uint64).tolist()
