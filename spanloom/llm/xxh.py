"""XXH64 of many byte ranges of one buffer, in numpy."""

from __future__ import annotations

import numpy as np

# fixed values of the XXH64 specification
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def _reader(buffer: np.ndarray, kind: str):
    """Little-endian values at any byte offset; the buffer has eight spare bytes at its end."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buffer) - width + 1,), kind, buffer, 0, (1,))


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``buffer[start : start + length]`` for each range, as unsigned 64-bit values."""
    pad = np.zeros(len(buffer) + 8, np.uint8)
    pad[: len(buffer)] = buffer
    words, halves = _reader(pad, "<u8"), _reader(pad, "<u4")
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + P5, np.uint64)
        at = starts.astype(np.int64)
        left = lengths.astype(np.int64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            p, rest, who = at[long].copy(), left[long].copy(), np.arange(len(long))
            while len(who):
                for k in range(4):
                    acc[k][who] = _round(acc[k][who], words[p[who] + 8 * k])
                p[who] += 32
                rest[who] -= 32
                who = who[rest[who] >= 32]
            x = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * P1 + P4
            h[long] = x
            at[long], left[long] = p, rest
        h += lengths.astype(np.uint64)
        who = np.flatnonzero(left >= 8)
        while len(who):
            h[who] = _rotate(h[who] ^ _round(np.uint64(0), words[at[who]]), 27) * P1 + P4
            at[who] += 8
            left[who] -= 8
            who = who[left[who] >= 8]
        who = np.flatnonzero(left >= 4)
        if len(who):
            h[who] = _rotate(h[who] ^ (halves[at[who]].astype(np.uint64) * P1), 23) * P2 + P3
            at[who] += 4
            left[who] -= 4
        who = np.flatnonzero(left > 0)
        while len(who):
            h[who] = _rotate(h[who] ^ (pad[at[who]].astype(np.uint64) * P5), 11) * P1
            at[who] += 1
            left[who] -= 1
            who = who[left[who] > 0]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
