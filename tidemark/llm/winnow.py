"""Winnowed fingerprints of canonical text, made for whole Arrow batches at once."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one hashed piece of text, and pieces of one window of which the least hash is kept.
GRAM, WINDOW = 16, 6
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def canonical(c: Column) -> Column:
    """Lower-case words of letters and digits, one space apart; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _pieces(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every ``gram`` neighbouring bytes, from hashes of pieces of half the size."""
    with np.errstate(over="ignore"):
        base, size, part = np.uint64(1099511628211), 1, data + np.uint64(1)
        out, done = np.zeros(len(data) + 1, np.uint64), 0
        while True:
            if gram & size:  # this size is part of the whole: it stands in front of what there is
                rest = out[size : size + len(part)]
                out = part[: len(rest)] * _power(base, done) + rest
                done += size
            if size * 2 > gram:
                return out
            part = part[: len(part) - size] * _power(base, size) + part[size:]
            size *= 2


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(row, fingerprint)`` of canonical texts, each fingerprint once per row, rows ascending.

    Spaces do not count. Of every ``window`` neighbouring pieces of ``gram`` bytes the least hash is kept, so two
    texts with ``gram + window - 1`` bytes in common share a fingerprint. A text shorter than one piece is hashed
    whole; an empty one has no fingerprint.
    """
    raw = [t.replace(" ", "").encode() for t in texts]
    pad = bytes(gram + window)
    data = np.frombuffer(pad.join(raw) + pad, dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.concatenate(([0], np.cumsum(size + len(pad))[:-1])) if len(raw) else np.zeros(0, np.int64)
    n = max(0, len(data) - gram + 1)
    h = mix(_pieces(data, gram)[:n])
    grams = np.maximum(size - gram + 1, 0)
    end = np.repeat(start + grams, size + len(pad))[:n]  # first position after the row's pieces
    at = np.arange(n)
    h[at >= end] = _TOP
    least = h.copy()
    done = 1
    while done < window:  # windows of twice the size, then the rest
        step = min(done, window - done)
        np.minimum(least[: n - step], least[step:].copy(), out=least[: n - step])
        done += step
    row = np.repeat(np.arange(len(raw)), size + len(pad))[:n]
    ok = (at + window <= end) | ((at == start[row]) & (grams[row] > 0))
    row, least = row[ok], least[ok]
    changed = np.ones(len(row), bool)  # neighbouring windows mostly keep the same hash
    changed[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    row, least = row[changed], least[changed]
    short = [i for i, b in enumerate(raw) if 0 < len(b) < gram]
    if short:
        row = np.concatenate((row, np.array(short, dtype=row.dtype)))
        least = np.concatenate((least, np.array([int.from_bytes(hashlib.blake2b(raw[i], digest_size=8).digest(), "little") for i in short], np.uint64)))
    order = np.lexsort((least, row))
    row, least = row[order], least[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    return row[new], least[new].view(np.int64)
