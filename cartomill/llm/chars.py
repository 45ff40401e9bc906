"""Whole texts as arrays of code points, and hashed character n-gram counts of them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points below this are looked up; those above count as letters if Python says so, which is asked for each distinct one.
TABLE = 0x3000
#: Characters that are worked on at once.
CHUNK = 1 << 20


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _folded() -> np.ndarray:
    out = np.zeros(TABLE, np.uint32)
    for i in range(TABLE):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


FOLDED = _folded()


def letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters; 0 for whatever isn't one."""
    out = FOLDED[np.minimum(codes, TABLE - 1)]
    if len(high := np.flatnonzero(codes >= TABLE)):
        out = out.copy()
        for c in np.unique(codes[high]):
            out[codes == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
    return out


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about CHUNK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 2
    if at < len(texts):
        yield at, len(texts)


def ngram_counts(texts: Sequence[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x dims, float32) of hashed letter 1-, 2- and 3-grams within and at the ends of words; number of letters."""
    joined = letters(points("\n".join(["", *texts, ""])))
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    a, b, c = joined[:-2], joined[1:-1], joined[2:]
    a, b, c = a[: len(doc)], b[: len(doc)], c[: len(doc)]
    doc = doc[: len(b)]
    mask = np.uint32(dims - 1)
    mixed = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(8)
    two = b * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77)
    kept = b > 0
    out = np.zeros(len(texts) * dims, np.float32)
    for h, ok in ((mixed(b * np.uint32(0x27D4EB2F)), kept), (mixed(two), kept | (c > 0)), (mixed(two + a * np.uint32(0xC2B2AE3D)), kept)):
        out += np.bincount((doc * dims + (h & mask))[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), dims), np.bincount(doc[kept], minlength=len(texts))
