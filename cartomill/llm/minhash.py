"""Weighted shingle bags of whole texts and their consistent weighted samples, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SHINGLE = 5
BANDS, ROWS = 12, 4
#: Shingles in at most this share of all documents, or in two of them, have the largest weight; only those above it are
#: looked up.  Lower shares would let the few words that change within a large group of copies outweigh all they share.
FREQUENT = 0.001
#: Bytes of text that are worked on at once.
BYTES = 1 << 20
_U64 = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U64)


def mixed(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> _U64(33))
    z *= _U64(0xFF51AFD7ED558CCD)
    z ^= z >> _U64(29)
    z *= _U64(0xC4CEB9FE1A85EC53)
    z ^= z >> _U64(32)
    return z


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _powered(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse mod 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, _U64), np.full(n - 1, base, _U64)]))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end in ``data`` (UTF-8), each word's hash, start and end, and each text's number of words.

    Hashes are differences of a running polynomial.
    """
    space = _SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = True, space
    after = before[1:].copy()
    after[:-1] = space[1:]
    after[-1:] = True
    cut = ends[:-1]
    before[cut[cut < len(data)]] = True
    after[cut[(cut > 0) & (cut <= len(data))] - 1] = True
    start, end = np.flatnonzero(~space & before[:-1]), np.flatnonzero(~space & after) + 1
    power, inverse = _powered(len(data))
    run = np.empty(len(data) + 1, _U64)
    run[0] = 0
    np.cumsum((data.astype(_U64) + _U64(1)) * power, out=run[1:])
    h = (run[end] - run[start]) * inverse[start] + (end - start).astype(_U64)
    return mixed(h), start, end, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of an Arrow array of strings without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text (none null), the hashes of its runs of SHINGLE words; one of all words for a shorter text, none for one without words.

    Words are runs of bytes other than ASCII white space.  Works on blocks of whole texts.
    """
    if not len(texts):
        return
    data, offsets = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, side="right")) - 1)
        h, _, _, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
        run = h[: max(0, len(h) - SHINGLE + 1)] * _MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            run += h[k : k + len(run)] * _MULTIPLIERS[k]
        run = mixed(run)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                yield run[at : at + n - SHINGLE + 1]
            else:
                few = h[at : at + n]
                yield mixed(np.array([(few * _MULTIPLIERS[:n]).sum() + _U64(n)], _U64)) if n else few
            at += n
        lo = hi


class Weights:
    """Weight of a shingle: its count times 1 + ln(1 / max(share of documents, floor))."""

    def __init__(self, frequent: np.ndarray, shares: np.ndarray, floor: float = FREQUENT) -> None:
        order = np.argsort(frequent)
        self.at, self.idf = frequent[order], (1 - np.log(np.maximum(shares[order], floor))).astype(np.float32)
        self.rare = np.float32(1 - np.log(floor))

    def bag(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, n = np.unique(hashes, return_counts=True)
        w = np.full(len(s), self.rare, np.float32)
        if len(self.at) and len(s):
            i = np.minimum(np.searchsorted(self.at, s), len(self.at) - 1)
            hit = self.at[i] == s
            w[hit] = self.idf[i[hit]]
        return s, w * n.astype(np.float32)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j], dtype=np.float64).sum()
    every = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both
    return float(both / every) if every > 0 else 0.0


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 steps, by Newton's method."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
        x = np.minimum(x, 40)
    return x.astype(np.float32)


_R = _gamma2()
_INVERSE = (1 / _R).astype(np.float32)
_E = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
#: Shingles that are sampled at once.
BLOCK = 3000


def bands(bags: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Band keys (int64) of each bag by improved consistent weighted sampling; none for an empty bag.

    For each of BANDS * ROWS samples a shingle of weight w draws r and c from Gamma(2, 1)
    and b from the uniform distribution, all fixed by its hash; t = floor(ln w / r + b);
    the sample is the (shingle, t) with the least ln c - r (t - b) - r.
    """
    at = 0
    while at < len(bags):
        end, size = at, 0
        while end < len(bags) and (size == 0 or size + len(bags[end][0]) <= BLOCK):
            size += len(bags[end][0])
            end += 1
        part = bags[at:end]
        some = [i for i, b in enumerate(part) if len(b[0])]
        keys: dict[int, np.ndarray] = {}
        if some:
            keys = dict(zip(some, _sampled([part[i] for i in some]), strict=True))
        for i in range(len(part)):
            yield keys.get(i, np.zeros(0, np.int64))
        at = end


def _sampled(part: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bags of a block together; a bag beyond BLOCK is sampled in pieces, of which the least counts."""
    if len(part) == 1 and len(part[0][0]) > BLOCK:
        s, w = part[0]
        best, picked = _least(s[:BLOCK], w[:BLOCK], np.zeros(1, np.int64))
        for k in range(BLOCK, len(s), BLOCK):
            b, p = _least(s[k : k + BLOCK], w[k : k + BLOCK], np.zeros(1, np.int64))
            picked, best = np.where(b < best, p, picked), np.minimum(b, best)
    else:
        starts = np.cumsum([0, *[len(b[0]) for b in part[:-1]]])
        _, picked = _least(np.concatenate([b[0] for b in part]), np.concatenate([b[1] for b in part]), starts)
    rows = picked.reshape(BANDS, ROWS, -1)
    key = np.arange(1, BANDS + 1, dtype=_U64)[:, None] * _U64(0x2545F4914F6CDD1D)
    for k in range(ROWS):
        key = mixed(key ^ (rows[:, k] * _MULTIPLIERS[k]))
    return key.T.view(np.int64) if key.T.flags.c_contiguous else np.ascontiguousarray(key.T).view(np.int64)


#: One-bit samples in a sketch.
SKETCH = 384
_SKETCH_SEEDS = mixed(np.arange(1001, 1001 + SKETCH, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def sketch(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """SKETCH / 64 longs (int64), a bit of each of as many samples: two bags' bits agree with probability (1 + similarity) / 2."""
    s, w = bag
    bits = []
    for at in range(0, SKETCH, 48):
        best = picked = None
        for k in range(0, max(1, len(s)), BLOCK):
            b, p = _least(s[k : k + BLOCK], w[k : k + BLOCK], np.zeros(1, np.int64), _SKETCH_SEEDS[at : at + 48])
            picked, best = (p, b) if best is None else (np.where(b < best, p, picked), np.minimum(b, best))
        bits.append((mixed(picked[:, 0]) >> _U64(63)).astype(np.uint8))
    return np.packbits(np.concatenate(bits)).view(np.int64)


def _least(s: np.ndarray, w: np.ndarray, starts: np.ndarray, seeds: np.ndarray = _SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Least value and a 64-bit name of the sample, (samples x bags)."""
    z = (s[None] ^ seeds[:, None]) * _U64(0x9E3779B97F4A7C15)
    z ^= z >> _U64(32)
    z *= _U64(0xD6E8FEB86659FD93)
    f = z.view(np.uint16).reshape(*z.shape, 4)
    r, beta = _R[f[..., 3]], _BETA[f[..., 2]]
    t = np.log(w)[None] * _INVERSE[f[..., 3]]
    t += beta
    np.floor(t, out=t)
    value = np.log(_E[f[..., 1]] + _E[f[..., 0]])
    value -= (t - beta + np.float32(1)) * r
    best = np.minimum.reduceat(value, starts, axis=1)
    sizes = np.diff(np.append(starts, len(s)))
    k, at = np.nonzero(value == np.repeat(best, sizes, axis=1))
    bag = np.repeat(np.arange(len(starts)), sizes)[at]
    picked = np.zeros(best.shape, _U64)
    picked[k[::-1], bag[::-1]] = (mixed(s) [at] + t[k, at].astype(np.int64).view(_U64) * _U64(0x632BE59BD9B4E019))[::-1]
    return best, picked
