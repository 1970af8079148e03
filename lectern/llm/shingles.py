"""Word shingles of many texts at once as 64-bit numbers, by numpy over the bytes of a whole batch."""

from __future__ import annotations

import numpy as np

from lectern.llm.token_store import mixed_bits

_PRIME, _INVERSE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64; kept for the next batch."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(n + n // 8, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, A-Z lower-cased; words are runs without ASCII white space."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = mixed_bits((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return hashes, np.searchsorted(begins, starts, "right") - 1


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``words`` words of each text; fewer words give one shingle of them all, none give none."""
    hashes, owner = word_hashes(texts)
    weights = mixed_bits(np.arange(1, words + 1)) | np.uint64(1)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        total += hashes[k : k + len(total)] * weights[k]
    total = mixed_bits(total)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(total[a : b - words + 1]))
        elif b > a:
            out.append(mixed_bits((hashes[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
