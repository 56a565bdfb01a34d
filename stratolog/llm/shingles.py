"""Word shingles of texts as sets of 64-bit hashes, computed on whole batches of bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is cut between words.
STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, at least n of each."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _UNDO)):
            x = np.full(max(n, STEP + 1), b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each lowered word of raw."""
    data = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[data], [True]))
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)])))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), start


def _pieces(raw: bytes):
    """raw in pieces of about STEP bytes, cut at white space; a longer word stays whole."""
    lo = 0
    while len(raw) - lo > STEP:
        hi = lo + STEP
        while hi < len(raw) and not _SPACE[raw[hi]]:
            hi += 1
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text)."""
    if sum(map(len, texts)) + len(texts) > STEP:
        if len(texts) > 1:
            parts = [word_hashes([t]) for t in texts]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        h = np.concatenate([_hashes(p)[0] for p in _pieces(texts[0])])
        return h, np.array([len(h)])
    h, start = _hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a shorter text has one, an empty one none."""
    out: list[np.ndarray] = []
    step, size = [], 0
    for t in [*texts, None]:
        if t is not None and (not step or size + len(t) < STEP):
            step.append(t)
            size += len(t) + 1
            continue
        if step:
            h, n = word_hashes(step)
            span = sum((np.roll(h, -k) * np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(words)), np.zeros(len(h), np.uint64))
            span, lo = mix(span), 0
            for k in n.tolist():
                if k >= words:
                    out.append(np.unique(span[lo : lo + k - words + 1]))
                elif k:
                    x = np.uint64(k)
                    for v in h[lo : lo + k].tolist():
                        x = mix(np.array([x], np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.array([v], np.uint64))[0]
                    out.append(np.array([x], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
                lo += k
        step, size = ([t], len(t) + 1) if t is not None else ([], 0)
    return out
