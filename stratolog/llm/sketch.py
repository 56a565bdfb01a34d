"""SetSketch registers: exponentially spaced, truncated minima of a set's hashes.

Each element draws a rising sequence of exponential values for the registers in an order of its own; a
register holds the level of its smallest value, on a scale whose steps grow by BASE. Merging is the larger
of two registers. An element stops as soon as its values exceed all of the set's minima.
"""

from __future__ import annotations

import numpy as np

from stratolog.llm.shingles import mix

REGISTERS, BASE, RATE = 256, 1.001, 20.0
_TOP = 65535


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (uint16) per set; an empty set's are 0. registers is a power of two."""
    n = np.array([len(s) for s in sets], np.int64)
    low = np.full(len(sets) * registers, np.inf)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets), dtype=np.int64), n)
    own = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    factor, shift = (own >> np.uint64(32)).astype(np.int64) | 1, (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
    x = np.zeros(len(h))
    for j in range(registers):
        if not len(h):
            break
        x = x - np.log(_uniform(mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))) / (registers - j)
        at = doc * registers + (factor * j + shift) % registers
        np.minimum.at(low, at, x)
        if j < 2 or j % 2 == 0:
            worst = low.reshape(-1, registers).max(axis=1)
            go = x < worst[doc]
            h, doc, factor, shift, x = h[go], doc[go], factor[go], shift[go], x[go]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(low / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(low), 0, level), 0, _TOP).astype(np.uint16).reshape(-1, registers)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of so many registers; the band's number is part of the key."""
    bands = regs.shape[1] // rows
    r = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(regs), bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + r[:, :, k])
    return key


def likely_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float, margin: float = 16.0) -> np.ndarray:
    """Whether a Jaccard similarity of at least so much is plausible for each pair of rows.

    The joint likelihood of the counts of larger, smaller and equal registers, given the sets' sizes, is
    taken over a grid of similarities. A pair is dropped only if every similarity from the threshold on is
    e**margin times less likely than the likeliest.
    """
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 81)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12
    p_up, p_down = np.maximum(p(u[:, None] - v[:, None] * grid), tiny), np.maximum(p(v[:, None] - u[:, None] * grid), tiny)
    like = up * np.log(p_up) + down * np.log(p_down) + same * np.log(np.maximum(1 - p_up - p_down, tiny))
    fit = np.where(grid >= similarity - 0.02, like, -np.inf).max(axis=1)
    return (top >= similarity - 1e-9) & (fit > like.max(axis=1) - margin)
