"""A run-length Burrows-Wheeler index of many short strings, and the matching statistics it streams.

The strings are sorted by document. The transform is kept as runs of equal symbols, cut where the first
symbol of the suffixes changes as well; the suffix array goes once the ends of the runs have been sampled.
A run's samples are the rows from whose side no smaller document lies nearer to that end: going up, the
last row of a document below d is one of them, and going down the first one, whatever d is.

A string is read backwards, from the last place where a match of the wanted length can start; its row there
and the nearest rows of smaller documents above and below are sampled too. Of the two one has the longest
match. One step back, a row that is preceded by the same symbol steps along; otherwise the nearest run of
that symbol with a smaller document gives its sample, and the match is measured in the text. So the lengths
are those of the longest match with smaller documents, exactly, and strings are compared byte by byte.
"""

from __future__ import annotations

import numpy as np


def suffix_rows(text: np.ndarray, left: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of text in the order of their suffixes, each up to its string's end; ties by position.

    left is the number of symbols from each position to its string's end mark, which is 0 in text. Ranks
    of prefixes are doubled in length until they settle.
    """
    bits = max(1, int(symbols).bit_length())
    per = 63 // bits
    key, n = np.zeros(len(text), np.uint64), len(text)
    for j in range(min(per, n)):
        key <<= np.uint64(bits)
        key[: n - j] |= np.where(left[: n - j] >= j, text[j:], 0).astype(np.uint64)
    most, groups = int(left.max()) + 1, 0
    while True:
        order = np.argsort(key)
        ks = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate((np.zeros(1, np.int64), np.cumsum(ks[1:] != ks[:-1]))) + 1
        now = int(rank[order[-1]])
        if per >= most or now in (n, groups):
            return (np.sort(rank << np.uint64(32) | np.arange(n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        groups = now
        key = rank << np.uint64(32)
        key[: max(n - per, 0)] |= np.where(left[: max(n - per, 0)] >= per, rank[per:], 0).astype(np.uint64)
        per *= 2


class _Nearest:
    """Nearest entry below a bound, to the left or right of a place, by minima of doubling widths."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << len(self.levels) - 1) <= len(values):
            x, k = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(x[: len(x) - k], x[k:]))

    def left(self, at: np.ndarray, least: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest place in [least, at] whose value is below bound; below least where there is none."""
        at = at.copy()
        go = np.flatnonzero((at >= least) & (self.levels[0][np.maximum(at, 0)] >= bound))
        for k in range(len(self.levels) - 1, -1, -1):
            if not len(go):
                break
            low = at[go] - (1 << k) + 1
            skip = (low >= least[go]) & (self.levels[k][np.maximum(low, 0)] >= bound[go])
            at[go[skip]] = low[skip] - 1
        return at

    def right(self, at: np.ndarray, most: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest place in [at, most) whose value is below bound; most or more where there is none."""
        at, n = at.copy(), len(self.levels[0])
        go = np.flatnonzero((at < most) & (self.levels[0][np.minimum(at, n - 1)] >= bound))
        for k in range(len(self.levels) - 1, -1, -1):
            if not len(go):
                break
            end = at[go] + (1 << k)
            skip = (end <= most[go]) & (self.levels[k][np.minimum(at[go], len(self.levels[k]) - 1)] >= bound[go])
            at[go[skip]] = end[skip]
        return at


class RunIndex:
    """Index of the strings that follow each other in data, for matches of `least` symbols or more.

    docs, one of each string, are in order. asked are the strings to be looked for, by default all.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, docs: np.ndarray, least: int, asked: np.ndarray | None = None):
        lengths = np.asarray(lengths, np.int64)
        s = len(lengths)
        self.of = np.concatenate(([0], np.cumsum(docs[1:] != docs[:-1]))).astype(np.int64)
        ends = np.cumsum(lengths + 1) - 1
        here = np.zeros(256, bool)
        here[data] = True
        symbols = int(here.sum())
        text = np.zeros(len(data) + s, np.uint8 if symbols < 256 else np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.cumsum(here)[data]
        which = np.repeat(np.arange(s, dtype=np.int32), lengths + 1)
        rows = suffix_rows(text, (ends.astype(np.int32)[which] - np.arange(len(text), dtype=np.int32)), symbols)
        # the transform as runs
        before = np.where(np.concatenate(([True], ~inside[:-1])), 0, np.concatenate((text[:1], text[:-1])))[rows]
        head = text[rows]
        new = np.concatenate(([True], (before[1:] != before[:-1]) | (head[1:] != head[:-1])))
        self.start = np.flatnonzero(new).astype(np.int32)
        # the heads of the runs as bits, with the number of those before each word
        self.heads = np.packbits(np.concatenate((new, np.zeros(64 + -len(new) % 64, bool))), bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.heads), dtype=np.int64)[:-1])) - 1
        self.symbol = before[self.start].astype(np.int64)
        self.size, runs = len(text), len(self.start)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1)))).astype(np.int32)
        length = np.diff(np.append(self.start, self.size))
        by = np.argsort(self.symbol, kind="stable")
        self.back = np.empty(runs, np.int64)
        self.back[by] = np.cumsum(length[by]) - length[by]
        # samples of the runs' ends
        own, run, far = self.of[which[rows]], np.cumsum(new) - 1, np.int64(s + 1)
        low = np.minimum.accumulate((own + run * far)[::-1])[::-1]
        up = np.concatenate((low[:-1] < low[1:], [True])) if len(low) else np.zeros(0, bool)
        up[np.append(self.start[1:], self.size) - 1] = True
        self.up_key, self.up_row, self.up_at = (run * far + own)[up], np.flatnonzero(up), rows[up]
        low = np.minimum.accumulate(own - run * far)
        down = np.concatenate(([True], low[1:] < low[:-1]))
        self.down_key, self.down_row, self.down_at = (run * far + (s - own))[down], np.flatnonzero(down), rows[down]
        self.far, self.strings = far, s
        # runs by symbol, with the smallest document of each
        self.by, self.by_key = by, self.symbol[by] * (runs + 1) + by
        self.group = np.searchsorted(self.symbol[by], np.arange(symbols + 2))
        self.nearest = _Nearest(np.minimum.reduceat(own, self.start)[by])
        self.text = np.concatenate((text, np.zeros(8, text.dtype)))
        # the last places of the strings asked for, longest strings first, and their neighbours
        asked = np.arange(s) if asked is None else np.asarray(asked)
        asked = asked[lengths[asked] >= least]
        self.asked = asked[np.argsort(-lengths[asked], kind="stable")]
        self.steps, self.least = lengths[self.asked] - least, least
        self.at = ends[self.asked] - least
        row_of = np.empty(self.size, np.int32)
        row_of[rows] = np.arange(self.size, dtype=np.int32)
        self.row = row_of[self.at].astype(np.int64)
        near, d = _Nearest(own.astype(np.int32)), self.of[self.asked]
        up = near.left(self.row - 1, np.zeros(len(d), np.int64), d)
        down = near.right(self.row + 1, np.full(len(d), self.size), d)
        self.sides = [(np.maximum(up, 0), up >= 0), (down, down < self.size)]
        self.places = [rows[np.minimum(x, self.size - 1)].astype(np.int64) for x, _ in self.sides]

    def _run(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (row & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.heads[word] & upto)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common text from a and from b, neither beyond its string's end."""
        n, go, eight = np.zeros(len(a), np.int32), np.arange(len(a)), np.arange(8)
        while len(go):
            x = self.text[(a[go] + n[go])[:, None] + eight]
            y = self.text[(b[go] + n[go])[:, None] + eight]
            differ = (x != y) | (x == 0)
            whole = ~differ.any(axis=1)
            n[go] += np.where(whole, 8, differ.argmax(axis=1)).astype(np.int32)
            go = go[whole]
        return n

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of each place that has a match of the wanted length with a smaller document."""
        m = np.searchsorted(-self.steps, -np.arange(1, int(self.steps.max(initial=0)) + 1), "right")
        d, row, at = self.of[self.asked], self.row.copy(), self.at.copy()
        # of each side the row, whether it is of a smaller document or a bound, its place in text, and the match
        sides = [[near.copy(), fine.copy(), place.copy(), np.where(fine, self._same(at, place), 0)] for (near, fine), place in zip(self.sides, self.places)]
        found = []

        def note(k: int) -> None:
            hit = np.flatnonzero(np.maximum(sides[0][3][:k], sides[1][3][:k]) >= self.least)
            found.append((self.asked[hit], self.steps[hit] - (self.at[hit] - at[hit])))

        note(len(row))
        for k in m.tolist():
            run = self._run(row[:k])
            c = self.symbol[run]
            for down, (near, fine, place, long) in enumerate(sides):
                r = self._run(near[:k]) + (near[:k] == self.size)
                inside = np.minimum(r, len(self.start) - 1)
                go = fine[:k] & (self.symbol[inside] == c)
                jump = np.flatnonzero(~go)
                go = np.flatnonzero(go)
                near[go] += self.back[r[go]] - self.start[r[go]]
                place[go] -= 1
                long[go] += 1
                cj, dj = c[jump], d[jump]
                to = np.searchsorted(self.by_key, cj * (len(self.start) + 1) + r[jump])
                if down:
                    to = self.nearest.right(to, self.group[cj + 1], dj)
                    there = to < self.group[cj + 1]
                else:
                    to = self.nearest.left(to - 1, self.group[cj], dj)
                    there = to >= self.group[cj]
                none = jump[~there]
                near[none], fine[none], long[none] = self.first[c[none] + down], False, 0
                jump, to = jump[there], self.by[to[there]]
                if down:
                    i = np.searchsorted(self.down_key, to * self.far + (self.strings - d[jump]), "right")
                    sample, place[jump] = self.down_row[i], self.down_at[i]
                else:
                    i = np.searchsorted(self.up_key, to * self.far + d[jump], "left") - 1
                    sample, place[jump] = self.up_row[i], self.up_at[i]
                long[jump] = self._same(at[jump], place[jump]) + 1
                place[jump] -= 1
                near[jump], fine[jump] = self.back[to] + sample - self.start[to], True
            row[:k] += self.back[run] - self.start[run]
            at[:k] -= 1
            note(k)
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        return a[order], b[order]
