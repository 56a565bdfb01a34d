"""Piece vocabularies of public tokenizers and the segmentation lattice over them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"


@dataclass
class PieceVocab:
    """Pieces by text; pieces of single bytes stand in for characters that no piece covers."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)

    @classmethod
    def load(cls, path: str) -> PieceVocab:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, byte_ids = {}, [-1] * 256
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                ids[m.id_to_piece(i)] = i
        if min(byte_ids) < 0:
            raise ValueError("the vocabulary has no byte pieces, so texts can't be kept whole")
        return cls(ids, [m.get_score(i) for i in range(m.get_piece_size())], byte_ids)

    def log_weights(self) -> list[float]:
        """Log-probabilities of pieces from the vocabulary's scores.

        Scores of a merge-ranked vocabulary are minus the rank; Zipf's law makes them weights. Bytes
        and other pieces of score 0 rank last.
        """
        n = len(self.scores)
        ranks = [n if s >= 0 else -s for s in self.scores]
        total = sum(1 / (r + 10) for r in ranks)
        return [-math.log(r + 10) - math.log(total) for r in ranks]


def log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top if len(terms) == 1 or top == -math.inf else top + math.log(sum(math.exp(x - top) for x in terms))


def log_sums(terms: list[np.ndarray]) -> np.ndarray:
    """log_sum of each place of several arrays."""
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    top = x.max(axis=0)
    base = np.where(top == -math.inf, 0.0, top)
    with np.errstate(divide="ignore"):
        return base + np.log(np.exp(x - base).sum(axis=0))


@dataclass
class WordModel:
    """Unigram model of a word's pieces: one initial piece (its space mark stripped), further pieces, stop.

    Weights are log-probabilities; each group sums to 1, so all words together have probability 1.
    """

    initial: dict[str, float]
    further: dict[str, float]
    of_bytes: list[float]
    stop: float
    longest: int

    def arcs(self, word: str) -> list[list[tuple[int, float, object]]]:
        """For each end position the arcs (start, log weight, name); start -1 is an initial piece."""
        n, further, initial = len(word), self.further, self.initial
        ends: list[list] = [[] for _ in range(n + 1)]
        for j in range(min(n, self.longest) + 1):
            lp = initial.get(word[:j])
            if lp is not None:
                ends[j].append((-1, lp, word[:j]))
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                lp = further.get(word[i:j])
                if lp is not None:
                    ends[j].append((i, lp, word[i:j]))
            if word[i] not in further:
                raw = word[i].encode("utf-8", "surrogatepass")
                ends[i + 1].append((i, sum(self.of_bytes[b] for b in raw), raw))
        return ends

    def forward(self, word: str) -> tuple[list[float], list]:
        """Log-probability of all ways to reach each position, summed over segmentations."""
        ends = self.arcs(word)
        alpha: list[float] = []
        for arcs in ends:
            alpha.append(log_sum([lp if i < 0 else alpha[i] + lp for i, lp, _ in arcs]) if arcs else -math.inf)
        return alpha, ends

    def log_probability(self, word: str) -> float:
        return self.forward(word)[0][-1] + self.stop

    def add_expected(self, word: str, initial: dict, further: dict, of_bytes: list[float]) -> None:
        """Add the posterior counts of the word's arcs (forward times backward)."""
        alpha, ends = self.forward(word)
        beta = [-math.inf] * len(ends)
        beta[-1] = 0.0
        total, exp = alpha[-1], math.exp
        back: list[list[float]] = [[] for _ in ends]
        for j in range(len(ends) - 1, -1, -1):
            if back[j]:
                beta[j] = log_sum(back[j])
            b = beta[j]
            if b == -math.inf:
                continue
            for i, lp, name in ends[j]:
                if i < 0:
                    initial[name] = initial.get(name, 0.0) + exp(lp + b - total)
                    continue
                back[i].append(lp + b)
                p = exp(alpha[i] + lp + b - total)
                if type(name) is str:
                    further[name] = further.get(name, 0.0) + p
                else:
                    for x in name:
                        of_bytes[x] += p


def word_model(vocab: PieceVocab, weights: list[float] | None = None, stop: float = 0.25) -> WordModel:
    """A word model from log weights by piece id, each group normalised."""
    weights = weights or vocab.log_weights()
    initial = {p[1:]: weights[i] for p, i in vocab.ids.items() if p[0] == SPACE and SPACE not in p[1:]}
    further = {p: weights[i] for p, i in vocab.ids.items() if SPACE not in p}
    of_bytes = [weights[i] for i in vocab.byte_ids]
    a, b = log_sum([*initial.values()]), log_sum([*further.values(), *of_bytes]) - math.log1p(-stop)
    return WordModel({k: v - a for k, v in initial.items()}, {k: v - b for k, v in further.items()}, [v - b for v in of_bytes], math.log(stop), vocab.longest)


def refit(old: WordModel, initial: dict, further: dict, of_bytes: list[float], words: float, floor: float = 0.01) -> WordModel:
    """The model from expected counts over `words` words; floor keeps every piece possible."""
    a = sum(initial.values()) + floor * len(old.initial)
    b = sum(further.values()) + sum(of_bytes) + words + floor * (len(old.further) + 257)
    log = math.log
    return WordModel(
        {k: log((initial.get(k, 0.0) + floor) / a) for k in old.initial},
        {k: log((further.get(k, 0.0) + floor) / b) for k in old.further},
        [log((x + floor) / b) for x in of_bytes],
        log((words + floor) / b),
        old.longest,
    )


class BatchLattice:
    """The lattices of many words at once: arcs are found once and weighed by several models.

    Words of one length share array operations. Pieces are found by a polynomial hash of 64 bits, under
    which those of the vocabulary are checked to differ. Recursions run on logarithms. A very long word, or
    one that has a character without a piece, takes those of WordModel.
    """

    MOST = 30
    _BASE = 0x9E3779B97F4A7C15
    _MIX = 0xD6E8FEB86659FD93

    def __init__(self, vocab: PieceVocab, models: list[WordModel]):
        self.models = models
        self.tables = [self._table([*m]) for m in (models[0].initial, models[0].further)]
        weigh = lambda names, of: np.array([[of(m)[p] for p in names] + [-math.inf] for m in models])
        self.w_initial = weigh(models[0].initial, lambda m: m.initial)
        self.w_further = weigh(models[0].further, lambda m: m.further)
        self.longest = vocab.longest
        self.singles = {p for p in models[0].further if len(p) == 1}

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        """Prefix hashes of each row: column j covers the first j characters."""
        pre = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            pre[:, j + 1] = pre[:, j] * np.uint64(self._BASE) + codes[:, j] + np.uint64(1)
        return pre

    def _table(self, names: list[str]):
        """(slots, keys): a name's index at the slot of its hash; names that share a slot stay in a dict."""
        keys = np.zeros(len(names) + 1, np.uint64)
        for n in {len(x) for x in names}:
            at = [i for i, x in enumerate(names) if len(x) == n]
            if n:
                codes = np.frombuffer("".join(names[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
                keys[at] = self._hash(codes.astype(np.uint64))[:, n]
        if len({*keys[:-1].tolist()}) != len(names):
            raise ValueError("two pieces have one hash")
        slots, more = np.full(1 << 20, len(names), np.int32), {}
        for i, k in enumerate(keys[:-1].tolist()):
            s = (k * self._MIX & (1 << 64) - 1) >> 44
            if slots[s] == len(names):
                slots[s] = i
            else:
                more.setdefault(s, []).append((np.uint64(k), i))
        return slots, keys, more, len(names)

    @staticmethod
    def _find(table, h: np.ndarray) -> np.ndarray:
        slots, keys, more, none = table
        at = (h * np.uint64(BatchLattice._MIX) >> np.uint64(44)).astype(np.int64)
        i = slots[at]
        miss = keys[i] != h
        if more and miss.any():
            for k in np.flatnonzero(miss & (i != none)).tolist():
                for key, j in more.get(int(at[k]), ()):
                    if key == h[k]:
                        i[k], miss[k] = j, False
        i[miss] = none
        return i

    def _groups(self, words: list[str]):
        """(indexes, codes) by length of the words fit for arrays, then the indexes of the others."""
        by: dict[int, list[int]] = {}
        other = []
        for k, w in enumerate(words):
            if 0 < len(w) <= self.MOST and (w.isascii() and w.isprintable() or self.singles.issuperset(w)):
                by.setdefault(len(w), []).append(k)
            else:
                other.append(k)
        for n, at in by.items():
            yield at, np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64)
        yield other, None

    def _arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        n = codes.shape[1]
        pre = self._hash(codes)
        empty = self._find(self.tables[0], np.zeros(1, np.uint64))[0]
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        if empty != self.tables[0][3]:
            ends[0].append((-1, np.full(len(codes), empty)))
        power = [pow(self._BASE, k, 1 << 64) for k in range(n + 1)]
        for j in range(1, n + 1):
            if j <= self.longest:
                ends[j].append((-1, self._find(self.tables[0], pre[:, j])))
            for i in range(max(0, j - self.longest), j):
                idx = self._find(self.tables[1], pre[:, j] - pre[:, i] * np.uint64(power[j - i]))
                if (idx != self.tables[1][3]).any():
                    ends[j].append((i, idx))
        return ends

    def _forward(self, ends, k: int) -> list[np.ndarray]:
        """Log-probability of all ways to reach each position, summed over segmentations."""
        alpha: list[np.ndarray] = []
        for arcs in ends:
            terms = [self.w_initial[k][idx] if i < 0 else alpha[i] + self.w_further[k][idx] for i, idx in arcs]
            alpha.append(log_sums(terms) if terms else np.full(len(ends[-1][0][1]), -math.inf))
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logs, one row per word and one column per model."""
        out = np.empty((len(words), len(self.models)))
        for at, codes in self._groups(words):
            if codes is None:
                for w in at:
                    out[w] = [m.log_probability(words[w]) for m in self.models]
                continue
            ends = self._arcs(codes)
            for k, m in enumerate(self.models):
                out[at, k] = self._forward(ends, k)[-1] + m.stop
        return out

    def marginal(self, words: list[str], whole: np.ndarray, enter: np.ndarray) -> np.ndarray:
        """Natural logs of the sum over all paths of each word: an arc for the whole word of log weight `whole`,
        and all segmentations under each model, entered with log weight enter[model]."""
        paths = self.log_probabilities(words) + enter[None, :]
        return log_sums([whole, *paths.T])

    def expected(self, words: list[str], k: int):
        """Summed posterior counts under model k: by initial piece, by further piece, by byte."""
        initial, further, of_bytes = np.zeros(self.w_initial.shape[1]), np.zeros(self.w_further.shape[1]), [0.0] * 256
        slow_i, slow_f = {}, {}
        for at, codes in self._groups(words):
            if codes is None:
                for w in at:
                    self.models[k].add_expected(words[w], slow_i, slow_f, of_bytes)
                continue
            ends = self._arcs(codes)
            alpha = self._forward(ends, k)
            back: list[list[np.ndarray]] = [[] for _ in ends]
            back[-1].append(-alpha[-1])  # posteriors are shares of the word's probability
            found = {True: ([], []), False: ([], [])}
            for j in range(len(ends) - 1, -1, -1):
                if not back[j]:
                    continue
                beta = log_sums(back[j])
                for i, idx in ends[j]:
                    p = (self.w_initial if i < 0 else self.w_further)[k][idx] + beta
                    if i >= 0:
                        back[i].append(p)
                        p = p + alpha[i]
                    found[i < 0][0].append(idx)
                    found[i < 0][1].append(np.exp(p))
            for first, sums in ((True, initial), (False, further)):
                if found[first][0]:
                    sums += np.bincount(np.concatenate(found[first][0]), np.concatenate(found[first][1]), len(sums))
        for names, sums, slow in ((self.models[k].initial, initial, slow_i), (self.models[k].further, further, slow_f)):
            if slow:
                at = {p: i for i, p in enumerate(names)}
                for p, v in slow.items():
                    sums[at[p]] += v
        return initial[:-1], further[:-1], of_bytes
