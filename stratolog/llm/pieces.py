"""SentencePiece encoding and decoding: sampled segmentations by forward filtering, backward sampling.

A text is segmented by a draw from all segmentations of its piece lattice, each with a chance in
proportion to the product of its pieces' weights. Draws come from a counter-based generator seeded by the
row's key, so they are the same in any order, batch or cluster. Decoding gives the text back exactly:
spaces are marks, U+2581 itself and characters without a piece are encoded as bytes.

The lattice is cut where no piece can reach across: before a space mark that follows another character.
Chunks of one length share array operations.

Null and empty text have no pieces, and decode to empty text. Rows with equal key and text get equal
pieces. A null key is a key of its own. A text of any length is coded whole, chunk by chunk. An empty table gives
an empty one. Other columns pass through encode and decode, but for one that has the result's name.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratolog.llm.lattice import SPACE, BatchLattice, PieceVocab, log_sum
from stratolog.llm.shared import made_apart, prepare, sliced, with_fields
from stratolog.llm.shingles import mix

VOCABULARY = "piece_bpe_32k.model"
SHARPNESS = 1.0
_NULL_KEY = 0x5851F42D4C957F2D
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AT = 0xD1342543DE82EF95


def _position(j: int) -> np.uint64:
    return np.uint64(j * _AT & (1 << 64) - 1)


class Sampler(BatchLattice):
    """Encodes and decodes batches of texts; one per worker."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        vocab = PieceVocab.load(path)
        weights = [w * sharpness for w in vocab.log_weights()]
        names = dict(vocab.ids)
        if any(p[1:].lstrip(SPACE).find(SPACE) >= 0 or (p[0] != SPACE and SPACE in p) for p in names):
            raise ValueError("a piece reaches across a space mark")
        for b in range(128):  # a character of one byte is as good as a piece
            names.setdefault(chr(b), vocab.byte_ids[b])
        self.names, self.byte_ids, self.longest = names, vocab.byte_ids, max(map(len, names))
        self.ids = np.array([*names.values(), -1], np.int32)
        self.table = self._table([*names])
        self.log_w = {p: weights[i] for p, i in names.items()}
        self.w = np.array([math.exp(weights[i]) for i in names.values()] + [0.0])
        self.byte_w = [weights[i] for i in vocab.byte_ids]
        self.singles = {p for p in names if len(p) == 1}
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.raw = [b""] * (len(weights) + 1)
        for p, i in vocab.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(vocab.byte_ids):
            self.raw[i] = bytes([b])

    def _split(self, text: str) -> list:
        """Chunks of the marked text; None stands for a U+2581 of the text itself."""
        if SPACE not in text:
            return self.chunks.findall(SPACE + text.replace(" ", SPACE))
        out: list = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(None)
            out += self.chunks.findall((SPACE if k == 0 else "") + part.replace(" ", SPACE))
        return out

    def encode(self, texts: list[str], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        index: dict = {}
        which, sizes = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                own = self._split(t)
                sizes[k] = len(own)
                which += [index.setdefault(c, len(index)) for c in own]
        if not which:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        which = np.array(which, np.int32)
        seeds = mix(np.array([_NULL_KEY if k is None else k & (1 << 64) - 1 for k in keys], np.uint64))
        first = np.cumsum(sizes) - sizes
        within = np.arange(len(which), dtype=np.int64) - np.repeat(first, sizes)
        seed = mix(np.repeat(seeds, sizes) + within.astype(np.uint64) * _STEP)
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(index) + 1))
        counts, parts = np.zeros(len(which), np.int64), []
        for at, codes, words in self._by_length([*index]):
            if codes is None:
                for k, w in zip(at, words):
                    drawn = None
                    for o in order[starts[k] : starts[k + 1]].tolist():
                        drawn = self._draw_one(w, int(seed[o]))
                        counts[o] = len(drawn)
                        parts.append((np.array([o]), np.array(drawn, np.int32)))
                continue
            n_of = starts[np.array(at) + 1] - starts[np.array(at)]
            occ = np.concatenate([order[starts[k] : starts[k + 1]] for k in at])
            word = np.repeat(np.arange(len(at)), n_of)
            for lo in range(0, len(occ), 200_000):
                drawn = self._draw(codes, word[lo : lo + 200_000], seed[occ[lo : lo + 200_000]])
                fine = drawn >= 0
                counts[occ[lo : lo + 200_000]] = fine.sum(axis=1)
                parts.append((occ[lo : lo + 200_000], drawn[fine]))
        offset = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for occ, flat in parts:
            n = counts[occ]
            ids[np.repeat(offset[occ] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        ends = np.append(offset, len(ids))
        return ids, ends[first + sizes] - ends[first]

    def _by_length(self, words: list):
        fit = [w if w is not None else "" for w in words]
        for at, codes in self._groups(fit):
            if codes is not None:
                for lo in range(0, len(at), 20_000):  # bounds the arrays of one step
                    yield at[lo : lo + 20_000], codes[lo : lo + 20_000], None
            else:
                yield at, None, [words[k] for k in at]

    def _draw(self, codes: np.ndarray, word: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """For each occurrence the drawn ids at their end positions, -1 elsewhere."""
        n = codes.shape[1]
        pre = self._hash(codes)
        ends: list[list] = [[] for _ in range(n + 1)]
        alpha = [np.ones(len(codes))]
        for j in range(1, n + 1):
            total = np.zeros(len(codes))
            for i in range(max(0, j - self.longest), j):
                idx = self._find(self.table, pre[:, j] - pre[:, i] * np.uint64(pow(self._BASE, j - i, 1 << 64)))
                p = alpha[i] * self.w[idx]
                total = total + p
                ends[j].append((i, idx, p))
            alpha.append(total)
        out = np.full((len(word), n), -1, np.int32)
        at = np.full(len(word), n, np.int64)
        for j in range(n, 0, -1):
            here = np.flatnonzero(at == j)
            if not len(here):
                continue
            w = word[here]
            left = (mix(seed[here] + _position(j)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * alpha[j][w]
            todo = np.ones(len(here), bool)
            for i, idx, p in ends[j]:
                own = p[w]
                left = left - own
                hit = todo & (left < 0) & (own > 0)
                out[here[hit], j - 1] = self.ids[idx[w[hit]]]
                at[here[hit]] = i
                todo &= ~hit
            for k in np.flatnonzero(todo).tolist():  # rounding at the very end of the interval: the last arc there is
                i, idx = next((i, idx) for i, idx, p in reversed(ends[j]) if p[w[k]] > 0)
                out[here[k], j - 1], at[here[k]] = self.ids[idx[w[k]]], i
        return out

    def _arcs_to(self, chunk: str, j: int) -> list[tuple[int, float, list[int]]]:
        out = []
        for i in range(max(0, j - self.longest), j):
            p = chunk[i:j]
            if p in self.log_w:
                out.append((i, self.log_w[p], [self.names[p]]))
        if chunk[j - 1] not in self.log_w:
            raw = chunk[j - 1].encode("utf-8", "surrogatepass")
            out.append((j - 1, sum(self.byte_w[b] for b in raw), [self.byte_ids[b] for b in raw]))
        return out

    def _draw_one(self, chunk: str | None, seed: int) -> list[int]:
        """One draw in log space; memory is one number per position, arcs are found again on the way back."""
        if chunk is None:
            return [self.byte_ids[b] for b in SPACE.encode()]
        alpha = [0.0]
        for j in range(1, len(chunk) + 1):
            alpha.append(log_sum([alpha[i] + w for i, w, _ in self._arcs_to(chunk, j)]))
        out, j = [], len(chunk)
        while j:
            arcs = self._arcs_to(chunk, j)
            u = float(mix(np.array([seed], np.uint64) + _position(j))[0] >> np.uint64(11)) * 2.0**-53
            for i, w, ids in arcs:
                u -= math.exp(alpha[i] + w - alpha[j])
                if u < 0:
                    break
            out.append(ids)
            j = i
        return [x for ids in reversed(out) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:]


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str | None = None, sharpness: float = SHARPNESS, id: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the sampled ids of each text as an array column."""
    path = path or public_tokenizers.path(VOCABULARY)
    prepare(docs.sparkSession)

    def run(batches):
        sampler = Sampler(path, sharpness)
        for b in sliced(batches, text):
            ids, n = sampler.encode(_strings(b[text]), b[id].to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out])

    return made_apart(docs, (id, text), (out,), lambda inner: inner.mapInArrow(run, with_fields(inner, **{out: T.ArrayType(T.IntegerType())})))


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the text that its ids stand for; null ids give empty text."""
    path = path or public_tokenizers.path(VOCABULARY)
    prepare(coded.sparkSession)

    def run(batches):
        sampler = Sampler(path)
        for b in batches:
            texts = [sampler.decode(x or []).decode("utf-8", "surrogatepass") for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return made_apart(coded, (ids,), (out,), lambda inner: inner.mapInArrow(run, with_fields(inner, **{out: T.StringType()})))


def query(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: pieces drawn, their CRC-32 (little-endian unsigned 32-bit ids), the SHA-256 of the decoded text, and whether that is the text."""
    path = public_tokenizers.path(VOCABULARY)
    prepare(spark)
    docs = spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet")

    def run(batches):
        sampler = Sampler(path)
        for b in sliced(batches, "text"):
            texts = _strings(b["text"])
            ids, n = sampler.encode(texts, b["doc_id"].to_pylist())
            ends, rows = np.cumsum(n), []
            for t, lo, hi in zip(texts, (ends - n).tolist(), ends.tolist()):
                own, raw = ids[lo:hi], t.encode("utf-8", "surrogatepass")
                back = sampler.decode(own.tolist())
                rows.append((zlib.crc32(own.astype("<u4").tobytes()), len(raw), hashlib.sha256(back).hexdigest(), back == raw))
            crc, size, sha, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "decoded_sha256", "lossless"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_sha256 string, lossless boolean")
