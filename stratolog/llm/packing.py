"""Packing by lexical retrieval: related documents share a training window.

Full windows of a long document are sequences of their own; what is left of each document, below a window,
is retrieved by BM25. The number of these rests, their mean length and their document frequencies are
counted once over the whole table. Rests are then dealt to shards of bounded size by content: a tree of
centroids, fitted to a bounded sample of projected term vectors, gives each rest a leaf, and a shard is a
run of neighbouring leaves, or a part of a leaf that is too large for one. So related rests meet wherever
in the input they lie. In a shard, the longest unused rest seeds a window; an inverted index with BM25
impacts returns its unused neighbours, the best NEIGHBOURS by the seed's QUERY_TERMS heaviest terms and then the
next ones, which fill the window greedily, the last one being cut where the window ends, and what is cut off stays in the index. When a shard's rests run out, the last window is
divided into sequences of powers of two, so no sequence is padded.

Null and empty text has one token, the end. Repeated rows are packed each by itself. An empty table gives
no pieces. Other columns are ignored. Sequence ids hold the shard's number, or for full windows the number
of the written table's partition, and so are unique, and equal when a task runs again.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm.shared import Workspace, sliced, trimmed
from stratolog.llm.tokens import CODING, WordTokenizer, tokenizer
from stratolog.llm.vectors import k_means

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Tokens of rests in a shard, where each rest counts REST_TOKENS more.
SHARD_TOKENS, REST_TOKENS = 1 << 19, 128
#: Rests that the centroids are fitted to, about; dimensions of their vectors; centroids of a level, at most.
SAMPLE, WIDTH, BRANCHES = 20_000, 32, 96
#: Rests whose terms are projected at once, so that they stay in a processor's cache.
STEP_RESTS = 64
#: The seed's heaviest terms that are looked up, and neighbours asked for at a time.
QUERY_TERMS, NEIGHBOURS = 12, 32
K1, B = 1.2, 0.75


class Corpus:
    """BM25's counts over all rests: their number, mean length and document frequencies."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, max(mean, 1.0), df
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))


def _terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of each document's distinct terms, by document."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in ids])
    key, tf = np.unique(doc << 32 | np.concatenate(ids).astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


class ShardIndex:
    """Inverted index over a shard's documents: per term the documents and their BM25 impacts.

    Without a corpus the shard's own documents are the corpus.
    """

    def __init__(self, ids: list[np.ndarray], corpus: Corpus | None = None):
        n = len(ids)
        self.length = np.array([len(x) for x in ids], float)
        self.length /= corpus.mean if corpus else max(self.length.mean(), 1.0) if n else 1.0
        doc = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in ids])
        key, tf = np.unique(doc | (np.concatenate(ids).astype(np.int64) << 32), return_counts=True)
        term, self.docs = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        of_all, total = (corpus.df[terms], corpus.n) if corpus else (df, n)
        idf = corpus.idf[terms] if corpus else np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.last = self.first + df
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[self.docs])) * np.repeat(idf, df)
        self.impact = impact
        # the same by document, heaviest term first; terms of most documents tell nothing apart
        useful = np.repeat(of_all * 2 <= max(total, 4), df) & np.repeat(df > 1, df)
        at = np.flatnonzero(useful)
        slot = np.repeat(np.arange(len(terms)), df)[at]
        order = np.lexsort((-impact[at], self.docs[at]))
        self.by_doc = slot[order]
        self.doc_first = np.searchsorted(self.docs[at][order], np.arange(n + 1))
        self.score = np.zeros(n)

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling BM25 score for the document's heaviest terms, then by number."""
        terms = self.by_doc[self.doc_first[doc] : self.doc_first[doc + 1]][:QUERY_TERMS]
        if not len(terms):
            return np.zeros(0, np.int64)
        self.score[:] = 0.0
        for t in terms.tolist():
            lo, hi = self.first[t], self.last[t]
            self.score[self.docs[lo:hi]] += self.impact[lo:hi]
        self.score[~unused] = 0.0
        found = np.flatnonzero(self.score)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-self.score[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.lexsort((found, -self.score[found]))]


def pack_shard(ids: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    pieces, sequence = [], 0
    total = np.array([len(x) for x in ids], np.int64)
    start = total // window * window
    for d in np.flatnonzero(start).tolist():
        for s in range(0, int(start[d]), window):
            pieces.append((d, s, window, sequence, 0))
            sequence += 1
    left = total - start
    unused = left > 0
    index = ShardIndex([x[s:] for x, s in zip(ids, start.tolist())], corpus) if len(ids) else None
    seeds = np.lexsort((np.arange(len(ids)), -left)).tolist()
    open_seq: list[list[int]] = []
    room, query, queue = window, -1, []
    at = 0

    def close(rows: list[list[int]]) -> None:
        nonlocal sequence
        for d, s, n, offset in rows:
            pieces.append((d, s, n, sequence, offset))
        sequence += 1

    while True:
        d = next((x for x in queue if unused[x]), -1)
        if d < 0 and query >= 0:
            queue = index.neighbours(query, unused).tolist()
            d = queue[0] if queue else -1
        if d < 0:
            while at < len(seeds) and not unused[seeds[at]]:
                at += 1
            if at == len(seeds):
                break
            d = seeds[at]
            query = d
        if room == window:
            query, queue = d, []
        n = int(min(left[d], room))
        open_seq.append([d, int(start[d]), n, window - room])
        start[d] += n
        left[d] -= n
        unused[d] = left[d] > 0
        room -= n
        if room == 0:
            close(open_seq)
            # what is cut off goes on as the next seed, so that a document stays in neighbouring windows
            open_seq, room, queue = [], window, []
            query = -1
            if unused[d]:
                open_seq, query, room = [[d, int(start[d]), int(left[d]), 0]], d, window - int(left[d])
                start[d] += left[d]
                left[d] = 0
                unused[d] = False
    rest, used = open_seq, window - room
    while used:
        size, rows, offset = 1 << used.bit_length() - 1, [], 0
        while offset < size:
            d, s, n, _ = rest[0]
            take = min(n, size - offset)
            rows.append([d, s, take, offset])
            rest = [[d, s + take, n - take, 0], *rest[1:]] if take < n else rest[1:]
            offset += take
        close(rows)
        used -= size
    return pieces


class Tree:
    """Two levels of centroids over vectors of rests; a leaf's number holds its branch's."""

    def __init__(self, sample: np.ndarray, branches: int):
        self.branches = branches
        k = min(branches, len(sample))
        self.top = k_means(sample, k)
        own = self._nearest(sample, self.top)
        self.below = [k_means(x, min(branches, len(x))) if len(x := sample[own == i]) else self.top[i : i + 1] for i in range(k)]

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        top = self._nearest(x, self.top)
        out = top * self.branches
        for i in np.unique(top).tolist():
            at = np.flatnonzero(top == i)
            out[at] += self._nearest(x[at], self.below[i])
        return out


_PROJECTIONS: dict[int, np.ndarray] = {}


def rest_vectors(ids: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Unit vectors of the rests' BM25 impacts, projected from terms to WIDTH dimensions by fixed signs."""
    if len(ids) > STEP_RESTS:
        return np.concatenate([rest_vectors(ids[k : k + STEP_RESTS], corpus) for k in range(0, len(ids), STEP_RESTS)])
    size = len(corpus.df)
    if size not in _PROJECTIONS:
        _PROJECTIONS[size] = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (size, WIDTH))
    doc, term, tf = _terms(ids)
    length = np.array([len(x) for x in ids])[doc] / corpus.mean
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length)) * np.where(corpus.df * 2 <= max(corpus.n, 4), corpus.idf, 0)[term]
    out = np.add.reduceat(impact.astype(np.float32)[:, None] * _PROJECTIONS[size][term], np.searchsorted(doc, np.arange(len(ids))), axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def shard_plan(weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each leaf: small neighbouring leaves share one, a large leaf has several."""
    first, parts = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64)
    shard, held = 0, 0
    for k, w in enumerate(weights.tolist()):
        if held and held + w > most:
            shard, held = shard + 1, 0
        first[k], parts[k] = shard, max(1, -(-w // most))
        held += w
        if w > most:
            shard, held = shard + int(parts[k]), 0
    return first, parts


def _shards(rests: DataFrame, space: Workspace, corpus: Corpus, kind, weight: int) -> DataFrame:
    """rests with the number of the shard of each."""
    most = SHARD_TOKENS
    if weight <= most:
        return rests.withColumn("shard", F.lit(0).cast("long"))
    spark = rests.sparkSession
    given = spark.sparkContext.broadcast(corpus)

    def vectors(batches):
        for b in batches:
            x = rest_vectors([np.frombuffer(t, kind) for t in b["rest"].to_pylist()], given.value)
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([v.tobytes() for v in x], pa.binary())], ["h", "x"])

    # a sample by content, in which equal rows are one
    h = F.xxhash64("doc_id", "rest")
    part = rests.select(h.alias("h"), "rest").filter(F.pmod("h", F.lit(1 << 20)) < max(1, -(-(SAMPLE << 20) // corpus.n)))
    part = part.dropDuplicates(["h"]).orderBy("h").limit(2 * SAMPLE).mapInArrow(trimmed(vectors), "h long, x binary").orderBy("h").toArrow()
    sample = np.frombuffer(b"".join(part["x"].to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    # some leaves a shard
    branches = int(min(BRANCHES, max(2, np.ceil(np.sqrt(4 * weight / most)))))
    tree = spark.sparkContext.broadcast(Tree(sample, branches)) if len(sample) else None

    def place(batches):
        for b in batches:
            ids = [np.frombuffer(t, kind) for t in b["rest"].to_pylist()]
            leaf = tree.value.leaves(rest_vectors(ids, given.value)) if tree else np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], [*b.schema.names, "leaf"])

    placed = space.table(rests.mapInArrow(trimmed(place), rests.schema.simpleString()[len("struct<") : -1] + ", leaf long"), "placed")
    width = kind().itemsize
    held = placed.groupBy("leaf").agg(F.sum(F.octet_length("rest") / width + REST_TOKENS).cast("long").alias("w")).orderBy("leaf").collect()
    first, parts = shard_plan(np.array([r["w"] for r in held], np.int64), most)
    # as Arrow, since rows of Python objects would start workers of another kind beside those of the steps
    plan = spark.createDataFrame(pa.table({"leaf": pa.array([r["leaf"] for r in held], pa.int64()), "first": pa.array(first, pa.int64()), "parts": pa.array(parts, pa.int64())}))
    # a leaf's shards take its rows by their keys, so that equal rows are spread too
    return placed.join(F.broadcast(plan), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("key"), "parts")).drop("leaf", "first", "parts")


def _binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of successive runs of ids, null where a run is empty."""
    offsets = np.append(0, np.cumsum(sizes * ids.itemsize))
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.array(sizes > 0).buffers()[1], pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
    return pa.array([x.tobytes() if len(x) else None for x in np.split(ids, np.cumsum(sizes)[:-1])], pa.binary())


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids."""
    space = Workspace(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    size = len(WordTokenizer(path).ends)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{x} long" for x in names) + (", ids array<int>" if with_ids else "")

    def code(batches):
        tokens, key = tokenizer(path), TaskContext.get().partitionId() << 40
        for b in sliced(batches, text):
            flat, n = tokens.encode([t or "" for t in b[text].to_pylist()])
            ids, n = np.insert(flat, np.cumsum(n), END_ID).astype(kind), n + 1
            cut = n // window * window
            rest = np.repeat(cut, n) <= np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [b[id], pa.array(np.arange(key, key + len(n))), pa.array(n), _binaries(ids[~rest], cut), _binaries(ids[rest], n - cut)],
                ["doc_id", "key", "tokens", "full", "rest"],
            )
            key += len(n)

    coded = space.table(docs.select(id, text).mapInArrow(trimmed(code, CODING), "doc_id long, key long, tokens long, full binary, rest binary"), "coded")
    rests = coded.filter("rest is not null").select("doc_id", "key", "tokens", "rest")

    def frequencies(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(_terms([np.frombuffer(t, kind) for t in b["rest"].to_pylist()])[1], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    n, total = rests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("rest")), F.lit(0))).first()
    total //= kind().itemsize
    counted = rests.select("rest").mapInArrow(trimmed(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary's size at most
    df = np.zeros(size, np.int64)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    corpus = Corpus(n, total / max(n, 1), df)
    given = docs.sparkSession.sparkContext.broadcast(corpus)

    def pieces(rows, doc_ids, own, start, tokens):
        out = [[doc_ids[d], start[d] + s, k, zlib.crc32(own[d][s : s + k].astype("<u4").tobytes()), tokens[d], q, o] for d, s, k, q, o in rows]
        columns = [pa.array([r[j] for r in out], pa.int64()) for j in range(7)]
        if with_ids:
            columns.append(pa.array([own[d][s : s + k].astype(np.int32) for d, s, k, _, _ in rows], pa.list_(pa.int32())))
        return columns, [*names, "ids"][: len(columns)]

    def whole(batches):
        # above all shards' numbers
        q = 1 << 62 | TaskContext.get().partitionId() << 40
        for b in sliced(batches, "full"):
            own = [np.frombuffer(t, kind) for t in b["full"].to_pylist()]
            at = [(d, s) for d, x in enumerate(own) for s in range(0, len(x), window)]
            yield pa.RecordBatch.from_arrays(*pieces([(d, s, window, q + i, 0) for i, (d, s) in enumerate(at)], b["doc_id"].to_pylist(), own, [0] * len(own), b["tokens"].to_pylist()))
            q += len(at)

    def shard(table: pa.Table) -> pa.Table:
        t = table.sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
        own, tokens, base = [np.frombuffer(x, kind) for x in t["rest"].to_pylist()], t["tokens"].to_pylist(), t["shard"][0].as_py() << 32
        rows = [(d, s, k, base + q, o) for d, s, k, q, o in pack_shard(own, window, given.value)]
        return pa.Table.from_arrays(*pieces(rows, t["doc_id"].to_pylist(), own, [n - len(x) for n, x in zip(tokens, own)], tokens))

    weight = total + n * REST_TOKENS
    full = coded.filter("full is not null").select("doc_id", "tokens", "full").mapInArrow(trimmed(whole), schema)
    return full.unionAll(_shards(rests, space, corpus, kind, weight).groupBy("shard").applyInArrow(shard, schema))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return pack(spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet"))
