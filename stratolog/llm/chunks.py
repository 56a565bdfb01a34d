"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash rolls over the bytes of a text; a chunk ends where the hash is the largest within REACH bytes
on both sides, so an insertion changes the chunks around it and no others. A chunk whose digest also occurs
in a document with a smaller doc_id is a copy; a run of copies of LEAST bytes or more is removed.

Ends are moved to the next start of a character, so what is kept is valid text. Null text is empty and
loses nothing, nor does the first document of a passage. Rows with one doc_id are one document and don't
take from each other, but each loses only what it holds itself; null doc_ids come last and don't take from
each other. A text of any length is read whole; where its hashes have no largest one, as in uniform text, a
chunk ends after LONGEST bytes. An empty table gives an empty one. Other columns are ignored, and kept by drop_copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratolog.llm.shared import Workspace, keyed, set_aside, sliced, text_bytes
from stratolog.llm.shingles import mix
from stratolog.llm.spans import joined, pack_spans, removal_report, removed_text

REACH, LONGEST, LEAST = 24, 512, 64
#: Bytes of a text that are hashed at once.
PART = 1 << 20
#: Bytes of text whose chunks a task settles among themselves before it passes them on.
SETTLED = 16 << 20
GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[byte] << age over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return h


def _window_max(h: np.ndarray, n: int) -> np.ndarray:
    """out[i] = max(h[i : i + n]), n below len(h)."""
    out, k = h, 1
    while 2 * k <= n:
        out, k = np.maximum(out[: len(out) - k], out[k:]), 2 * k
    return np.maximum(out[: len(out) - (n - k)], out[n - k :]) if n > k else out


def chunk_ends(raw: bytes) -> np.ndarray:
    """End of each chunk of raw, the last one being len(raw)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    ends = np.zeros(0, np.int64)
    found = []
    for lo in range(0, n, PART):  # an end depends on the bytes around it only
        left = max(0, lo - REACH - 32)
        part = data[left : lo + PART + REACH + 1]
        if len(part) > 2 * REACH + 1:
            h = gear_hashes(part)
            near = _window_max(h, REACH)  # near[i]: the largest of h[i : i + REACH]
            at = np.arange(REACH, len(part) - REACH)
            own = h[at]
            at = at[(own > near[at - REACH]) & (own > near[at + 1])] + left
            found.append(at[(at >= lo) & (at < lo + PART)] + 1)
    if found:
        ends = np.concatenate(found)
        for _ in range(3):  # a character has three following bytes at most
            ends = ends + ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80) * (ends < n)
        ends = np.unique(ends[ends < n])
    ends = np.append(ends, n)
    start = np.append(0, ends[:-1])
    if (ends - start).max() > LONGEST:  # uniform text has no largest hash
        more = [np.arange(s + LONGEST, e, LONGEST) for s, e in zip(start.tolist(), ends.tolist()) if e - s > LONGEST]
        extra = np.concatenate(more)
        for _ in range(3):
            extra = extra + ((data[np.minimum(extra, n - 1)] & 0xC0) == 0x80) * (extra < n)
        ends = np.unique(np.concatenate((ends, extra)))
    return ends


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(d1, d2, settled, doc_id, _row, start, length) of the chunks of docs, with a digest of 128 bits.

    A batch of documents settles its own copies: they come as runs, with a number in place of the digest,
    and of each digest only the smallest document's chunks go on. So a chunk that is everywhere goes on once a batch.
    """

    def settle(held):
        digest = np.frombuffer(b"".join(h[0] for h in held), np.int64).reshape(-1, 2)
        d, r, s, n = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        order = np.lexsort((d, digest[:, 1], digest[:, 0]))
        digest, d, r, s, n = digest[order], d[order], r[order], s[order], n[order]
        new = np.concatenate(([True], (digest[1:] != digest[:-1]).any(axis=1)))
        done = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        own = ~done
        yield from _batches(digest[own, 0], digest[own, 1], False, d[own], r[own], s[own], n[own])
        if done.any():
            d, r, s, n = joined(d[done], r[done], s[done], n[done])
            yield from _batches(mix(d.view(np.uint64) ^ mix(r.view(np.uint64) + s.view(np.uint64))).view(np.int64), np.zeros(len(d), np.int64), True, d, r, s, n)

    def run(batches):
        held, size = [], 0
        for b in sliced(batches, "text"):
            for d, r, raw in zip(b["doc_id"].to_pylist(), b["_row"].to_pylist(), text_bytes(b["text"])):
                e = chunk_ends(raw)
                if len(e):
                    s = np.append(0, e[:-1])
                    held.append((b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist())]), np.full(len(e), d), np.full(len(e), r), s, e - s))
                size += len(raw)
                if size >= SETTLED and held:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return docs.select("doc_id", "_row", "text").mapInArrow(run, "d1 long, d2 long, settled boolean, doc_id long, _row long, start int, length int")


def _batches(d1, d2, settled, d, r, s, n, step: int = 100_000):
    for lo in range(0, len(d), step):
        at = slice(lo, lo + step)
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, (d1[at], d2[at], np.full(len(d[at]), settled), d[at], r[at], s[at].astype(np.int32), n[at].astype(np.int32)))],
            ["d1", "d2", "settled", "doc_id", "_row", "start", "length"],
        )


def mark_copies(docs: DataFrame) -> DataFrame:
    """docs with spans: the chunks that a document with a smaller doc_id holds too."""
    space = Workspace(docs.sparkSession)
    docs = keyed(docs, space)
    last = F.lit((1 << 63) - 1)  # null ids come last
    rows = chunk_rows(docs.withColumn("doc_id", F.coalesce("doc_id", last)))
    owner = F.min("doc_id").over(Window.partitionBy("d1", "d2", "settled"))
    copies = rows.withColumn("owner", owner).filter(F.col("settled") | (F.col("doc_id") > F.col("owner"))).select("doc_id", "_row", "start", "length")
    spans = space.table(pack_spans(copies), "spans")
    return docs.join(spans, (F.coalesce(docs["doc_id"], last) == F.col("_of")) & (docs["_row"] == F.col("_at")), "left").drop("_of", "_at", "_row")


def drop_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the copied runs cut out of text."""
    inner, names = set_aside(docs, "doc_id", "text")
    return removed_text(mark_copies(inner), least).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, and the SHA-256 of the rest."""
    docs = spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet")
    return removal_report(mark_copies(docs), LEAST)
