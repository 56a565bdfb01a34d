"""Removing byte spans from texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolog.llm.shared import sliced, text_bytes, trimmed, with_fields


def merge_spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs that the spans cover, touching ones joined."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], (start + length)[order]
    e = np.maximum.accumulate(e) if len(e) else e
    first = np.concatenate(([True], s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
    return s[first], e[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(s) - 1]))] if len(s) else e


def joined(d, r, s, n):
    """The spans (document, row key, start, length) with those of a row that touch as one."""
    order = np.lexsort((s, r, d))
    d, r, s, n = d[order], r[order], s[order], n[order]
    end = s + n  # ends of a row's spans are in the order of their starts
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] > end[:-1]))))
    return d[new], r[new], s[new], end[np.append(new[1:], len(s)) - 1] - s[new]


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return raw
    edges = [0, *np.column_stack((starts, ends)).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def pack_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, _row, start, length) rows as (_of, _at, spans): one array per row of the input."""
    return spans.groupBy(F.col("doc_id").alias("_of"), F.col("_row").alias("_at")).agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def span_arrays(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of each row's spans; none where it is null."""
    out = []
    values, n = column.flatten(), np.array(column.value_lengths().fill_null(0).to_pylist(), np.int64)
    s, k = values.field(0).to_numpy(zero_copy_only=False).astype(np.int64), values.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    for m in n.tolist():
        out.append((s[lo : lo + m], k[lo : lo + m]))
        lo += m
    return out


def removal_report(marked: DataFrame, least: int = 1) -> DataFrame:
    """Per row of marked (doc_id, text, spans): sizes, runs of at least so many bytes removed, and the rest's SHA-256."""

    def run(batches):
        for b in sliced(batches, "text"):
            rows = []
            for raw, (s, n) in zip(text_bytes(b["text"]), span_arrays(b["spans"])):
                lo, hi = merge_spans(s, n)
                fine = hi - lo >= least
                lo, hi = lo[fine], hi[fine]
                rows.append((len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(cut(raw, lo, hi)).hexdigest()))
            a, c, d, e = zip(*rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_text(marked: DataFrame, least: int = 1) -> DataFrame:
    """marked with its spans cut out of text and without the column spans.

    A character that is cut in part goes whole. Null texts and texts without spans stay as they are.
    """
    columns = [c for c in marked.columns if c != "spans"]
    schema = with_fields(marked.select(*columns))

    def run(batches):
        for b in sliced(batches, "text"):
            texts = []
            for t, (s, n) in zip(b["text"].to_pylist(), span_arrays(b["spans"])):
                if t is not None and len(s):
                    lo, hi = merge_spans(s, n)
                    fine = hi - lo >= least
                    t = cut(t.encode(), lo[fine], hi[fine]).decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b[c] for c in columns], columns)

    return marked.mapInArrow(trimmed(run), schema)
