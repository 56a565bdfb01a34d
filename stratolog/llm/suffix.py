"""Long repeated substrings across documents: what a smaller doc_id has at length 50 goes.

Matches are found by run-length Burrows-Wheeler indexes (runindex.py), one for each small range of the
strings that can match. To deal a corpus out to them, of the K-byte strings in any 50 bytes the one with
the smallest hash is an anchor; equal 50-byte strings so have equal anchors. Anchors that two documents
have are kept, with the context that their 50-byte windows span. Contexts are dealt out by the hash of their
anchor, as bytes. Equal contexts are folded to one with the smallest doc_id, in each batch before they are
dealt out and again in their range: a copy of a smaller document's context is a match whole. The others
are indexed and streamed against the index, and windows whose match with a smaller document reaches 50
bytes go. Hashes only choose where strings meet; matches are of bytes.

A passage that is everywhere reaches its range once per batch. An anchor that very many places have is
dealt out by its windows instead, each by its own hash, so that no range gathers all of them.

Null text is empty. Rows with one doc_id are one document, but each loses only what it holds itself; null
doc_ids come last and don't match each other. Equal documents lose all but their first copy. Texts under 50
bytes neither lose nor give anything; a text of any length is read whole, in parts that overlap by a window.
An empty table gives an empty one. Other columns are ignored, and kept by drop_matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm.runindex import RunIndex
from stratolog.llm.shared import Workspace, keyed, set_aside, sliced, text_bytes, trimmed
from stratolog.llm.shingles import mix
from stratolog.llm.spans import joined, pack_spans, removal_report, removed_text, span_arrays

LENGTH, K = 50, 24
#: Bytes of a text whose hashes are held at once; the parts of a longer text overlap by a window.
PART = 1 << 20
#: Bytes of short texts that are joined, as one call for each text costs more than its bytes.
JOINED = 1 << 18
#: Bytes of text whose entries a task settles among themselves before it deals them out.
SETTLED = 8 << 20
#: Bytes of text per range of hashes: bounds what one task gathers.
PER_RANGE = 16 << 20
#: Bytes of strings per index.
SHARD = 1 << 18
#: Entries of a range that are sorted at once.
SORTED = 1 << 16
#: Anchors with more places are dealt out by windows; at most MOST_HOT of them, the most frequent, are told to all tasks.
HOT, MOST_HOT = 1 << 13, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-byte strings of data, by doubling."""
    # poly[k] hashes 2**k bytes: left * base**(2**k) + right
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    done, length = None, 0
    while True:
        if n & size:
            if done is None:
                done, length = h, size
            else:
                m = len(data) - length - size + 1
                done = done[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + h[length : length + m]
                length += size
        if size * 2 > n:
            return mix(done)
        h, size = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:], 2 * size


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    k = 1
    while 2 * k <= n:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(data: np.ndarray, cuts: np.ndarray | tuple = (), length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor: the windows in which it is smallest.

    No window reaches across a cut, where a text ends and another begins.
    """
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    w = length - k + 1
    h = window_hashes(data, k)
    low = _sliding(np.minimum, h, w)
    if len(cuts):
        across = (np.asarray(cuts)[:, None] - np.arange(1, length)[None, :]).ravel()
        low[across[(across >= 0) & (across < n)]] = 0  # no hash is so small
    # p is smallest in some window that holds it if it equals the largest of their minima
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    p = np.flatnonzero(h == _sliding(np.maximum, padded, w))
    # those windows follow one another: they end where a smaller hash comes in
    own = h[p]
    first, last = np.maximum(p - w + 1, 0), np.minimum(p, n - 1)
    lo, hi = p.copy(), p.copy()
    lo, hi = np.minimum(lo, n - 1), np.minimum(hi, n - 1)
    change = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n]))
    # runs of equal minima; an anchor's run is among those that its windows touch
    run = np.searchsorted(change, first, "right") - 1
    for _ in range(w):
        off = (low[np.minimum(change[run], n - 1)] != own) & (change[np.minimum(run + 1, len(change) - 1)] <= last)
        if not off.any():
            break
        run = run + off
    lo, hi = np.maximum(change[run], first), np.minimum(change[run + 1] - 1, last)
    return p, own, lo, hi


def _each(batches):
    """Steps of several texts joined by a gap, as (batch, doc ids, row keys, texts) of bounded size."""
    unzip = zstandard.ZstdDecompressor().decompress
    for b in sliced(batches, "text", 1 << 20):
        texts = text_bytes(b["text"])
        if pa.types.is_binary(b["text"].type):
            texts = [unzip(t) if t else b"" for t in texts]
        yield b, b["doc_id"].fill_null(_LAST).to_numpy(), b["_row"].to_numpy(), texts


def _zipped(docs: DataFrame) -> DataFrame:
    """docs with each text as a compressed block, which halves what a join moves."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["_row"], pa.array([zip_(t) if t else None for t in text_bytes(b["text"])], pa.binary())], ["doc_id", "_row", "text"])

    return docs.mapInArrow(trimmed(run), "doc_id long, _row long, text binary")


def _parts(raw: bytes):
    """(offset, bytes) of overlapping parts such that each 50-byte window with its anchor range is in one."""
    step = PART
    if len(raw) <= step:
        yield 0, raw
        return
    lo = 0
    while True:
        yield lo, raw[lo : lo + step + LENGTH - 1]
        lo += step
        if lo + LENGTH > len(raw):
            return


def _transposed(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well where values are close."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _restored(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()

_ROW = "range int, hash binary, doc binary, row binary, start binary, length binary, text binary"
_FOUND = "doc_id long, _row long, start int, length int"
_KNOWN = np.uint32(0xFFFFFFFF)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    # anchors have small hashes: their range is that of another hash
    return ((mix(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary array."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The pieces of data as a binary array."""
    at = np.concatenate((np.zeros(1, np.int32), np.cumsum(length, dtype=np.int32)))
    index = np.repeat(start - at[:-1], length) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[index])])


def _rows(ranges, h, d, r, start, length, strings: pa.Array | None = None) -> pa.RecordBatch:
    """Packed rows, one for each range; row keys that are all 0 take no room."""
    order = np.argsort(ranges.astype(np.int16) if len(ranges) and max(abs(int(ranges.min())), int(ranges.max())) < 1 << 15 else ranges, kind="stable")
    ranges = ranges[order]
    cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    bounds = list(zip(cuts.tolist(), np.append(cuts[1:], len(ranges)).tolist()))

    def packed(x, kind, none=False):
        x = x.astype(kind, copy=False)[order]
        return pa.array([b"" if none and not x[lo:hi].any() else _transposed(x[lo:hi]) for lo, hi in bounds], pa.binary())

    columns = [packed(h, np.uint32), packed(d, np.int64), packed(r, np.int64, True), packed(start, np.uint32), packed(length, np.uint32)]
    texts: list = [None] * len(bounds)
    if strings is not None:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        at, data = _flat(strings.take(pa.array(order)))
        texts = [zip_(data[at[lo] : at[hi]].tobytes()) for lo, hi in bounds]
    return pa.RecordBatch.from_arrays([pa.array(ranges[cuts].astype(np.int32)), *columns, pa.array(texts, pa.binary())], ["range", "hash", "doc", "row", "start", "length", "text"])


def _unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """hash, doc, row key, start and length of the entries of row k."""
    h, d, s, n = (_restored(batch[c][k].as_py(), kind) for c, kind in (("hash", np.uint32), ("doc", np.int64), ("start", np.uint32), ("length", np.uint32)))
    r = batch["row"][k].as_py()
    return h, d, _restored(r, np.int64) if r else np.broadcast_to(np.int64(0), len(d)), s, n


def _by_parts(held: list[tuple[np.ndarray, ...]]):
    """The entries of the unpacked rows in parts of about SORTED entries, all entries of a hash in one part."""
    parts = -(-sum(len(x[0]) for x in held) // SORTED)
    kind = np.uint16 if parts <= 1 << 16 else np.uint32
    of = [(x[0].astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(kind) for x in held]
    for k in range(parts):
        own = [np.flatnonzero(p == k) for p in of]
        yield tuple(np.concatenate([x[c][i] for x, i in zip(held, own)]) for c in range(5))


def _spans(d, r, start, length, step: int = 100_000):
    """Rows of _FOUND in batches."""
    for lo in range(0, len(d), step):
        own = slice(lo, lo + step)
        yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(r[own]), pa.array(start[own].astype(np.int32)), pa.array(length[own].astype(np.int32))], ["doc_id", "_row", "start", "length"])


def _settled(batch: pa.RecordBatch, k: int):
    """The rows of entries that their batch settled, or none if row k has others."""
    if batch["range"][k].as_py() < 0:
        _, d, r, s, n = _unpacked(batch, k)
        yield from _spans(d, r, s, n)


def _held(batches, entries):
    """Entries of the texts of batches, in steps of SETTLED bytes; spans are passed on where there are any."""
    held, size = [], 0
    for b, ids, keys, texts in _each(batches):
        spans = span_arrays(b["spans"]) if "spans" in b.schema.names else [None] * len(texts)
        size += sum(map(len, texts))
        for k, *values in entries(texts, spans):
            if len(k):
                held.append((ids[k], keys[k], *values))
        if size >= SETTLED and held:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_hash(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """The group of each entry by its hash, and of each group an entry, the smallest and the largest doc and the size."""
    order = np.argsort(h)
    hs = h[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), hs[1:] != hs[:-1])))
    del hs
    n, ds, group = np.diff(np.append(cuts, len(h))), d[order], np.empty(len(h), np.int32)
    group[order] = np.repeat(np.arange(len(cuts), dtype=np.int32), n)
    low, high = (f.reduceat(ds, cuts) if len(h) else ds for f in (np.minimum, np.maximum))
    return group, order[cuts], low, high, n


def _buffers(texts: list[bytes]):
    """(bytes, text numbers, starts in the bytes, starts in the texts): short texts joined, long ones in parts."""
    held, size = [], 0
    for k, raw in enumerate([*texts, None]):
        if held and (raw is None or size + len(raw) > JOINED):
            n = np.cumsum([0] + [len(texts[i]) for i in held])
            yield np.frombuffer(b"".join([texts[i] for i in held]), np.uint8), np.array(held), n[:-1], np.zeros(len(held), np.int64)
            held, size = [], 0
        if raw is None:
            return
        if len(raw) < LENGTH:
            continue
        if len(raw) > PART:
            for at, part in _parts(raw):
                yield np.frombuffer(part, np.uint8), np.array([k]), np.zeros(1, np.int64), np.array([at])
        else:
            held.append(k)
            size += len(raw)


def shared_anchors(docs: DataFrame, ranges: int, hot: int = HOT) -> DataFrame:
    """(doc_id, _row, start, length) of the anchors that two documents have; start is the anchor's place.

    Rows with start -1 are anchors of more than hot places: doc_id tells which, length how many.
    """

    def entries(texts, _):
        for data, which, start, at in _buffers(texts):
            p, h, _, _ = anchors(data, start[1:])
            own = np.searchsorted(start, p, "right") - 1
            yield which[own], h, (p - start[own] + at[own]).astype(np.int32)

    def dealt(held):
        d, r, h, s = (np.concatenate(c) for c in zip(*held))
        held.clear()
        group, first, low, high, n = _by_hash(h, d)
        done, n, s = (low < high)[group], n.astype(np.uint32), s.view(np.uint32)
        if done.any():
            # ranges below 0 hold what is settled already
            yield _rows(-1 - ((d[done] ^ r[done]) % max(ranges, 1)), h[done], d[done], r[done], s[done], n[group[done]])
        # what the batch knows to be shared is sent once, so that other batches learn of it
        send = ~done
        send[first] = True
        known, h = done[send], h[send]
        yield _rows(_range_of(h, ranges), h, d[send], np.where(known, 0, r[send]), np.where(known, _KNOWN, s[send]), n[group[send]])

    def run(batches):
        for held in _held(batches, entries):
            yield from dealt(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for b in batches:
            for k in range(len(b)):
                place = b["range"][k].as_py()
                if place < 0:
                    yield from _settled(b, k)
                else:
                    held.append(_unpacked(b, k))
        for h, d, r, s, n in _by_parts(held):
            group, first, low, high, _ = _by_hash(h, d)
            known, shared = s == _KNOWN, low < high
            shared[group[known]] = True
            fine = shared[group] & ~known
            yield from _spans(d[fine], r[fine], s[fine], n[fine])
            # a batch's entries of one hash all tell how many they are
            codes, places = h[first], np.bincount(group, np.where(known, n, 1))
            many = places > hot
            yield from _spans(codes[many].astype(np.int64) | np.int64(place) << 32, np.zeros(int(many.sum()), np.int64), np.full(int(many.sum()), -1), np.minimum(places[many], _MOST))

    return docs.mapInArrow(trimmed(run), _ROW).groupBy("range").applyInArrow(trimmed(meet), _FOUND)


_MOST = (1 << 31) - 1


def hot_anchors(found: DataFrame, most: int = MOST_HOT) -> np.ndarray:
    """The anchors that are dealt out by windows, sorted: at most so many, those of the most places."""
    hot = found.filter("start < 0").select(F.col("doc_id").alias("anchor"), "length", F.log2("length").cast("int").alias("level"))
    above, least = 0, 0
    for x in sorted(hot.groupBy("level").count().collect(), reverse=True):  # 31 levels at most
        above += x["count"]
        if above > most:
            least = x["level"] + 1
            break
    return np.sort(hot.filter(F.col("level") >= least).select("anchor").toPandas()["anchor"].to_numpy(np.int64))


class _Fold:
    """Distinct strings of one range, each with its key and smallest document, and their entries."""

    def __init__(self):
        self.new, self.size = [], 0
        self.strings, self.key, self.doc = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.entries = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint32))]

    def add(self, strings: pa.Array, h, d, r, s) -> None:
        self.new.append((strings, h, d, r, s))
        self.size += len(_flat(strings)[1])
        if self.size > 32 << 20:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        strings, h, d, r, s = zip(*self.new)
        coded = pa.concat_arrays([self.strings, *strings]).dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), len(self.strings)
        key, doc = np.empty(len(coded.dictionary), np.uint32), np.full(len(coded.dictionary), _LAST)
        key[code] = np.concatenate((self.key, *h))
        np.minimum.at(doc, code, np.concatenate((self.doc, *d)))
        self.strings, self.key, self.doc = coded.dictionary, key, doc
        self.entries.append((code[n:], np.concatenate(d), np.concatenate(r), np.concatenate(s)))
        self.new, self.size = [], 0

    def spans(self, shard: int):
        """(doc, row key, start, length) of the matches, in batches: of whole copies, then by each index."""
        self.settle()
        code, d, r, s = (np.concatenate(x) for x in zip(*self.entries))
        self.entries = []
        at, data = _flat(self.strings)
        length = np.diff(at)
        copies = d > self.doc[code]
        yield d[copies], r[copies], s[copies], length[code[copies]]
        code, d, r, s = (x[~copies] for x in (code, d, r, s))
        order = np.argsort(code)
        code, d, r, s = (x[order] for x in (code, d, r, s))
        first = np.searchsorted(code, np.arange(len(length) + 1))
        # a string that has its key alone has no other to match; indexes hold whole keys
        by = np.argsort(self.key, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], self.key[by[1:]] != self.key[by[:-1]]))) if len(by) else by
        size = np.diff(np.append(new, len(by)))
        by, new = by[np.repeat(size > 1, size)], np.cumsum(np.append(0, size[size > 1]))[:-1]
        total, lo = np.cumsum(length[by]), 0
        for hi in np.append(new[1:], len(by)).tolist():
            if hi < len(by) and total[hi - 1] - (total[lo - 1] if lo else 0) < shard:
                continue
            own = by[lo:hi]
            own, lo = own[np.argsort(self.doc[own], kind="stable")], hi
            if not len(own):
                continue
            # the smallest document of a key has none to look for
            _, of = np.unique(self.key[own], return_inverse=True)
            low = np.full(of.max() + 1, _LAST)
            np.minimum.at(low, of, self.doc[own])
            asked = np.flatnonzero(self.doc[own] > low[of])
            string, offset = RunIndex(data[np.repeat(at[own], length[own]) + _counted(length[own])], length[own], self.doc[own], LENGTH, asked).matches()
            if not len(string):
                continue
            # runs of matched windows, then those of each place of the string
            cut = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))))
            n, which = np.diff(np.append(cut, len(string))), own[string[cut]]
            places = first[which + 1] - first[which]
            e = np.repeat(first[which], places) + _counted(places)
            yield d[e], r[e], s[e] + np.repeat(offset[cut], places), np.repeat(n, places) + LENGTH - 1


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def indexed_matches(docs: DataFrame, ranges: int, hot: np.ndarray, shard: int = SHARD) -> DataFrame:
    """(doc_id, _row, start, length) of the matches at the anchors in spans; docs has compressed texts."""
    told = docs.sparkSession.sparkContext.broadcast(hot)  # MOST_HOT numbers at most

    def entries(texts, spans):
        frequent = told.value
        for data, which, start, at in _buffers(texts):
            p, h, lo, hi = anchors(data, start[1:])
            own, end = np.searchsorted(start, p, "right") - 1, np.append(start[1:], len(data))
            wanted = []
            for k, s0, e0, a0 in zip(which.tolist(), start.tolist(), end.tolist(), at.tolist()):
                w = spans[k][0] - a0
                wanted.append(w[(w >= 0) & (w < e0 - s0)] + s0)
            fine = np.isin(p, np.concatenate(wanted))
            h, lo, hi, own = h[fine], lo[fine], hi[fine], own[fine]
            if len(frequent):
                many = np.isin(_range_of(h, ranges) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64), frequent)
                if many.any():
                    n = (hi - lo + 1)[many]
                    one = np.repeat(lo[many], n) + _counted(n)
                    h, own = np.concatenate((h[~many], window_hashes(data, LENGTH)[one])), np.concatenate((own[~many], np.repeat(own[many], n)))
                    lo, hi = np.concatenate((lo[~many], one)), np.concatenate((hi[~many], one))
            yield which[own], h, lo - start[own] + at[own], _strings(data, lo, hi - lo + LENGTH)

    def run(batches):
        for held in _held(batches, entries):
            *columns, strings = zip(*held)
            d, r, h, s = (np.concatenate(c) for c in columns)
            strings = pa.concat_arrays(strings)
            coded = strings.dictionary_encode()
            code = coded.indices.to_numpy()
            low = np.full(len(coded.dictionary), _LAST)
            np.minimum.at(low, code, d)
            n, done = np.diff(_flat(strings)[0]), d > low[code]
            send = np.flatnonzero(~done)
            yield _rows(_range_of(h[send], ranges), h[send], d[send], r[send], s[send], n[send], strings.take(pa.array(send)))
            if done.any():
                d, r, s, n = joined(d[done], r[done], s[done], n[done])
                yield _rows(-1 - ((d ^ r) % max(ranges, 1)), s, d, r, s, n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, unzip = _Fold(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(len(b)):
                if b["range"][k].as_py() < 0:
                    yield from _settled(b, k)
                else:
                    h, d, r, s, n = _unpacked(b, k)
                    ends = np.cumsum(n, dtype=np.int32)
                    fold.add(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate((np.zeros(1, np.int32), ends))), pa.py_buffer(unzip(b["text"][k].as_py()))]), h, d, r, s)
        for found in fold.spans(shard):
            yield from _spans(*found)

    return docs.mapInArrow(trimmed(run), _ROW).groupBy("range").applyInArrow(trimmed(meet), _FOUND)


def mark_matches(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with spans: every byte of a 50-byte string that also starts in a smaller document."""
    space = Workspace(docs.sparkSession)
    docs = keyed(docs, space)
    own = docs.select("doc_id", "_row", "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, min(1 << 30, -(-total // PER_RANGE)))
    found = space.table(shared_anchors(own, ranges, hot), "anchors")
    packed, frequent = space.table(pack_spans(found.filter("start >= 0")), "packed"), hot_anchors(found)
    space.drop(found)
    texts = _zipped(own)
    here = (F.coalesce(texts["doc_id"], F.lit(_LAST)) == packed["_of"]) & (texts["_row"] == packed["_at"])
    matches = indexed_matches(texts.join(packed, here).select("doc_id", "_row", "text", "spans"), ranges, frequent)
    spans = space.table(pack_spans(matches), "spans")
    return docs.join(spans, (F.coalesce(docs["doc_id"], F.lit(_LAST)) == spans["_of"]) & (docs["_row"] == spans["_at"]), "left").drop("_of", "_at", "_row")


def drop_matches(docs: DataFrame) -> DataFrame:
    """docs with the matches cut out of text."""
    inner, names = set_aside(docs, "doc_id", "text")
    return removed_text(mark_matches(inner)).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf: str) -> DataFrame:
    return removal_report(mark_matches(spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet")))

