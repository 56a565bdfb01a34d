"""Operators that compare documents or vectors with each other."""

import hashlib
import math
import random
import tracemalloc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratolog.llm import chunks, near, shared, sketch, suffix, vectors
from stratolog.llm.components import components
from stratolog.llm.runindex import RunIndex
from stratolog.llm.shared import Workspace
from stratolog.llm.shingles import shingle_sets, word_hashes
from stratolog.llm.spans import cut, merge_spans, removal_report


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_by_union_find(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)]
    parent = {}
    for a, b in links:
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}


# near copies
def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t))
    ids = sorted(sets)
    parent = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(parent, d), find(parent, d) == d) for d in ids}


def edited(rnd, words, k):
    w = list(words)
    for _ in range(k):
        w[rnd.randrange(len(w))] = "new%d" % rnd.randrange(10**6)
    return " ".join(w)


def test_near_copies_of_a_large_group(spark):
    """A group whose members are linked by chains, so that hubs alone don't join it."""
    rnd = random.Random(5)
    rows, w = [], ["w%d" % i for i in range(120)]
    for g in range(4):
        text = list(rnd.sample(w, 100))
        for k in range(40):
            rows.append((1000 * g + k, " ".join(text)))
            if k % 2:
                text[rnd.randrange(100)] = "e%d" % rnd.randrange(10**6)
            else:
                rows.append((1000 * g + 500 + k, edited(rnd, text, rnd.randrange(1, 6))))
    rows += [(9000 + i, edited(rnd, rnd.sample(w, 100), 3)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_copies_of_odd_rows(odd, odd_rows, empty):
    got = near.near_components(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute_near([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 5, 5, 8, 9, 10, 11]
    assert near.near_components(empty).count() == 0 and near.near_dedup(empty).count() == 0


def test_near_copies_of_rows_that_share_an_id(spark):
    rnd = random.Random(4)
    p, r, q = (" ".join("%s%d" % (c, rnd.randrange(10**6)) for _ in range(60)) for c in "prq")
    rows = [(3, p), (5, p), (5, r), (7, q), (7, q + " end"), (8, r + " more"), (None, p), (5, r)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ends = [(-(1 << 63), p), ((1 << 63) - 1, p), ((1 << 63) - 1, r), (1, q)]
    for some in (ends, ends[1:], ends[:1] + ends[3:]):  # ids that leave no room for numbers
        found = near.near_components(spark.createDataFrame(some + [(1, r), (1, None)], "doc_id long, text string")).collect()
        assert len(found) == len(some) + 2 and sum(x.kept for x in found) == len(some) + 2 - sum(d == (1 << 63) - 1 and (t == r or (-(1 << 63), p) in some) for d, t in some)
    got = sorted(((x.doc_id or 0, x.n_shingles, x.component_id, x.kept) for x in near.near_components(df).collect()), key=str)
    assert got == sorted([(3, 56, 3, True), (5, 56, 3, False), (5, 56, 5, True), (5, 56, 5, True), (7, 56, 7, True), (7, 57, 7, True), (8, 57, 5, False), (0, 56, None, True)], key=str)
    left = sorted(((x.doc_id or 0, x.text) for x in near.near_dedup(df).collect()))
    assert left == sorted([(3, p), (5, r), (5, r), (7, q), (7, q + " end"), (0, p)])


def test_a_large_band_of_other_texts_is_not_compared_in_pairs(spark, monkeypatch):
    """All texts share a band and two thirds of their words with the others, and few of them are copies."""
    rnd = random.Random(6)
    monkeypatch.setattr(near, "band_rows", lambda reps: reps.select(F.lit(1).cast("long").alias("key"), "rep"))
    passage = ["w%d" % i for i in range(200)]
    rows = [(k, " ".join(passage + ["o%d" % rnd.randrange(10**9) for _ in range(90)])) for k in range(300)]
    rows += [(1000 + k, edited(rnd, rows[7 * k][1].split(), 3)) for k in range(30)] + [(2000 + k, " ".join("x%d" % rnd.randrange(3) for _ in range(40))) for k in range(30)]
    compared, confirm = [], near.Verifier.confirm
    monkeypatch.setattr(near.Verifier, "confirm", lambda self, pairs: (compared.append(pairs.count()), confirm(self, pairs))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)
    assert sum(compared) < 5 * len(rows)


def test_shingles_in_pieces_equal_whole(monkeypatch):
    t = ("Ab  c\x0bd é 日本 " * 300).encode()
    whole = word_hashes([t])[0]
    monkeypatch.setattr("stratolog.llm.shingles.STEP", 200)
    assert (word_hashes([t])[0] == whole).all() and len(whole) == len(t.split())
    assert len(shingle_sets([t, b"", b"a b"])[0]) == len(shingles(t.decode()))


@pytest.mark.parametrize("j", [0.0, 0.4, 0.75, 0.95])
def test_sketches_estimate_and_merge(j):
    rng, n = np.random.default_rng(1), 400
    k = round(2 * n * j / (1 + j))
    same, fit = [], []
    for _ in range(30):
        h = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
        a, b = sketch.sketches([h[:n], h[n - k :]])
        same.append((a == b).mean())
        fit.append(sketch.likely_similar(a[None], b[None], np.array([n]), np.array([n]), 0.75)[0])
    assert abs(np.mean(same) - j) < 0.03 and np.mean(fit) == (j >= 0.75)
    assert (sketch.merge(a, b) == sketch.sketches([h])[0]).all()
    assert sketch.sketches([np.zeros(0, np.uint64)]).shape == (1, 256)


# spans
def test_spans_merge_and_cut():
    lo, hi = merge_spans(np.array([5, 1, 3, 20]), np.array([2, 2, 2, 5]))
    assert lo.tolist() == [1, 20] and hi.tolist() == [7, 25]
    assert cut(b"0123456789abcdefghijklmnop", lo, hi) == b"0789abcdefghijp"


# long matches
def long_rest(rows, n=50):
    """What is left of each document, by doc_id."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = {j for i in range(len(b) - n + 1) if first[b[i : i + n]] < d for j in range(i, i + n)}
        out[d] = bytes(c for j, c in enumerate(b) if j not in gone)
    return out


def brute_long(rows, n=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
    return sorted(out)


def test_long_matches_by_brute_force(spark, sf, texts):
    assert sorted(map(tuple, suffix.query(spark, sf).collect())) == brute_long(texts)


def test_run_index_by_brute_force():
    rnd = random.Random(0)
    for trial in range(120):
        alphabet = (b"ab", b"abcd\x00", bytes(range(256)))[trial % 3]
        strings = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 25))) for _ in range(rnd.randrange(1, 14))]
        if trial % 4 == 0:  # repetitive
            strings = [(strings[0] * 3)[rnd.randrange(5) :][: rnd.randrange(1, 25)] or b"x" for _ in strings]
        docs, least = sorted(rnd.randrange(6) for _ in strings), rnd.randrange(1, 8)
        a, b = RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))), np.array(docs), least).matches()
        want = [(j, i) for j, s in enumerate(strings) for i in range(len(s) - least + 1) if any(e < docs[j] and s[i : i + least] in t for t, e in zip(strings, docs))]
        assert list(zip(a.tolist(), b.tolist())) == want


def test_run_index_of_every_byte_value():
    one = bytes(range(256))
    a, b = RunIndex(np.frombuffer(one + one[100:200], np.uint8), np.array([256, 100]), np.array([1, 2]), 50).matches()
    assert a.tolist() == [1] * 51 and b.tolist() == list(range(51))


@pytest.mark.parametrize("hot", [0, 3, 1 << 13])
def test_frequent_anchors_and_many_ranges(spark, texts, hot, monkeypatch):
    """Dealing anchors out by windows, over many ranges, changes nothing."""
    monkeypatch.setattr(suffix, "PER_RANGE", 1 << 14)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, removal_report(suffix.mark_matches(df, hot)).collect())) == brute_long(texts)


def test_a_range_of_anchors_meets_in_bounded_memory():
    class Docs:
        """Takes the functions that the operator hands to Spark."""

        mapInArrow = groupBy = lambda self, *_: self

        def applyInArrow(self, f, _):
            return f

    meet, rng, rows, docs_of = suffix.shared_anchors(Docs(), 1, 7), np.random.default_rng(5), [], {}
    for _ in range(20):
        h, d = rng.integers(0, 300_000, 20_000).astype(np.uint64) * np.uint64(14_000), rng.integers(0, 1 << 40, 20_000)
        rows.append(suffix._rows(np.zeros(len(h), np.int64), h, d, np.zeros(len(h), np.int64), d % 999, np.ones(len(h), np.int64)))
        for x, y in zip(h.tolist(), d.tolist()):
            docs_of.setdefault(x, []).append(y)
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    got = [r for b in meet(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(r for r in got if r[2] >= 0) == sorted((d, 0, d % 999, 1) for ds in docs_of.values() if len(set(ds)) > 1 for d in ds)
    assert sorted(r for r in got if r[2] < 0) == sorted((h, 0, -1, len(ds)) for h, ds in docs_of.items() if len(ds) > 7)
    tracemalloc.start()
    for _ in meet(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * batch.nbytes


def test_large_rows_come_in_small_batches(spark):
    shared.prepare(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(24).select((F.col("id") % 1).alias("range"), F.expr("cast(repeat('x', 1048576) as binary)").alias("text"))
    got = rows.groupBy("range").applyInArrow(shared.trimmed(sizes), "n long, size long").collect()
    assert sum(r.n for r in got) == 24 and max(r.size for r in got) < shared.BATCH_BYTES + (2 << 20)


def test_hot_anchors_are_bounded(spark):
    rows = [(k, 0, -1, 1 << k % 7) for k in range(70)] + [(5, 0, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, _row long, start int, length int")
    assert suffix.hot_anchors(df, 25).tolist() == [k for k in range(70) if k % 7 > 4] and len(suffix.hot_anchors(df)) == 70


def test_long_matches_of_odd_and_uniform_rows(spark, odd, odd_rows, empty):
    rnd = random.Random(2)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] is not None and r[0] != 9]
    rows += [(100 + i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(300)))) for i in range(20)] + [(200, "ab" * 100), (201, "ba" * 90), (202, "é" * 60), (203, "é" * 40)]
    from stratolog.llm.spans import removal_report

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, removal_report(suffix.mark_matches(df)).collect())) == brute_long(rows)
    assert removal_report(suffix.mark_matches(odd.select("doc_id", "text"))).count() == len(odd_rows)
    out = suffix.drop_matches(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert {r.text for r in out.collect() if r.doc_id == 6} == {""} and suffix.drop_matches(empty).count() == 0


def test_every_window_has_its_anchor(monkeypatch):
    raw = bytes(random.Random(1).choice(b"abc") for _ in range(3000))
    p, _, lo, hi = suffix.anchors(np.frombuffer(raw, np.uint8))
    covered = np.zeros(len(raw) - 49, int)
    for a, b in zip(lo, hi):
        covered[a : b + 1] += 1
    assert covered.min() >= 1
    monkeypatch.setattr(suffix, "PART", 400)  # a text in parts has all windows in one of them
    assert sorted({at + i for at, part in suffix._parts(raw) for i in range(len(part) - 49)}) == list(range(len(raw) - 49))


# chunks
def test_chunks_resist_insertions(monkeypatch):
    rnd = random.Random(4)
    t = bytes(rnd.choice(b"abcdefghij ") for _ in range(4000))
    whole = chunks.chunk_ends(t).tolist()
    monkeypatch.setattr(chunks, "PART", 300)
    assert chunks.chunk_ends(t).tolist() == whole
    of = lambda raw: {raw[a:b] for a, b in zip([0, *chunks.chunk_ends(raw)[:-1]], chunks.chunk_ends(raw))}
    a, b = of(t), of(t[:1500] + b"xyz" + t[1500:])
    assert len(a - b) <= 4 and b"".join(t[x:y] for x, y in zip([0, *chunks.chunk_ends(t)[:-1]], chunks.chunk_ends(t))) == t
    assert chunks.chunk_ends(b"").tolist() == [] and chunks.chunk_ends(b"a" * 1300).max() == 1300


def test_gear_hash_by_rolling():
    h, out, data = 0, [], b"some bytes to roll over, longer than the window of thirty-two"
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == out


def plain_chunks(raw):
    """Ends found byte by byte: the rolled hash is above all others within REACH on both sides."""
    h, hashes = 0, []
    for b in raw:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    at, reach = set(), chunks.REACH
    for i in range(reach, len(raw) - reach):
        if hashes[i] > max(hashes[i - reach : i]) and hashes[i] > max(hashes[i + 1 : i + reach + 1]):
            at.add(i + 1)
    move = lambda e: next((x for x in range(e, e + 3) if x >= len(raw) or raw[x] & 0xC0 != 0x80), e + 3)
    ends = sorted({move(e) for e in at if move(e) < len(raw)} | {len(raw)})
    more = {move(x) for s, e in zip([0, *ends], ends) for x in range(s + chunks.LONGEST, e, chunks.LONGEST)}
    return sorted({*ends, *more}) if raw else []


def brute_chunks(rows):
    owner, cut_of = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        e = plain_chunks(raw)
        cut_of.append((d, raw, list(zip([0, *e], e))))
        for lo, hi in cut_of[-1][2]:
            owner[raw[lo:hi]] = min(owner.get(raw[lo:hi], d), d)
    out = []
    for d, raw, parts in cut_of:
        runs = []
        for lo, hi in parts:
            if owner[raw[lo:hi]] < d:
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        runs = [x for x in runs if x[1] - x[0] >= chunks.LEAST]
        gone = {j for lo, hi in runs for j in range(lo, hi)}
        out.append((d, len(raw), len(gone), len(runs), hashlib.sha256(bytes(c for j, c in enumerate(raw) if j not in gone)).hexdigest()))
    return sorted(out)


def test_copied_chunks_by_brute_force(spark, sf, texts, monkeypatch):
    want = brute_chunks(texts)
    assert sum(x[2] for x in want) > 10_000
    assert sorted(map(tuple, chunks.query(spark, sf).collect())) == want
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, removal_report(chunks.mark_copies(df), chunks.LEAST).collect())) == want


def test_copied_chunks_of_odd_rows(spark, odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] is not None]
    got = removal_report(chunks.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), chunks.LEAST)
    assert sorted(map(tuple, got.collect())) == brute_chunks(rows)
    out = chunks.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    first = {r[0]: r[1] for r in odd_rows if r[0]}
    assert by[5] == first[5] and by[6] == "" and by[10] == first[10] and by[8] == first[8]
    assert chunks.drop_copies(empty).count() == 0


# vectors
def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    rows = [base[i % 300] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.05 * (i % 3) for i in range(900)]
    rows += [rows[0]] * 30 + [base[7] + rng.normal(size=16) * 0.01 for _ in range(700)]
    data = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] * 16, [None] * 16, data[0][1][:8]]
    data += [(5000 + i, x) for i, x in enumerate(bad)] + [(None, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    x = np.array([v for _, v in data[: len(rows)]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near_ = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.99 * near_.sum() <= found <= near_.sum()
    assert all(got[i].n_links <= n for i, n in enumerate(near_.sum(axis=1)))
    assert all(got[5000 + i].n_links == 0 and got[5000 + i].kept for i in range(len(bad)))
    assert got[None].component_id is None and got[900].component_id == 0 and not got[900].kept
    again = {r.vec_id: r for r in vectors.link_vectors(df, exact=True).collect()}
    assert [again[i].n_links for i in range(len(x))] == near_.sum(axis=1).tolist()
    assert vectors.link_vectors(df.limit(0)).count() == 0 and vectors.link_vectors(df.filter(F.col("vec_id") >= 5000).filter("vec_id < 5006")).count() == 6


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (7, b), (7, a), (9, [0.0, 2.0, 0.1]), (9, [0.0, 0.0, 1.0]), (3, [3.0, 0.0, 0.0])]
    for kind in ("float", "double"):
        got = sorted(tuple(r) for r in vectors.link_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())
        assert got == sorted([(1, 2, 1, True), (7, 1, 7, True), (7, 2, 1, False), (9, 1, 7, False), (9, 0, 9, True), (3, 2, 1, False)])


def test_reach_is_whole_where_the_sample_can_not_tell():
    few, many = np.zeros((3, vectors.STEPS + 1)), np.zeros((3, vectors.STEPS + 1))
    few[0, 5], many[:, 10], many[0, 190] = 3, 1000, 1
    assert vectors.set_reach(few, 0.1, 0.995) == 0.1 and vectors.set_reach(many, 0.1, 1.0) == 0.1
    assert math.isclose(vectors.set_reach(many, 0.1, 0.995), 0.02)


# rows with null or repeated ids
@pytest.fixture(scope="module")
def rows_alike():
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages = [make(300) for _ in range(6)]
    rows = [(k, make(100) + p + make(80)) for k, p in enumerate(passages)]
    rows += [(50, make(40 * k) + passages[k] + make(700)) for k in range(3)] + [(50, make(900))]
    return rows + [(None, make(30 * k) + passages[k] + make(700)) for k in range(6)] + [(None, make(900)), (None, None), (50, rows[6][1])]


@pytest.mark.parametrize("mark", [suffix.mark_matches, chunks.mark_copies])
def test_rows_of_null_or_repeated_ids_lose_only_their_own(spark, rows_alike, mark):
    last = 1 << 62
    got = removal_report(mark(spark.createDataFrame(rows_alike, "doc_id long, text string").repartition(3))).collect()
    assert len(got) == len(rows_alike)
    got = sorted((last if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    want = brute_long([(last if d is None else d, t) for d, t in rows_alike])
    if mark is suffix.mark_matches:
        assert got == want
    else:  # chunks lie in the long matches
        assert all(a[:2] == b[:2] for a, b in zip(sorted(x[:2] for x in got), sorted(x[:2] for x in want)))
        assert all(x[2] <= 350 for x in got) and all(x[2] == 0 for x in got if x[1] == 900) and sum(x[2] > 0 for x in got) >= 9


def test_null_ids_are_cut_apart(spark, rows_alike):
    df = spark.createDataFrame(rows_alike, "doc_id long, text string").repartition(3)
    for drop in (suffix.drop_matches, chunks.drop_copies):
        left = [r.text for r in drop(df).collect()]
        assert len(left) == len(rows_alike)
        assert all(t in left for d, t in rows_alike if t is None or len(t) == 900)
