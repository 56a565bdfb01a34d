"""Near-duplicate vectors: inverted multi-index, multi-sequence traversal, exact verification.

Two codebooks, each fitted to one half of a bounded sample of unit vectors, form a product grid, and every
vector is indexed in its cell. A vector looks for its neighbours cell by cell in the order of a lower
bound of the distance to each cell, up to a reach; of two cells, vectors of the first look into the second. On
a sample of queries, compared with all vectors by brute force, the reach is set such that the target share of
their links is found. Where the queries have too few links to tell, or `exact` is asked for, the reach is the
distance that the similarity allows, and no link is missed. Cosines are computed in double precision.

Equal vectors form a class that is compared once. A cell with many vectors or visitors is dealt out as a
grid of blocks, and a block returns counts and a spanning forest, never its pairs.

Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; vectors of
different lengths don't link. A null vec_id links with nothing and has a null component. Rows of one vec_id
with equal vectors are copies that link with each other; with other vectors they are vectors of their own
that share an id. A cosine that is the threshold but for rounding may fall on either side. An empty table
gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm.components import components
from stratolog.llm.shared import Workspace

SIMILARITY = 0.95
#: Vectors that the codebooks are fitted to, at most; queries that set the reach, and the links of theirs that suffice.
SAMPLE, QUERIES, ENOUGH = 20_000, 512, 200
TARGET = 0.995
#: Bits of a codebook at most: the grid has 4 ** 10 cells at most, which each task holds counts of.
BITS = 10
#: Vectors and visitors of a block.
BLOCK = 512
#: Steps of the histogram of bounds, up to the distance that the similarity allows.
STEPS = 200


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to width."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a fixed seed; an empty cluster keeps its centroid."""
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class Grid:
    """The product of two codebooks of the halves."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.k = k
        self.books = [k_means(h, k) if h.shape[1] else np.zeros((k, 0)) for h in self.halves(sample)]
        self.gaps = [np.maximum(np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=-1)), 1e-12) for c in self.books]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cell of each row, squared lower bounds of its distance to each centroid's region, by half)."""
        near, bounds = [], []
        for h, c, gap in zip(self.halves(x), self.books, self.gaps):
            d = -2 * h @ c.T + (c**2).sum(axis=1)
            own = d.argmin(axis=1)
            # the region of k lies beyond the plane between k and the row's own centroid
            bounds.append(np.maximum((d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own]), 0.0) ** 2)
            near.append(own)
        return near[0] * self.k + near[1], bounds

    def visits(self, bounds: list[np.ndarray], reach: float, occupied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each occupied cell within reach, in the multi-sequence order of each row.

        Each half's centroids are sorted by bound; a row steps through pairs in the order of their sum
        and ends with the first pair beyond reach, so only the corner of the product below it is formed.
        """
        rows, cells, sums = [], [], []
        first, second = (np.argsort(b, axis=1, kind="stable") for b in bounds)
        b1, b2 = (np.take_along_axis(b, o, axis=1) for b, o in zip(bounds, (first, second)))
        for i in range(self.k):
            go = np.flatnonzero(b1[:, i] <= reach)
            if not len(go):
                break
            for j in range(self.k):
                go = go[b1[go, i] + b2[go, j] <= reach]
                if not len(go):
                    break
                cell = first[go, i] * self.k + second[go, j]
                fine = occupied[cell]
                rows.append(go[fine])
                cells.append(cell[fine])
                sums.append(b1[go[fine], i] + b2[go[fine], j])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((np.concatenate(sums), row))
        return row[order], cell[order]


def _links_in_block(ids: np.ndarray, mult: np.ndarray, x: np.ndarray, size: np.ndarray, asks: np.ndarray, own: np.ndarray, least: float):
    """(id, links, root) of the block's linked ids; asks marks visitors, which in their own cell look for larger ids only."""
    q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
    near = (x[q] @ x[r].T >= least) & (~own[q][:, None] | (ids[q][:, None] < ids[r][None, :])) & (size[q][:, None] == size[r][None, :])
    a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(a, b)]
    ia, ib = ids[q[a]], ids[r[b]]
    la, lb = ia.copy(), ib.copy()
    top = np.iinfo(np.int64).max
    while len(a):
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return np.concatenate((ia, ib)), np.concatenate((near @ mult[r[b]], mult[q[a]] @ near)).astype(np.int64), np.concatenate((la, lb))


def link_vectors(vectors: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    space = Workspace(spark)
    e = F.col("embedding")
    sound = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.when(sound, e).alias("embedding"))
    valid = rows.filter(F.col("embedding").isNotNull())
    # classes are numbered once they are written, as two of them may have one smallest vec_id
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("mult"))
    reps = space.table(classes.withColumn("rep", F.monotonically_increasing_id()), "reps")
    total, width = reps.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return none
    radius = 2 - 2 * similarity
    sample = reps.orderBy(F.xxhash64("low"), "low", F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    fit = unit_rows(sample, width)
    k = int(min(len(fit), 2 ** min(BITS, max(1, round(math.log2(math.sqrt(total) / 4 + 1))))))
    grid, asked = Grid(fit, k), fit[:QUERIES]
    shared = spark.sparkContext.broadcast((grid, asked))
    bounds_asked = grid.place(asked)[1]

    def measure(batches):
        """Rows (q, step, n) of the queries' links by bound, and with q = -1 of the vectors by cell."""
        g, queries = shared.value
        hist, cells = np.zeros((len(queries), STEPS + 1), np.int64), np.zeros(k * k, np.int64)
        for b in batches:
            x = unit_rows(b["embedding"], width)
            cell, _ = g.place(x)
            cells += np.bincount(cell, minlength=k * k)
            q, r = np.nonzero(queries @ x.T >= similarity)
            low = bounds_asked[0][q, cell[r] // g.k] + bounds_asked[1][q, cell[r] % g.k]
            np.add.at(hist, (q, np.minimum(np.ceil(low / radius * STEPS), STEPS).astype(np.int64)), 1)
        q, s = np.nonzero(hist)
        c = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((q, np.full(len(c), -1)))), pa.array(np.concatenate((s, c))), pa.array(np.concatenate((hist[q, s], cells[c])))], ["q", "step", "n"])

    # k * k + QUERIES * STEPS rows at most
    got = reps.select("embedding").mapInArrow(measure, "q long, step long, n long").groupBy("q", "step").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64)
    held, cells = np.zeros(k * k, np.int64), got[got[:, 0] < 0]
    held[cells[:, 1]] = cells[:, 2]
    hist, got = np.zeros((len(asked), STEPS + 1)), got[got[:, 0] >= 0]
    hist[got[:, 0], got[:, 1]] = got[:, 2]
    hist[:, 0] -= 1  # each query finds itself
    reach = set_reach(hist, radius, 1.0 if exact else target)

    def visited(batches):
        g, _ = shared.value
        n = np.zeros(k * k, np.int64)
        for b in batches:
            cell, bounds = g.place(unit_rows(b["embedding"], width))
            row, at = g.visits(bounds, reach, held > 0)
            n += np.bincount(at[at >= cell[row]], minlength=k * k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    asks_of = np.zeros(k * k, np.int64)
    for r in reps.select("embedding").mapInArrow(visited, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        asks_of[r["cell"]] = r["n"]
    by_rows, by_asks = -(-held // BLOCK), -(-asks_of // BLOCK)

    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def deal(batches):
        g, _ = shared.value
        for b in batches:
            ids, size = b["rep"].to_numpy(), np.diff(b["embedding"].offsets.to_numpy())
            cell, bounds = g.place(unit_rows(b["embedding"], width))
            row, at = g.visits(bounds, reach, held > 0)
            fine = at >= cell[row]  # each pair of cells is looked through from one side
            row, at = row[fine], at[fine]
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own_r, own_q = mixed % np.maximum(by_rows[cell], 1).astype(np.uint64), mixed[row] % np.maximum(by_asks[at], 1).astype(np.uint64)
            parts = []
            for who, where, mine, times, asks in ((np.arange(len(ids)), cell, own_r, by_asks[cell], False), (row, at, own_q, by_rows[at], True)):
                rep = np.repeat(np.arange(len(who)), times)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
                block = mine[rep].astype(np.int64)
                parts.append((who[rep], where[rep], other if asks else block, block if asks else other, np.full(len(rep), asks)))
            who, where, r, q, asks = (np.concatenate(c) for c in zip(*parts))
            # vectors travel as they came, and are made units where they are compared
            values = b["embedding"].to_pylist()
            raw = [np.array(v, kind).tobytes() for v in values]
            for lo in range(0, len(who), 20_000):
                w = who[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[lo : lo + 20_000]), pa.array(r[lo : lo + 20_000]), pa.array(q[lo : lo + 20_000]), pa.array(asks[lo : lo + 20_000]), pa.array(cell[w] == where[lo : lo + 20_000]), pa.array(ids[w]), b["mult"].take(pa.array(w)), pa.array(size[w], pa.int32()), pa.array([raw[i] for i in w.tolist()], pa.binary())],
                    ["cell", "r", "q", "asks", "own", "id", "mult", "size", "x"],
                )

    def block(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        size = t["size"].to_numpy()
        flat = pa.array(np.frombuffer(b"".join(t["x"].to_pylist()), kind))
        x = unit_rows(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat), width)
        ids, links, root = _links_in_block(t["id"].to_numpy(), t["mult"].to_numpy(), x, size, t["asks"].to_numpy(), t["own"].to_numpy(), similarity)
        return pa.table({"id": pa.array(ids), "n": pa.array(links), "root": pa.array(root)})

    dealt = reps.mapInArrow(deal, "cell long, r long, q long, asks boolean, own boolean, id long, mult long, size int, x binary")
    found = space.table(dealt.groupBy("cell", "r", "q").applyInArrow(block, "id long, n long, root long"), "found")
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), space)
    linked = found.groupBy("id").agg(F.sum("n").alias("n")).join(label, "id").join(reps.select(F.col("rep").alias("id"), "low"), "id")
    smallest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = space.table(linked.join(smallest, "component").select(F.col("id").alias("rep"), "n", "component_id"), "linked")
    classes = reps.join(linked, "rep", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    out = rows.join(space.table(classes, "classes"), "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def set_reach(hist: np.ndarray, radius: float, target: float) -> float:
    """The squared bound up to which cells are visited, from each query's links by step of their bound."""
    if target >= 1 or hist.sum() < ENOUGH:
        return radius
    n = hist.sum(axis=1)
    found = np.cumsum((hist[n > 0] / n[n > 0][:, None]).mean(axis=0))
    # beyond what the sample needs, half as far again, and a fifth of the radius at least
    return radius * min(1.0, max(0.2, 1.5 * int(np.argmax(found >= target - 1e-9)) / STEPS))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e)>0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND list_sum(list_transform(e, lambda x: x*x))>0),
p AS MATERIALIZED (SELECT x.vec_id a, y.vec_id b FROM u x JOIN u y ON x.vec_id<>y.vec_id AND len(x.e)=len(y.e) AND list_cosine_similarity(x.e,y.e)>=0.95),
r(a, b) AS (SELECT a, a FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a=r.b),
c AS (SELECT a, min(b) m FROM r GROUP BY a), n AS (SELECT a, count(*) n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n,0) AS n_links, coalesce(c.m,v.vec_id) AS component_id, coalesce(c.m,v.vec_id)=v.vec_id AS kept
FROM v LEFT JOIN n ON n.a=v.vec_id LEFT JOIN c ON c.a=v.vec_id"""
