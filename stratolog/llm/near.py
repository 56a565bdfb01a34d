"""Near-duplicate documents: SetSketch registers, banded, estimated jointly by likelihood, then verified.

A text is the set of its distinct 5-word shingles. Equal sets form a class, of which one stands for all.
Bands of register values group the representatives; in each group every member is compared with hubs of the
group, not with every other member. A pair goes on if a similarity of the threshold or more is plausible
from both sketches, and is confirmed on the full sets. Members of a group that are then in another component
than the group's largest one meet all of the group's members that aren't in theirs. In a large group they
meet only where they share one of their rarest shingles, as two similar sets must: of n shingles, n - ceil(0.75 n)
+ 1 suffice. So no pair of a shared band goes uncompared unless both are linked already.

Null or empty text and texts without words have no shingle and link with nothing. Each row has a result of its
own: rows of one doc_id with equal texts are linked, rows of one doc_id with other texts are documents of
their own that share an id, and near_dedup drops only those that are copies. A null doc_id links with nothing,
has a null component and is kept. Equal texts are linked. Texts are read whole, whatever their length. An
empty table gives an empty one. Other columns are ignored, and kept by near_dedup.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm import sketch
from stratolog.llm.components import components
from stratolog.llm.shared import Workspace, keyed, set_aside, sliced, text_bytes, trimmed
from stratolog.llm.shingles import shingle_sets

#: Per cent.
SIMILARITY = 75
#: 51 bands of 5 registers: of pairs at the threshold about one in a million shares no band.
ROWS = 5
#: More hubs of the largest component that the other members of a group meet before they meet all.
HUB_ROUNDS = 2
#: Larger groups are compared in blocks of so many members.
SMALL, BLOCK = 24, 512
#: Shingles of a block that are looked at together.
TOGETHER = 1 << 20


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, n, print, regs): set size, a 128-bit fingerprint of the set, and its registers."""

    def run(batches):
        for b in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(text_bytes(b["text"]))
            regs = sketch.sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["_row"], pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "_row", "n", "print", "regs"],
            )

    return docs.select("doc_id", "_row", "text").mapInArrow(trimmed(run), "doc_id long, _row long, n long, print binary, regs binary")


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def band_rows(reps: DataFrame, rows: int = ROWS) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                keys = sketch.band_keys(_registers(b["regs"]), rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b["rep"].to_numpy(), keys.shape[1]))], ["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(trimmed(run), "key long, rep long")


def plausible(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for b in batches:
            if len(b):
                fine = sketch.likely_similar(_registers(b["ra"]), _registers(b["rb"]), b["na"].to_numpy(), b["nb"].to_numpy(), similarity / 100)
                yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(fine)), b["b"].filter(pa.array(fine))], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(trimmed(run), "a long, b long")


class Verifier:
    """Confirms pairs on full sets, which are computed once per representative that is ever asked for."""

    def __init__(self, docs: DataFrame, reps: DataFrame, space: Workspace, similarity: int):
        self.docs, self.reps, self.space, self.similarity = docs.select("doc_id", "_row", "text"), reps, space, similarity
        self.known: DataFrame | None = None

    def _shingles(self, ids: DataFrame) -> DataFrame:
        """(rep, shingle) of ids (rep)."""

        def run(batches):
            for b in batches:
                for r, s in zip(b["rep"].to_pylist(), b["shingles"].to_pylist()):
                    h = np.frombuffer(s, np.int64)
                    for lo in range(0, len(h), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[lo : lo + 50_000]), r)), pa.array(h[lo : lo + 50_000])], ["rep", "shingle"])

        return self._sets(ids).join(ids, "rep").mapInArrow(trimmed(run), "rep long, shingle long")

    def shared_sizes(self, ids: DataFrame) -> DataFrame:
        """(rep, n, shared): sizes of the sets of ids (rep), and shingles that another of them has too."""
        shingles = self._shingles(ids)
        alone = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).filter("k = 1")
        own = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
        sizes = self.reps.select("rep", "n").join(ids, "rep")
        return sizes.join(own, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))

    def rarest(self, ids: DataFrame) -> DataFrame:
        """(shingle, rep): of each set of ids (rep) the rarest shingles, of which similar sets share one.

        Sets of similarity s have at least s * n shingles of either in common. With all shingles in one
        order, from rare to frequent, the first n - ceil(s * n) + 1 of both so meet. Those that no other set
        of ids has come first and go.
        """
        shingles = self.space.table(self._shingles(ids), "shingles")
        often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        sizes = self.reps.select("rep", "n").join(ids, "rep")
        listed = shingles.join(often, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("all")).join(sizes, "rep")
        first = F.col("n") - F.ceil(F.col("n") * self.similarity / 100) + 1 - (F.col("n") - F.size("all"))
        return listed.select(F.explode(F.slice("all", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("_s"), "rep").select("_s.shingle", "rep")

    def confirm_within(self, groups: DataFrame) -> DataFrame:
        """Links (a, b) between components within each group of groups (key, members, rep, component).

        A group is dealt out as pairs of blocks, and each gives the links that it finds, not its pairs.
        """
        least = self.similarity
        sets = self._sets(groups.select("rep").distinct())
        parts = F.ceil(F.col("members") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("rep"), parts.cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), parts - 1))
        dealt = groups.join(sets, "rep").withColumns({"own": own, "other": other}).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("members", "other")

        def block(table: pa.Table) -> pa.Table:
            t = table.combine_chunks()
            rep, comp, own_ = t["rep"].to_numpy(), t["component"].to_numpy(), t["own"].to_numpy()
            each = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            n = np.array([len(x) for x in each])
            same = np.zeros((len(each), len(each)), np.float32)
            # sets are sorted: each step takes what of them lies in a range of hashes
            steps = -(-int(n.sum()) // TOGETHER)
            bounds = [k * ((1 << 64) // steps) for k in range(1, steps)]
            cuts = np.array([[0, *np.searchsorted(x, np.array(bounds, np.uint64)).tolist(), len(x)] for x in each])
            for k in range(steps):
                parts = [x[c[k] : c[k + 1]] for x, c in zip(each, cuts)]
                _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
                fine = (times > 1)[at]
                doc, column = np.repeat(np.arange(len(each)), cuts[:, k + 1] - cuts[:, k])[fine], (np.cumsum(times > 1) - 1)[at[fine]]
                for lo in range(0, int((times > 1).sum()), 4096):
                    m = np.zeros((len(each), 4096), np.float32)
                    here = (column >= lo) & (column < lo + 4096)
                    m[doc[here], column[here] - lo] = 1
                    same += m @ m.T
            fit = 100.0 * same.astype(np.float64) >= least * (n[:, None] + n[None, :] - same.astype(np.float64))
            fit &= comp[:, None] != comp[None, :]
            if len(np.unique(own_)) > 1:
                fit &= own_[:, None] != own_[None, :]
            a, b = np.nonzero(np.triu(fit, 1))
            # of the links between two components one is enough
            pairs = np.sort(np.column_stack((comp[a], comp[b])), axis=1)
            first = np.unique(pairs, axis=0, return_index=True)[1] if len(a) else a
            return pa.table({"a": pa.array(rep[a[first]]), "b": pa.array(rep[b[first]])})

        return dealt.select("key", "i", "j", "rep", "component", "own", "shingles").groupBy("key", "i", "j").applyInArrow(block, "a long, b long")

    def _sets(self, ids: DataFrame) -> DataFrame:
        if self.known is not None:
            ids = ids.join(self.known.select("rep"), "rep", "left_anti")

        def run(batches):
            for b in sliced(batches, "text", 1 << 20):
                sets = shingle_sets(text_bytes(b["text"]))
                yield pa.RecordBatch.from_arrays([b["rep"], pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

        asked = self.space.table(self.reps.join(ids, "rep", "left_semi").select("rep", "doc_id", "_row"), "asked")
        new = self.space.table(self.docs.join(asked, ["doc_id", "_row"]).select("rep", "text").mapInArrow(trimmed(run), "rep long, shingles binary"), "sets")
        self.known = new if self.known is None else self.known.union(new)
        return self.known

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The written table of the pairs that reach the similarity; pairs is a written table."""
        ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        sets, least = self._sets(ids), self.similarity

        def run(batches):
            for b in batches:
                keep = []
                for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist()):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((p, q))
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * same >= least * (len(both) - same))
                fine = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b["a"].filter(fine), b["b"].filter(fine)], ["a", "b"])

        side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}"))
        return self.space.table(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(trimmed(run), "a long, b long"), "links")


def near_components(docs: DataFrame, similarity: int = SIMILARITY, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    space = Workspace(docs.sparkSession)
    return _components(keyed(docs.select("doc_id", "text"), space), space, similarity, hub_rounds).drop("_row")


def _numbers(sigs: DataFrame):
    """A number for each class: the smallest doc_id, and for rows that share theirs one that no other row has.

    So the hubs of a group are its smallest and largest doc_ids, of which the smallest is kept if they are copies.
    """
    low, high, odd = sigs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.coalesce(F.max("_row"), F.lit(0))).first()
    if high + odd < 1 << 63:
        own = F.lit(high) + F.col("_row")
    elif low - odd >= -1 << 63:
        own = F.lit(low) - F.col("_row")
    else:  # ids of both ends: any numbers will do, once they are written
        return F.monotonically_increasing_id()
    return F.when(F.col("_row") == 0, F.col("doc_id")).otherwise(own)


def _components(docs: DataFrame, space: Workspace, similarity: int, hub_rounds: int) -> DataFrame:
    """near_components of rows that are told apart by doc_id and _row."""
    spark = docs.sparkSession
    sigs = space.table(signatures(docs), "signatures")
    named = sigs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("print").agg(F.min(F.struct("doc_id", "_row")).alias("low"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    classes = classes.select("print", "low.doc_id", "low._row", "n", "regs")
    reps = space.table(classes.withColumn("rep", _numbers(sigs)), "reps")
    bands = band_rows(reps)
    keys = space.table(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("size > 1"), "keys")
    groups = space.table(bands.join(keys, "key").select("key", "rep", "low", "high"), "groups")
    verifier, links = Verifier(docs, reps, space, similarity), spark.createDataFrame([], "a long, b long")

    hubs = groups.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(groups.select(F.col("high").alias("a"), F.col("rep").alias("b")))
    met = hubs.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = space.table(met, "pairs")
    fit = space.table(plausible(pairs.select("a", "b"), reps, similarity), "plausible")
    # each document first meets the hub with which it shares most bands; most links are made so
    best = fit.join(pairs, ["a", "b"]).groupBy("b").agg(F.max(F.struct("shared", F.col("a").alias("a"))).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = verifier.confirm(space.table(best, "best"))
    label = components(links, space)

    def apart(p: DataFrame) -> DataFrame:
        """Of the pairs those that no component joins."""
        side = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        both = p.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = space.table(apart(fit), "rest")
    if rest.limit(1).count():
        links = links.union(verifier.confirm(rest))
        label = components(links, space)
    for k in range(hub_rounds + 1):
        told = groups.select("key", "rep").join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        told = space.table(told, "told")
        sizes = told.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep")).alias("hub"))
        split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "component", F.col("hub.rep").alias("hub"))).alias("m")).filter("parts > 1")
        split = space.table(split.select("key", F.col("m.component").alias("largest"), F.col("m.hub").alias("hub")), "split")
        odd = told.join(split, "key").filter("component <> largest")
        if k < hub_rounds:
            new = odd.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        else:
            # groups with the same members need one look
            there = space.table(told.join(split.select("key", "largest"), "key"), "there")
            one = there.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
            one = space.table(one.groupBy("members", "who").agg(F.min("key").alias("key")).select("key", "members"), "one")
            there = space.table(there.join(one, "key"), "there")
            # exact bounds: of a pair's shingles at most those are common that some other member has as well
            sizes = verifier.shared_sizes(space.table(there.select("rep").distinct(), "members"))
            can = space.table(sizes.filter(100 * F.col("shared") >= similarity * F.col("n")), "can")
            all_ = space.table(there.join(can, "rep"), "able")
            side = lambda x: all_.select("key", F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"))
            small = all_.filter((F.col("members") <= SMALL) & (F.col("component") != F.col("largest")))
            most = F.least("sa", "sb")
            able = (F.col("ca") != F.col("cb")) & (100 * most >= similarity * (F.col("na") + F.col("nb") - most))
            odd = space.table(small.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("shared").alias("sb")), "odd")
            met = odd.join(side("a"), "key").filter(able)
            new = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            # members of large ones are compared where rare shingles bring them together
            large = space.table(all_.filter(F.col("members") > SMALL).select("rep", "component").distinct(), "large")
            if large.limit(1).count():
                met = space.table(verifier.rarest(large.select("rep")).join(large, "rep").select(F.col("shingle").alias("key"), "rep", "component"), "rare")
                one = met.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
                one = one.filter("_low <> _high").groupBy("members", "who").agg(F.min("key").alias("key")).select("key", "members")
                met = space.table(met.join(space.table(one, "one"), "key"), "met")
                few = met.filter(F.col("members") <= SMALL)
                new = new.union(few.select("key", F.col("rep").alias("a"), F.col("component").alias("ca")).join(few.select("key", F.col("rep").alias("b"), F.col("component").alias("cb")), "key").filter("a > b and ca <> cb").select("a", "b"))
                many = space.table(met.filter(F.col("members") > SMALL), "many")
                if many.limit(1).count():
                    found = space.table(verifier.confirm_within(many), "links")
                    if found.limit(1).count():
                        links = links.union(found)
                        label = components(links, space)
        new = space.table(plausible(space.table(new.distinct(), "new"), reps, similarity), "plausible")
        if new.limit(1).count():
            found = verifier.confirm(new)
            if found.limit(1).count():
                links = links.union(found)
                label = components(links, space)
    # the smallest doc_id of each component
    of = reps.select("rep", "doc_id").join(label.select(F.col("id").alias("rep"), "component"), "rep")
    smallest = of.groupBy("component").agg(F.min("doc_id").alias("_low"))
    joined = of.join(smallest, "component").select("rep", "_low")
    of_print = reps.select(F.col("print").alias("_print"), "rep", F.col("doc_id").alias("_own")).join(joined, "rep", "left").select("_print", F.coalesce("_low", "_own").alias("_low"))
    found = sigs.select("doc_id", "_row", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    component = F.coalesce("_low", "doc_id")
    return found.join(of_print, F.col("print") == F.col("_print"), "left").select("doc_id", "_row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one document, the smallest doc_id, of each group of near copies."""
    space = Workspace(docs.sparkSession)
    inner, names = set_aside(docs, "doc_id", "text")
    inner = keyed(inner, space)
    gone = _components(inner.select("doc_id", "_row", "text"), space, similarity, HUB_ROUNDS).filter("not kept").select(F.col("doc_id").alias("_of"), F.col("_row").alias("_at"))
    return inner.join(gone, (F.col("doc_id") == F.col("_of")) & (F.col("_row") == F.col("_at")), "left_anti").select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf: str) -> DataFrame:
    return near_components(spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[ \t\n\x0B\f\r]+'), lambda x: x<>'') w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')]
  ELSE list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) END)) g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id a, y.doc_id b, count(*) k FROM s x JOIN s y ON x.g=y.g AND x.doc_id<y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id=a JOIN n v ON v.doc_id=b WHERE 100*k >= 75*(u.n+v.n-k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a=r.b),
c AS (SELECT a, min(b) m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, coalesce(c.m,d.doc_id) AS component_id, coalesce(c.m,d.doc_id)=d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a=d.doc_id"""
