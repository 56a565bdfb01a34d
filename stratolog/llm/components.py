"""Connected components of a table of links, by distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolog.llm.shared import Workspace


def components(links: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that is reachable.

    Each round every id takes the smallest label among its neighbours and itself, and then the label of
    that label, so chains shorten as by doubling. Sums are partial before each shuffle, and both sides
    of a join are written tables, so an id with very many links is split like any skewed key.
    """
    two_way = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = space.table(two_way.filter("a <> b").distinct(), "edges")
    labels = space.table(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        met = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label")
        # the new label also goes to what the old label stood for, which joins whole trees at once
        near = met.groupBy("id").agg(F.min("label").alias("m"))
        hooked = labels.join(near, "id").select("id", "label", F.least("label", "m").alias("m"))
        to_root = hooked.groupBy(F.col("label").alias("id")).agg(F.min("m").alias("m"))
        step = hooked.select("id", "m").union(to_root).groupBy("id").agg(F.min("m").alias("m"))
        stepped = space.table(step, "labels")
        jumped = stepped.join(stepped.select(F.col("id").alias("m"), F.col("m").alias("mm")), "m", "left").select("id", F.least("m", "mm").alias("label"))
        after = space.table(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").limit(1).count()
        labels = after
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("the components did not settle")
