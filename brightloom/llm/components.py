"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.batches import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links(a, b)`; root is the smallest node it hangs together with.

    Each round every node takes the smallest grandparent among its neighbours, hands it to its
    parent as well, and skips to its own grandparent, so a chain of n links takes about log n
    rounds. All steps are joins of written tables (a node with very many rows is split at run
    time) and minima that combine before the shuffle; nothing is gathered in one place.
    Links with a null end are left out; no links give no rows.
    """
    ends = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        known = stored(parents.join(above, "root"))
        offers = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("offer"))
        taken = known.join(offers.withColumnRenamed("a", "node"), "node")
        moved = (
            taken.select("node", F.least("root", "grand", "offer").alias("new"), F.col("root").alias("old"))
            .union(taken.select(F.col("root").alias("node"), F.col("offer").alias("new"), F.lit(None).cast("long").alias("old")))
            .groupBy("node")
            .agg(F.min("new").alias("root"), F.max("old").alias("old"))
        )
        parents = stored(moved)
        if parents.filter("root <> old").isEmpty():
            return parents.select("node", "root")
