"""Connected components of a link table, by alternating star contractions.

Each round is a few shuffles over the links that are left; links and labels
stay in the cluster, and only a count of unfinished links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.storage import discard, materialize, spread_join


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node with a link; root is its component's smallest node.

    ``links`` has two columns of one orderable type. Self links, repeated links
    and links with a null end are ignored. No links: no rows.

    A round first ties every node's larger neighbours to the smallest node of
    its neighbourhood, then its smaller ones; components become stars in a
    number of rounds that grows with the logarithm of the longest path.
    """
    a, b = links.columns
    a, b = F.col(a), F.col(b)
    now = materialize(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(rounds):
        # large star: u's neighbours above u go to the smallest node around u
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a hub has a single smallest node; joining keeps its links split over tasks
        large = spread_join(both.where(F.col("v") > F.col("u")), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below u go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        then = materialize(small, "links")
        # a forest of stars: no node hangs from two roots, or from one while others hang from it
        ends = then.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(then.select("v", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs + holds > 1").limit(1).count()
        discard(now)
        now = then
        if not unsettled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
