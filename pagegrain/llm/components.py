"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before its shuffle) and a join on the node; each
round is written to the shared folder, so lineage stays short and no executor's loss costs more
than a step. Nothing is collected but a row count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.storage import stash


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of a common ordered type -> (node, root): every linked node and the least node it can reach.

    Links to itself and with null are ignored; repeated and reversed links change nothing; no links give no rows.
    """
    edges = stash(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        # Large star: every neighbour above a node moves to the least of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minimum(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below it move to the least of these.
        large = stash(large, "links")
        least = _minimum(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
