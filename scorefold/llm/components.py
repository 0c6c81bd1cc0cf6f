"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is one aggregation (a partial minimum before the shuffle) and one join on the node and a salt of the neighbour,
so that a node of very many links is dealt over several tasks, which Spark may split further. Links are never expanded into
all pairs, and no node, link or component is gathered on the driver. Each round is written to the shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common


#: Parts that a node's links are dealt to.
SALTS = 8


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v). large: every neighbour above u is linked to u's least neighbour (or u); small: every neighbour below u,
    and u itself, is."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges(u, v); loops and nulls count for nothing."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = common.written(now, "links")
    before = state(now)
    while before[0]:
        after = common.written(star(star(now, True), False), "links")
        common.drop_written(now)
        now, last = after, before
        before = state(now)
        if before == last:
            break
    leaders = now.select("u", "v")
    return leaders.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(leaders.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
