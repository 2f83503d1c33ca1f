"""Connected components by alternating large-star and small-star steps.

Each step connects the neighbours of a node with its least neighbour, so a hub's
edges are dealt over tasks: least neighbours come from a partial aggregate, and
edges of a node with more than its share of all are salted when they meet it.
Rounds grow with the square of the logarithm of the nodes at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_tables, materialize

#: A node is hot when it has more than one part in this many of an average task's edges.
HOT_A_TASK = 4


def _met(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (g, u, v) with ``m``, the least of u; edges of hot nodes are dealt over salts by v."""
    share = max(1, total // (HOT_A_TASK * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(least.where(F.col("n") > share).select("g", "u", salts.alias("salts")))  # at most HOT_A_TASK a shuffle partition
    left = edges.join(hot, ["g", "u"], "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))).drop("salts")
    right = least.select("g", "u", "m", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, salts - 1).otherwise(0))).alias("salt"))
    return left.join(right, ["g", "u", "salt"])


def _step(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Large star: neighbours above u go to u's least; small star: u and its neighbours below go to the least of these."""
    both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("g", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    met = _met(both, least, 2 * total if large else total)
    if large:
        made = met.where(F.col("v") > F.col("u")).select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = met.select("g", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("g", "u", F.col("m").alias("v")))
    return made.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, group: str | Column, a: str, b: str) -> DataFrame:
    """``g, node, component``: of each node of ``edges`` the least node of its group that edges reach.  Loops and repeats don't matter."""
    g = F.col(group) if isinstance(group, str) else group
    plain = edges.select(g.alias("g"), F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = materialize(plain.select("g", F.explode(F.array("u", "v")).alias("node")).distinct(), "star-nodes")
    now = materialize(plain.where("u <> v").distinct(), "stars")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = mark(now)
    while before.n:
        middle = materialize(_step(now, before.n, True), "stars")
        after = materialize(_step(middle, middle.count(), False), "stars")
        drop_tables(now, middle)
        now, found = after, mark(after)
        if found == before:
            break
        before = found
    out = materialize(nodes.join(now.select("g", F.col("u").alias("node"), "v"), ["g", "node"], "left").select("g", "node", F.coalesce("v", "node").alias("component")), "components")
    drop_tables(now, nodes)
    return out
