"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of u is moved to the least of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of u, and u, is moved to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every end is a centre, or has one edge to a centre."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (u, v); component is the least id that can be reached.

    Each round is a written table, so a lost executor costs a round at most; neither edges nor
    labels come to the driver.  Minima are combined before the shuffle, and joins on a busy hub are
    joins that adaptive execution can split.  Edges with a null end or equal ends are left out.
    """
    spark = edges.sparkSession
    now = C.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        after = C.written(_small(_large(now)), "edges")
        C.forget(spark, now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of ``label`` (id, component) after more edges (u, v).

    Only the edges between components take part in the rounds, as edges of the components' names.
    """
    def named(rows: DataFrame, end: str) -> DataFrame:
        return rows.join(label.select(F.col("id").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")

    top = components(named(named(edges.select("u", "v"), "u"), "v"))
    moved = label.join(top.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component", "left")
    fresh = top.join(label.select("id"), "id", "left_anti")
    return moved.select("id", F.coalesce("_c", "component").alias("component")).unionAll(fresh)
