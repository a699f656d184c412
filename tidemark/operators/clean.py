"""Cleaning: duplicates, regular grid, bounded forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import PRICES


def dedupe(df: DataFrame, keys=("symbol", "timestamp"), seq: str = "ingest_seq") -> DataFrame:
    """The first row of each timestamp in order of arrival."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def median_step(df: DataFrame) -> DataFrame:
    """Median microseconds from bar to bar of each symbol with three bars or more."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    gaps = df.withColumn("_gap", at - F.lag(at).over(w))
    step = F.expr("percentile(_gap, 0.5)").cast("long").alias("step_us")
    return gaps.groupBy("symbol").agg(F.count("*").alias("n"), step).where("n >= 3 and step_us > 0").select("symbol", "step_us")


def fill_gaps(df: DataFrame, max_fill: int = 3) -> DataFrame:
    """Missing points of each symbol's regular grid are filled forward for ``max_fill`` bars and dropped beyond.

    A symbol whose grid lacks nothing, or of under three bars, is left as it is; else rows off the grid go.
    """
    step = median_step(df)
    ends = df.groupBy("symbol").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).join(step, "symbol")
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr("make_dt_interval(0, 0, 0, step_us / 1000000.0)"))).alias("timestamp"))
    lack = grid.join(df, ["symbol", "timestamp"], "left_anti").groupBy("symbol").agg(F.count("*").alias("lacking"))
    prices = df.select("symbol", "timestamp", *[F.col(c).cast("double") for c in PRICES])
    on = grid.join(lack, "symbol", "left_semi").join(prices, ["symbol", "timestamp"], "left")
    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(-max_fill, 0)
    filled = on.select("symbol", "timestamp", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in PRICES]).dropna(subset=list(PRICES))
    return filled.unionByName(prices.join(lack, "symbol", "left_anti"))


def clean(df: DataFrame, max_fill: int = 3) -> DataFrame:
    """Duplicates, then gaps; rows with a null price go."""
    return fill_gaps(dedupe(df), max_fill)


def report(raw: DataFrame, bars: DataFrame, max_fill: int = 3) -> DataFrame:
    """What cleaning does to each symbol: duplicate timestamps that go, grid points that lack a bar, of these filled and dropped.

    raw: symbol, timestamp of all rows; bars: one row a timestamp, as fill_gaps takes it.  Symbols that fill_gaps leaves alone have zeros.
    """
    twice = raw.groupBy("symbol").agg((F.count("*") - F.count_distinct("timestamp")).alias("duplicates"))
    filled = fill_gaps(bars, max_fill).select("symbol", "timestamp")
    step = median_step(bars)
    ends = bars.groupBy("symbol").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).join(step, "symbol")
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr("make_dt_interval(0, 0, 0, step_us / 1000000.0)"))).alias("timestamp"))
    lack = grid.join(bars, ["symbol", "timestamp"], "left_anti")
    done = lack.join(filled.withColumn("_ok", F.lit(1)), ["symbol", "timestamp"], "left").groupBy("symbol")
    found = done.agg(F.count("*").alias("missing"), F.count("_ok").alias("filled"), (F.count("*") - F.count("_ok")).alias("dropped"))
    return twice.join(found, "symbol", "left").fillna(0, ["missing", "filled", "dropped"])
