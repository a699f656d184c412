"""The ledger: from signals to positions, costs, equity, cash and units, for any number of runs at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S


def held(positions: np.ndarray, least: int) -> np.ndarray:
    """Positions that change only ``least`` bars or more after the last change (bar 0 counts as one)."""
    out, now, at = positions.copy(), positions[0] if len(positions) else 0.0, 0
    for i in range(1, len(positions)):
        if positions[i] != now and i - at >= least:
            now, at = positions[i], i
        out[i] = now
    return out


def min_hold(df: DataFrame, least: int, keys: Sequence[str]) -> DataFrame:
    """The one true recurrence: a state machine along each run's bars, one run a group.

    Only positions are touched; the other columns pass through as Arrow data.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_idx")
        m = table["_least"][0].as_py()
        if m <= 1:
            return table
        at = table.column_names.index("position")
        return table.set_column(at, table.field(at), pa.array(held(table["position"].to_numpy(), m)))

    df = df.withColumn("_least", (F.lit(least) if isinstance(least, int) else least).cast("int"))
    return df.groupBy(*keys).applyInArrow(run, df.schema).drop("_least")


def resolve(df: DataFrame, w, capital: float) -> DataFrame:
    """Equity from returns along ``w``, and what it is made of: units held over the bar, and cash."""
    df = df.withColumn("equity", capital * S.running_product(1 + F.col("strategy_return"), w))
    prior, last = F.coalesce(F.lag("equity").over(w), F.lit(capital)), F.lag("close").over(w)
    df = df.withColumn("units", F.coalesce(F.try_divide(F.col("position") * prior, last), F.lit(0.0)))
    return df.withColumn("cash", prior * (1 - F.col("position") - F.col("fee_drag") - F.col("slippage_drag")))


def ledger(
    df: DataFrame, keys: Sequence[str] = S.KEYS, fee: float = 0.001, capital: float = 10_000.0, slippage_bps: float = 5.0, min_holding: int = 0
) -> DataFrame:
    """One row a bar and run: yesterday's signal is today's position; costs follow turnover; cash + units * close = equity."""
    w = S.by(keys)
    df = df.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0.0)))
    if not isinstance(min_holding, int) or min_holding > 1:
        df = min_hold(df, min_holding, keys)
    df = df.withColumn("asset_return", F.coalesce(S.change("close", w), F.lit(0.0)))
    df = df.withColumn("turnover", F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.lit(0.0)))
    df = df.withColumn("gross_return", F.col("position") * F.col("asset_return"))
    df = df.withColumn("fee_drag", F.col("turnover") * fee).withColumn("slippage_drag", F.col("turnover") * (slippage_bps / 10_000))
    df = df.withColumn("strategy_return", F.col("gross_return") - F.col("fee_drag") - F.col("slippage_drag"))
    return resolve(df, w, capital)


def signals(df: DataFrame, strategies: Sequence, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """All strategies in one pass over the bars, then one row a bar and strategy."""
    names = [f"s{k}" for k in range(len(strategies))]
    base = df.columns
    for s, c in zip(strategies, names, strict=True):
        df = s.add(df, c, keys)
    runs = F.array(*[F.struct(F.lit(s.name).alias("strategy"), F.col(c).alias("signal")) for s, c in zip(strategies, names, strict=True)])
    return df.select(*base, F.explode(runs).alias("_r")).select(*base, "_r.strategy", "_r.signal")
