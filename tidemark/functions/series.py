"""Column builders over ordered bars.  A window is (keys, bar_idx); frames never look ahead."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol",)


def by(keys: Sequence[str] = KEYS, order: str = "bar_idx"):
    return Window.partitionBy(*keys).orderBy(order)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn: Callable, c: str, n: int, w, last: int = 0) -> Column:
    """fn over the n rows that end ``-last`` rows back; null until n values are there."""
    frame = w.rowsBetween(last - n + 1, last)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def change(c: str, w) -> Column:
    """Relative change from the bar before; null on the first bar and after a zero."""
    return F.try_divide(F.col(c), F.lag(c).over(w)) - 1


def with_ewm(df: DataFrame, means: dict[str, tuple[str, float]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Recursive exponential means, each seeded by the first value that isn't null: out -> (column, alpha).

    One pass along each key's bars carries the means, so time and memory follow the bars and nothing is cut off.  Only the
    columns in question are read; the others pass through as Arrow data.  After a null the last mean stands.
    """
    schema = T.StructType([f for f in df.schema if f.name not in means] + [T.StructField(out, T.DoubleType()) for out in means])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_idx")
        found = {out: table[c].to_pandas().astype("float64").ewm(alpha=alpha, adjust=False).mean() for out, (c, alpha) in means.items()}
        for out, values in found.items():
            if out in table.column_names:
                table = table.drop_columns([out])
            table = table.append_column(out, pa.Array.from_pandas(pd.Series(values), type=pa.float64()))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def running_product(c: Column, w) -> Column:
    return F.product(c).over(upto(w))


def trigger_hold(enter: Column, leave: Column, w) -> Column:
    """1 from an entry until an exit (which wins where both hold), 0 before any."""
    mark = F.when(F.coalesce(leave, F.lit(False)), 0.0).when(F.coalesce(enter, F.lit(False)), 1.0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(upto(w)), F.lit(0.0))


def with_rsi(df: DataFrame, n: int, out: str, keys: Sequence[str] = KEYS, c: str = "close") -> DataFrame:
    """Wilder's relative strength: 100 where nothing fell, null where nothing moved or before n changes."""
    w = by(keys)
    df = df.withColumn("_d", F.col(c) - F.lag(c).over(w))
    moved = F.col("_d").isNotNull()
    df = df.withColumn("_up", F.when(moved, F.greatest("_d", F.lit(0.0)))).withColumn("_down", F.when(moved, -F.least("_d", F.lit(0.0))))
    df = with_ewm(df.withColumn("_n", F.count("_d").over(upto(w))), {"_gain": ("_up", 1 / n), "_loss": ("_down", 1 / n)}, keys)
    value = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.try_divide("_gain", "_loss"))).when(F.col("_gain") > 0, 100.0)
    return df.withColumn(out, F.when(F.col("_n") >= n, value)).drop("_d", "_up", "_down", "_n", "_gain", "_loss")
