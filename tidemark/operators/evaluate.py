"""Metrics, trades and tables over ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S

#: Bars of a year, whatever the bar.
YEAR = 365
RUN = ("symbol", "strategy")


def sharpe(r: str) -> Column:
    """Mean over sample deviation, annualised; null for a constant or single return."""
    return F.when(F.min(r) < F.max(r), F.try_divide(F.avg(r), F.stddev_samp(r)) * YEAR**0.5)


def drawdown(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(S.upto(S.by(keys))) - 1)


def summary(ledger: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """total_return, cagr, annualised_volatility, sharpe, max_drawdown, trade_count of each run."""
    ratio = F.try_divide(F.max_by("equity", "bar_idx"), F.min_by("equity", "bar_idx"))
    growth = F.pow(ratio, F.try_divide(F.lit(float(YEAR)), F.count("*").cast("double")))
    return drawdown(ledger, keys).groupBy(*keys).agg(
        (ratio - 1).alias("total_return"),
        (F.when(ratio >= 0, growth) - 1).alias("cagr"),
        (F.stddev_samp("strategy_return") * YEAR**0.5).alias("annualised_volatility"),
        sharpe("strategy_return").alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(F.col("turnover") > 0).alias("trade_count"),
    )


def correlation(ledger: DataFrame) -> DataFrame:
    """Pairwise-complete correlation of strategies' returns a symbol; null for a constant one."""
    a = ledger.select("symbol", "bar_idx", F.col("strategy").alias("strategy_a"), F.col("strategy_return").alias("x"))
    b = ledger.select("symbol", "bar_idx", F.col("strategy").alias("strategy_b"), F.col("strategy_return").alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return a.join(b, ["symbol", "bar_idx"]).groupBy("symbol", "strategy_a", "strategy_b").agg(r.alias("corr"))


def cost_impact(ledger: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return ledger.groupBy(*keys).agg(
        (F.product(1 + F.col("gross_return")) - 1).alias("gross"),
        F.sum("fee_drag").alias("fees"),
        F.sum("slippage_drag").alias("slippage"),
        (F.product(1 + F.col("strategy_return")) - 1).alias("net"),
    )


def trades(ledger: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row a closed round trip: a maximal run of bars with a position, and the bar after it."""
    w = S.by(keys)
    inside = F.col("position") != 0
    df = ledger.withColumn("_in", inside).withColumn("_was", F.coalesce(F.lag(inside).over(w), F.lit(False)))
    df = df.withColumn("_price", F.lag("close").over(w)).withColumn("_equity", F.lag("equity").over(w)).withColumn("_time", F.lag("bar_idx").over(w))
    if "timestamp" in ledger.columns:
        df = df.withColumn("_at", F.lag("timestamp").over(w))
    df = df.withColumn("trade_id", F.sum((F.col("_in") & ~F.col("_was")).cast("long")).over(S.upto(w))).where("_in or _was")
    enter, leave = F.col("_in") & ~F.col("_was"), ~F.col("_in") & F.col("_was")
    at = lambda cond, c: F.max(F.when(cond, F.col(c)))
    times = [at(enter, "timestamp").alias("entry_time"), at(leave, "_at").alias("exit_time")] if "timestamp" in ledger.columns else []
    # an exit bar belongs to the trade before it; its costs count
    out = df.groupBy(*keys, "trade_id").agg(
        *times,
        at(enter, "bar_idx").alias("entry_idx"), at(leave, "_time").alias("exit_idx"), at(leave, "bar_idx").alias("_x"),
        at(enter, "_price").alias("entry_price"), at(leave, "_price").alias("exit_price"),
        at(enter, "_equity").alias("_e0"), at(leave, "equity").alias("_e1"),
        F.sum("fee_drag").alias("fees_paid"), F.sum("slippage_drag").alias("slippage_paid"),
    ).where("_x is not null")
    pnl = F.col("_e1") - F.col("_e0")
    named = ["entry_time", "exit_time"] if times else []
    money = [pnl.alias("pnl_dollars"), F.try_divide(pnl, "_e0").alias("pnl_pct"), "fees_paid", "slippage_paid"]
    bars = (F.col("_x") - F.col("entry_idx")).alias("holding_bars")
    return out.select(*keys, "trade_id", *named, "entry_idx", "exit_idx", "entry_price", "exit_price", bars, *money)


def trade_summary(found: DataFrame, runs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Eight numbers a run, also for runs without trades; a trade that gains nothing counts as lost."""
    p = F.col("pnl_dollars")
    won, lost = F.sum(F.when(p > 0, p)), F.sum(F.when(p <= 0, -p))
    factor = F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost).when(won > 0, float("inf"))
    some = found.groupBy(*keys).agg(
        F.count("*").alias("num_trades"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(p > 0, p)).alias("avg_win"),
        F.avg(F.when(p <= 0, p)).alias("avg_loss"),
        factor.alias("profit_factor"),
        F.sum(p).alias("total_pnl_dollars"),
        F.sum("fees_paid").alias("total_fees_paid"),
        F.sum("slippage_paid").alias("total_slippage_paid"),
    )
    zero = ["num_trades", "total_pnl_dollars", "total_fees_paid", "total_slippage_paid"]
    return runs.select(*keys).distinct().join(some, list(keys), "left").fillna(0, zero)


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from least to greatest; the greatest belongs to the last."""
    ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b"))
    at = F.least(F.floor(F.try_divide(F.col(c) - F.col("a"), F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends: one row


def markers(ledger: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Bars where a run buys or sells, for a chart over prices; a first bar counts its whole position."""
    change = F.col("position") - F.coalesce(F.lag("position").over(S.by(keys)), F.lit(0.0))
    return ledger.withColumn("change", change).where("change <> 0").select(*keys, "bar_idx", "close", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"))


def equity_curves(ledger: DataFrame, benchmark: str, keys: Sequence[str] = RUN) -> DataFrame:
    """Each run's equity beside that of the benchmark run of its symbol, for a chart; bars without the benchmark stay, with null."""
    mark = ledger.where(F.col("strategy") == benchmark).select("symbol", "bar_idx", F.col("equity").alias("benchmark"))
    return ledger.select(*keys, "bar_idx", "equity").join(mark, ["symbol", "bar_idx"], "left")


def by_mode(**summaries: DataFrame) -> DataFrame:
    """Summaries of several ways to run, one under the other, each row with its way."""
    tables = [df.withColumn("mode", F.lit(name)) for name, df in summaries.items()]
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def ensemble_turnover(summary_: DataFrame, ensemble: str, members: Sequence[str]) -> DataFrame:
    """Whether an ensemble trades more than its busiest member, a symbol."""
    mine = F.max(F.when(F.col("strategy") == ensemble, F.col("trade_count")))
    most = F.max(F.when(F.col("strategy").isin(list(members)), F.col("trade_count")))
    return summary_.groupBy("symbol").agg(mine.alias("ensemble_trades"), most.alias("most_of_members"), (mine > most).alias("trades_more"))
