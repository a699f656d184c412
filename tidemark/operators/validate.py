"""Walk-forward validation, sweeps and Monte Carlo: folds, parameters and trials are keys of one ledger."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import evaluate as E
from tidemark.operators.ledger import ledger, resolve
from tidemark.sources.bars import normal, uniform


def grid(base: dict, options: dict[str, Sequence], allowed: Callable[[dict], bool] = lambda p: True) -> list[dict]:
    """All allowed combinations in order; none is an error; no options: the base alone."""
    found = [{**base, **dict(zip(options, x, strict=True))} for x in itertools.product(*options.values())]
    found = [p for p in found if allowed(p)]
    if not found:
        raise ValueError("no combination is allowed")
    return found


def folds(bars: DataFrame, train: int, test: int, expanding: bool = False) -> DataFrame:
    """Half-open bar ranges of each symbol's folds; a last partial test range is left out."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= train + test)
    k = n.select("symbol", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train) / test).cast("int") - 1)).alias("fold"))
    start = F.col("fold").cast("long") * test
    first, cut = F.lit(0).cast("long") if expanding else start, start + train
    return k.select("symbol", "fold", first.alias("train_start"), cut.alias("train_end"), cut.alias("test_start"), (cut + test).alias("test_end"))


def sliced(bars: DataFrame, ranges: DataFrame, role: str) -> DataFrame:
    """The bars of each fold's range, numbered anew: indicators warm up inside it."""
    both = bars.join(ranges, "symbol").where((F.col("bar_idx") >= F.col(f"{role}_start")) & (F.col("bar_idx") < F.col(f"{role}_end")))
    given = [c for c in ("timestamp",) if c in bars.columns]
    place = [F.col("bar_idx").alias("global_idx"), (F.col("bar_idx") - F.col(f"{role}_start")).alias("bar_idx")]
    return both.select("symbol", "fold", *given, *place, "close")


def runs(bars: DataFrame, candidates: Sequence, keys: Sequence[str]) -> DataFrame:
    """Every candidate's signal on the bars: param_id, strategy, signal."""
    base, names = bars.columns, [f"p{k}" for k in range(len(candidates))]
    for s, c in zip(candidates, names, strict=True):
        bars = s.add(bars, c, keys)
    run = lambda k, s, c: F.struct(F.lit(k).alias("param_id"), F.lit(s.name).alias("strategy"), F.col(c).alias("signal"))
    each = F.array(*[run(k, s, c) for k, (s, c) in enumerate(zip(candidates, names, strict=True))])
    return bars.select(*base, F.explode(each).alias("_r")).select(*base, "_r.*")


def walk_forward(
    bars: DataFrame, candidates: Sequence, train: int, test: int, expanding: bool = False, metric: str = "sharpe", capital: float = 10_000.0, **costs
) -> tuple[DataFrame, DataFrame]:
    """(selections, stitched): the best candidate of each fold on its training bars (nulls last, the first of equals), and its test bars in a row.

    The stitched ledger is solved again over the joined folds, so cash and units belong to its equity; costs are the folds' own.
    Its strategy is named after the first fold's.
    """
    ranges = folds(bars, train, test, expanding)
    keys = ("symbol", "fold", "param_id", "strategy")
    costs = {"capital": capital, **costs}
    score = E.summary(ledger(runs(sliced(bars, ranges, "train"), candidates, ("symbol", "fold")), keys, **costs), keys)
    order = Window.partitionBy("symbol", "fold").orderBy(F.col(metric).desc_nulls_last(), "param_id")
    chosen = score.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("symbol", "fold", "param_id", "strategy", F.col(metric).alias("score"))
    every = runs(sliced(bars, ranges, "test"), candidates, ("symbol", "fold"))
    tested = every.join(chosen.select("symbol", "fold", "param_id"), ["symbol", "fold", "param_id"])  # only what was chosen has a ledger
    w = S.by(("symbol",), "global_idx")
    flat = resolve(ledger(tested, keys, **costs), w, capital).withColumn("bar_idx", F.row_number().over(w).cast("long") - 1)
    name = F.concat(F.lit("WalkForward("), F.first("strategy").over(S.upto(w)), F.lit(")"))
    return chosen, flat.withColumn("chosen", F.col("strategy")).withColumn("strategy", name)


def fold_report(chosen: DataFrame, stitched: DataFrame) -> DataFrame:
    """What each fold chose, and how that did on its test bars."""
    fold = stitched.select("symbol", "fold", "param_id", F.col("chosen").alias("strategy"), F.col("global_idx").alias("bar_idx"), "strategy_return", "turnover")
    w = S.by(("symbol", "fold"))
    own = fold.withColumn("equity", S.running_product(1 + F.col("strategy_return"), w))
    done = E.summary(own, ("symbol", "fold", "param_id", "strategy"))
    trained = chosen.select("symbol", "fold", F.col("score").alias("train_score"))
    return done.select("symbol", "fold", "strategy", "sharpe", "total_return").join(trained, ["symbol", "fold"])


def stability(chosen: DataFrame) -> DataFrame:
    """The most frequent choice of a symbol (the first chosen among equals), and whether over half the folds made it."""
    n = chosen.groupBy("symbol", "param_id", "strategy").agg(F.count("*").alias("times"), F.min("fold").alias("first"))
    w = Window.partitionBy("symbol")
    n = n.withColumn("folds", F.sum("times").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("times"), "first")))
    return n.where("_n = 1").select("symbol", "param_id", "strategy", "times", "folds", (F.col("times") * 2 > F.col("folds")).alias("stable"))


def sweep(bars: DataFrame, candidates: Sequence, holds: Sequence[int] = (0,), **costs) -> DataFrame:
    """Each candidate with each holding period: metrics and what costs took."""
    df = runs(bars, candidates, ("symbol",)).withColumn("min_holding", F.explode(F.array(*map(F.lit, holds))))
    keys = ("symbol", "param_id", "strategy", "min_holding")
    least = F.col("min_holding") if any(h > 1 for h in holds) else 0
    done = ledger(df.select("symbol", "param_id", "strategy", "min_holding", "bar_idx", "close", "signal"), keys, min_holding=least, **costs)
    return E.summary(done, keys).join(done.groupBy(*keys).agg((F.sum("fee_drag") + F.sum("slippage_drag")).alias("cost_drag")), list(keys))


def _blocks(runs_: DataFrame, trials: int, block: int, seed: int) -> DataFrame:
    """A row a run, trial and block: ``b`` is its place in the trial, ``first`` the bar it begins with."""
    keyed = runs_.where(F.col("n") >= block).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    keyed = keyed.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    first = F.floor(uniform(F.lit(str(seed)), F.col("trial").cast("string"), F.col("b").cast("string")) * (F.col("n") - block + 1)).cast("long")
    return keyed.withColumn("first", first)


def bootstrap_index(runs_: DataFrame, trials: int, block: int = 20, seed: int = 42) -> DataFrame:
    """trial, step, idx: moving blocks of ``block`` bars (1: single bars) drawn anew for each trial until n steps are full.

    runs_: keys and n.  Draws depend on (seed, trial, block number) alone, so equal lengths share them.
    """
    block = max(block, 1)
    keyed = _blocks(runs_, trials, block, seed).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    keyed = keyed.withColumn("step", F.col("b").cast("long") * block + F.col("o")).where("step < n")
    return keyed.withColumn("idx", F.col("first") + F.col("o")).drop("b", "o", "first", "n")


def bootstrap(done: DataFrame, trials: int, block: int = 20, seed: int = 42, keys: Sequence[str] = E.RUN) -> DataFrame:
    """trial paths: keys, trial, step, equity, strategy_return, from the run's first equity; a run's bars are numbered from 0 without gaps.

    Blocks are joined and dealt out by trial whole, and only then become bars.  The join merges: a broadcast table takes a
    page of 64 MB of the driver at least, however few its rows.
    """
    block = max(block, 1)
    n = done.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("equity", "bar_idx").alias("start"))
    bars = F.collect_list(F.struct("strategy_return")).over(S.by(keys).rowsBetween(0, block - 1))  # structs: a null is a bar too
    pieces = done.select(*keys, F.col("bar_idx").alias("first"), bars.alias("_bars")).hint("merge")
    drawn = _blocks(n, trials, block, seed).join(pieces, [*keys, "first"]).repartition(*keys, "trial")
    drawn = drawn.select(*keys, "trial", "b", "first", "n", "start", F.posexplode("_bars").alias("o", "_bar"))
    step, idx = F.col("b").cast("long") * block + F.col("o"), F.col("first") + F.col("o")
    drawn = drawn.select(*keys, idx.alias("idx"), "trial", step.alias("step"), "_bar.strategy_return", "start", "n").where("step < n").drop("n")
    w = S.by((*keys, "trial"), "step")
    return drawn.withColumn("equity", F.col("start") * S.running_product(1 + F.col("strategy_return"), w))


def trial_stats(paths: DataFrame, keys: Sequence[str] = E.RUN) -> DataFrame:
    w = S.by((*keys, "trial"), "step")
    df = paths.withColumn("_dd", F.col("equity") / F.max("equity").over(S.upto(w)) - 1)
    return df.groupBy(*keys, "trial").agg(
        F.max_by("equity", "step").alias("final_equity"),
        F.min("_dd").alias("max_drawdown"),
        E.sharpe("strategy_return").alias("sharpe"),
        F.min("start").alias("start"),
    )


def percentiles(stats: DataFrame, keys: Sequence[str] = E.RUN, at: Sequence[int] = (5, 25, 50, 75, 95)) -> DataFrame:
    """Exact interpolated percentiles of each statistic, and the share of trials that end below their start."""
    p = lambda c: [F.expr(f"percentile({c}, {q / 100})").alias(f"{c}_p{q}") for q in at]
    lost = (F.col("final_equity") < F.col("start")).cast("double")
    return stats.groupBy(*keys).agg(*p("final_equity"), *p("max_drawdown"), *p("sharpe"), F.avg(lost).alias("prob_loss"))


def actual(done: DataFrame, keys: Sequence[str] = E.RUN) -> DataFrame:
    """What the runs themselves came to: actual_final_equity, actual_max_drawdown, actual_sharpe."""
    found = E.drawdown(done, keys).groupBy(*keys)
    return found.agg(
        F.max_by("equity", "bar_idx").alias("actual_final_equity"),
        F.min("drawdown").alias("actual_max_drawdown"),
        E.sharpe("strategy_return").alias("actual_sharpe"),
    )


def bootstrap_report(done: DataFrame, trials: int, block: int = 20, seed: int = 42, keys: Sequence[str] = E.RUN) -> DataFrame:
    """Percentiles of the trials beside the actual figures, a row a run; runs of equal length share their draws."""
    return percentiles(trial_stats(bootstrap(done, trials, block, seed, keys), keys), keys).join(actual(done, keys).hint("merge"), list(keys))


def sample_paths(paths: DataFrame, n: int = 100) -> DataFrame:
    """The equity paths of the first n trials, for a chart."""
    return paths.where(F.col("trial") < n)


def drawdown_comparison(done: DataFrame, ensemble: str, members: Sequence[str], trials: int, block: int = 20, seed: int = 42) -> DataFrame:
    """The drawdowns of an ensemble and of its members on the same draws."""
    some = done.where(F.col("strategy").isin([ensemble, *members]))
    report = bootstrap_report(some, trials, block, seed)
    drawdowns = [c for c in report.columns if c.startswith("max_drawdown_p")]
    return report.select("symbol", "strategy", (F.col("strategy") == ensemble).alias("is_ensemble"), "actual_max_drawdown", *drawdowns)


def noise_report(bars: DataFrame, strategy, trials: int, sigma: float, seed: int = 42, **costs) -> DataFrame:
    """Percentiles of final equity on perturbed bars beside that on the bars themselves."""
    trials_ = noise_robustness(bars, strategy, trials, sigma, seed, **costs)
    found = trials_.groupBy("symbol").agg(*[F.expr(f"percentile(final_equity, {q / 100})").alias(f"final_equity_p{q}") for q in (5, 25, 50, 75, 95)])
    own = ledger(strategy.add(bars), **costs).groupBy("symbol").agg(F.max_by("equity", "bar_idx").alias("actual_final_equity"))
    return found.join(own, "symbol")


def perturbed(bars: DataFrame, trials: int, sigma: float, seed: int = 42) -> DataFrame:
    """Each trial's bars: one factor 1 + N(0, sigma) a bar for the prices; volume is left alone."""
    df = bars.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    f = 1 + sigma * normal(F.lit(str(seed)), F.col("trial").cast("string"), F.col("symbol"), F.col("bar_idx").cast("string"))
    prices = [(F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low", "close")]
    return df.withColumn("_f", f).select("symbol", "trial", "timestamp", "bar_idx", *prices, "volume")


def noise_robustness(bars: DataFrame, strategy, trials: int, sigma: float, seed: int = 42, **costs) -> DataFrame:
    """Final equity of the strategy on each trial's perturbed bars."""
    keys = ("symbol", "trial")
    done = ledger(strategy.add(perturbed(bars, trials, sigma, seed), "signal", keys), keys, **costs)
    return done.groupBy(*keys).agg(F.max_by("equity", "bar_idx").alias("final_equity"))


def best_bootstrap(done: DataFrame, trials: int, block: int = 20, seed: int = 42, metric: str = "sharpe") -> DataFrame:
    """The bootstrap of each symbol's run with the greatest metric (nulls last, the first by name among equals)."""
    order = Window.partitionBy("symbol").orderBy(F.round(metric, 9).desc_nulls_last(), "strategy")
    best = E.summary(done).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("symbol", "strategy")
    return bootstrap_report(done.join(best, ["symbol", "strategy"]), trials, block, seed)


def best_run(metrics: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The run with the greatest metric; nulls last, the first by name among equals."""
    return metrics.orderBy(F.col(metric).desc_nulls_last(), "symbol", "strategy").limit(1)


def fold_count(n: int, train: int, test: int) -> int:
    return max(0, math.floor((n - train) / test))
