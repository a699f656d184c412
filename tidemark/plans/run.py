"""A whole study from a configuration: backtests, costs, trades, walk-forward and Monte Carlo."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean, evaluate as E, strategies as G, validate as V
from tidemark.operators.ledger import ledger, signals
from tidemark.sources import bars as B

# Pairs of parameters of which the first must be the lesser, by the configuration's names.
ORDERED = {
    "ma_crossover": [("fast", "slow")],
    "rsi_mean_reversion": [("buy_below", "exit_above")],
    "donchian_breakout": [("exit_window", "entry_window")],
}


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def costs_of(config: dict) -> dict:
    given = config.get("backtest") or {}
    return {
        "fee": given.get("fee", 0.001), "capital": float(given.get("initial_capital", 10_000)),
        "slippage_bps": given.get("slippage_bps", 5), "min_holding": given.get("min_holding_period", 0),
    }


def candidates_of(entry: dict, grids: dict) -> list[G.Strategy]:
    """Every allowed combination of a strategy's options, over its own parameters."""
    name = entry["name"]
    allowed = lambda p: all(p[a] < p[b] for a, b in ORDERED.get(name, []) if a in p and b in p)
    options = grids.get(name) or {}
    base = dict(entry.get("params") or {})
    return [G.build(name, **p) for p in (V.grid(base, options, allowed) if options else [base])]


def source_of(spark: SparkSession, config: dict, fetch: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The configured exchange's bars, or, where they can't be had, synthetic ones of as many bars."""
    data = config["data"]

    def exchange() -> DataFrame:
        spark.dataSource.register(B.ExchangeBars)
        options = {k: str(data[k]) for k in ("symbol", "timeframe", "limit", "path", "since") if data.get(k) is not None}
        found = spark.read.format("exchange_bars").options(**options, exchange=data.get("exchange_id", "binance")).load()
        found.limit(1).count()  # fails here, not later
        return found

    return B.first_that_works(fetch or exchange, lambda: B.synthetic_bars(spark, data.get("limit", 730)).drop("bar_idx"))


def prepared(raw: DataFrame) -> DataFrame:
    """Cleaned bars, numbered; the first of equal timestamps in order of arrival stays."""
    raw = B.validate(raw)
    seq = raw if "ingest_seq" in raw.columns else raw.withColumn("ingest_seq", F.monotonically_increasing_id())
    return B.indexed(clean.fill_gaps(clean.dedupe(seq).drop("ingest_seq")))


@dataclass
class Study:
    """Tables of a study by name, and the names of its strategies in order."""

    names: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)


def with_ensemble(entries: list[dict]) -> tuple[list[G.Strategy], G.Voting]:
    """The configured strategies, with the fixed ensemble before buy-and-hold."""
    found, ensemble = G.build_all(entries), G.hard_voting()
    at = next((k for k, s in enumerate(found) if s.name == G.BuyAndHold.name), len(found))
    return [*found[:at], ensemble, *found[at:]], ensemble


def backtests(bars: DataFrame, config: dict) -> tuple[DataFrame, list[G.Strategy], G.Voting]:
    strategies, ensemble = with_ensemble(config["strategies"])
    return ledger(signals(bars, strategies), E.RUN, **costs_of(config)), strategies, ensemble


def walk_forwards(bars: DataFrame, config: dict) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(selections, stitched) of each configured strategy over its own grid."""
    sizes, grids = config["walk_forward"], config.get("param_grids") or {}
    return {
        e["name"]: V.walk_forward(bars, candidates_of(e, grids), sizes["train_size"], sizes["test_size"], sizes.get("expanding", False), **costs_of(config))
        for e in config["strategies"]
    }


def study(spark: SparkSession, config: dict, fetch: Callable[[], DataFrame] | None = None) -> Study:
    """All tables that the configuration asks for."""
    bars = prepared(source_of(spark, config, fetch)).cache()
    done, strategies, ensemble = backtests(bars, config)
    done = done.cache()
    names = [s.name for s in strategies]
    out = Study(names)
    plain, found = E.summary(done), E.trades(done)
    out.tables |= {"ledger": done, "metrics": plain, "costs": E.cost_impact(done), "trades": found, "trade_summary": E.trade_summary(found, done)}
    members = [m.name for m in ensemble.members if m.name in names]
    out.tables |= {"correlation": E.correlation(done.where(F.col("strategy").isin([*members, ensemble.name]))), "ensemble_trades": E.ensemble_turnover(plain, ensemble.name, members)}
    out.tables |= {"markers": E.markers(done.where(F.col("strategy") == names[0])), "equity": E.equity_curves(done.where(F.col("strategy").isin([names[0], names[-1]])), names[-1])}
    mc = config.get("monte_carlo") or {}
    if mc.get("enabled"):
        trials, block, sigma = mc.get("n_trials", 5000), mc.get("block_length", 20), mc.get("noise_std", 0.001)
        first = done.where(F.col("strategy") == names[0])
        out.tables |= {
            "bootstrap": V.bootstrap_report(first, trials, block), "paths": V.sample_paths(V.bootstrap(first, trials, block)), "noise": V.noise_report(bars, strategies[0], trials, sigma, **costs_of(config)),
            "ensemble_drawdowns": V.drawdown_comparison(done, ensemble.name, members, trials, block), "best_bootstrap": V.best_bootstrap(done, trials, block),
        }
    if config.get("walk_forward"):
        walked = walk_forwards(bars, config)
        stitched = None
        for name, (chosen, flat) in walked.items():
            out.tables |= {f"selections_{name}": chosen, f"stability_{name}": V.stability(chosen), f"folds_{name}": V.fold_report(chosen, flat)}
            stitched = E.summary(flat) if stitched is None else stitched.unionByName(E.summary(flat))
        out.tables["combined"] = E.by_mode(plain=plain, walk_forward=stitched)
    return out


def sweeps(bars: DataFrame, config: dict) -> dict[str, DataFrame]:
    """Crossovers of all allowed pairs of windows, and the configured strategies with each minimum holding period."""
    given, costs = config["sweep"], costs_of(config)
    pairs = [G.MACrossover(f, s) for f in given["fast_options"] for s in given["slow_options"] if f < s]
    params = {e["name"]: e.get("params") or {} for e in config["strategies"]}
    held = [G.build(name, **params.get(name, {})) for name in given["min_holding_strategies"]]
    costs.pop("min_holding")
    return {"crossovers": V.sweep(bars, pairs, **costs), "min_holding": V.sweep(bars, held, given["min_holding_periods"], **costs)}


def table_text(df: DataFrame, title: str) -> str:
    """A small table as aligned text."""
    return B.text_table(df.columns, [tuple(r) for r in df.collect()], title)


#: Tables that are printed: all have a few rows a run.
PRINTED = ("metrics", "costs", "trade_summary", "ensemble_trades", "correlation", "bootstrap", "noise", "ensemble_drawdowns", "best_bootstrap", "combined")


def run(spark: SparkSession, config: dict, reports: str, fetch: Callable[[], DataFrame] | None = None) -> Study:
    """The study with its report in ``reports``: a summary as text, and a CSV of each strategy's trades."""
    Path(reports).mkdir(parents=True, exist_ok=True)
    with B.printed_to(f"{reports}/analysis_summary.txt"):
        out = study(spark, config, fetch)
        for name, df in out.tables.items():
            if name in PRINTED or name.startswith(("stability_", "folds_")):
                print(table_text(df, f"\n{name}"))
        B.write_trade_logs(out.tables["trades"], out.names, reports)
    return out


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, load_config(argv[0]), argv[1] if len(argv) > 1 else "reports")


if __name__ == "__main__":
    main(sys.argv[1:])
