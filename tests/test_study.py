"""A study from a configuration, live sessions, reconciliation, and sources of bars."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E, ledger as L, strategies as G, validate as V
from tidemark.plans import run as R
from tidemark.sources import bars as B
from tidemark.streaming import live
from tidemark.functions import series as S

CONFIG = {
    "data": {"symbol": "A/B", "timeframe": "1d", "limit": 160},
    "backtest": {"fee": 0.001, "slippage_bps": 5, "min_holding_period": 0, "initial_capital": 10000},
    "strategies": [
        {"name": "ma_crossover", "params": {"fast": 5, "slow": 12}},
        {"name": "rsi_filtered_crossover", "params": {"fast": 20, "slow": 50, "rsi_window": 14, "rsi_overbought": 70.0}},
        {"name": "rsi_mean_reversion", "params": {"window": 10, "buy_below": 20, "exit_above": 50}},
        {"name": "donchian_breakout", "params": {"entry_window": 20, "exit_window": 10}},
        {"name": "soft_voting_ensemble", "params": {"fast": 20, "slow": 50, "rsi_window": 10, "buy_below": 20, "exit_above": 50, "entry_window": 20, "exit_window": 10, "member_sharpes": [-0.9, -0.6, 0.2]}},
        {"name": "buy_and_hold", "params": {}},
    ],
    "param_grids": {"ma_crossover": {"fast": [5, 20], "slow": [12, 20]}},
    "sweep": {"fast_options": [5, 10], "slow_options": [10, 20], "min_holding_periods": [0, 4], "min_holding_strategies": ["ma_crossover", "hard_voting_ensemble"]},
    "walk_forward": {"train_size": 60, "test_size": 30, "expanding": False},
    "monte_carlo": {"enabled": True, "n_trials": 8, "block_length": 10, "noise_std": 0.001},
}


def synthetic(spark, n=160):
    return B.synthetic_bars(spark, n).drop("bar_idx")


def test_every_entry_builds():
    names = [s.name for s in G.build_all(CONFIG["strategies"])]
    assert names[0] == "MACrossover(5,12)" and G.build("hard_voting_ensemble").k == 2
    assert G.build("soft_voting_ensemble", member_sharpes=[1, 3, -1]).weights == [0.25, 0.75, 0]
    assert G.build("soft_voting_ensemble", member_sharpes=[1, 3, -1], weights=[1, 1, 2]).weights == [1, 1, 2]
    assert G.build("soft_voting_ensemble", member_sharpes=[-1, -3, -1]).weights == [1, 1, 1]
    with pytest.raises(KeyError):
        G.build_all([{"name": "none"}])
    assert [c.name for c in R.candidates_of(CONFIG["strategies"][0], CONFIG["param_grids"])] == ["MACrossover(5,12)", "MACrossover(5,20)"]
    with pytest.raises(ValueError):
        R.candidates_of(CONFIG["strategies"][0], {"ma_crossover": {"fast": [50], "slow": [20]}})
    strategies, ensemble = R.with_ensemble(CONFIG["strategies"])
    assert [s.name for s in strategies[-2:]] == [ensemble.name, "BuyAndHold"]


def test_study(spark, tmp_path, capsys):
    out = R.run(spark, CONFIG, str(tmp_path), lambda: synthetic(spark))
    assert len(out.names) == 7 and out.tables["metrics"].count() == 7 and out.tables["combined"].count() == 13
    shown = (tmp_path / "analysis_summary.txt").read_text()
    assert "trade_summary" in shown and "stability_ma_crossover" in shown and shown in capsys.readouterr().out
    assert {p.name for p in tmp_path.glob("*.csv")} == {B.file_name(n) for n in out.names}
    assert "entry_time" in next((tmp_path / B.file_name("BuyAndHold")).glob("part*.csv")).read_text()  # no closed trade: the header alone
    best = out.tables["best_bootstrap"].collect()
    plain = {r.strategy: r.sharpe for r in out.tables["metrics"].collect()}
    assert best[0].actual_sharpe == pytest.approx(max(v for v in plain.values() if v is not None))
    drawdowns = {r.strategy: r for r in out.tables["ensemble_drawdowns"].collect()}
    assert sum(r.is_ensemble for r in drawdowns.values()) == 1 and all(r.max_drawdown_p5 <= r.max_drawdown_p95 <= 0 for r in drawdowns.values())
    assert out.tables["paths"].agg(F.max("trial")).first()[0] == 7
    found = R.sweeps(R.prepared(synthetic(spark)), CONFIG)
    assert found["crossovers"].count() == 3 and found["min_holding"].count() == 4


def test_fallback_source(spark):
    broken = lambda: 1 / 0
    assert R.source_of(spark, CONFIG, broken).count() == 160


def test_exchange_source(spark, tmp_path):
    at = datetime(2024, 1, 1)
    ms = [int((at + timedelta(days=k) - datetime(1970, 1, 1)).total_seconds() * 1000) for k in range(5)]
    rows = [[m, 1, 2, 0.5, 1.5, 10] for m in ms]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    spark.dataSource.register(B.ExchangeBars)
    df = spark.read.format("exchange_bars").options(symbol="A/B", path=str(tmp_path / "c.json"), since=str(ms[1]), limit="3").load()
    got = df.orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [at + timedelta(days=k) for k in (1, 2, 3)] and got[0].close == 1.5
    direct = B.candles(spark, rows, "A/B", since="2024-01-02", limit=3).orderBy("timestamp").collect()
    assert [tuple(r) for r in direct] == [tuple(r) for r in got]


def test_read_bars(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return synthetic(spark, 20)

    for _ in range(2):
        df = B.read_through(spark, fetch, str(tmp_path), B.cache_name("x", "A/B", "1d", 20))
    assert len(calls) == 1 and df.count() == 20 and (tmp_path / "x_A-B_1d_20.parquet").exists()
    B.read_through(spark, fetch, str(tmp_path), "other", since="2020-01-05")
    assert len(calls) == 2 and not (tmp_path / "other").exists()
    some = B.read_bars(spark, str(tmp_path / "x_A-B_1d_20.parquet"), "2020-01-05", 4)
    assert sorted(str(r.timestamp)[:10] for r in some.collect()) == [f"2020-01-{d:02d}" for d in (5, 6, 7, 8)]
    plan = B.read_bars(spark, str(tmp_path / "x_A-B_1d_20.parquet"), "2020-01-05")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp" in plan


def session(spark, tmp_path, windows, **more):
    feed = iter(windows)
    clock = lambda: datetime(2024, 1, 1)
    entry = {"name": "ma_crossover", "params": {"fast": 2, "slow": 3}}
    return live.Session(
        spark, lambda: next(feed), G.build(entry["name"], **entry["params"]), str(tmp_path / "history"), str(tmp_path / "log.jsonl"),
        {"symbol": "SYN", "timeframe": "1d", "exchange_id": "none"}, entry, sleep=lambda s: None, clock=clock, retry={"attempts": 1}, **more)


def test_session_and_reconcile(spark, tmp_path, capsys):
    bars = synthetic(spark, 30).cache()
    first = lambda n: bars.orderBy("timestamp").limit(n)
    s = session(spark, tmp_path, [first(10), first(10), first(14), first(20)])
    got = [s.poll() for _ in range(5)]  # the last finds no window
    assert [r is None for r in got] == [False, True, False, False, True]
    lines = [json.loads(x) for x in (tmp_path / "log.jsonl").read_text().splitlines()]
    assert [x["type"] for x in lines] == ["session_start", "decision", "decision", "decision"] and lines[0]["strategy_params"] == {"fast": 2, "slow": 3}
    done = L.ledger(G.MACrossover(2, 3).add(B.indexed(first(19)))).orderBy(F.desc("bar_idx")).first()
    assert got[3]["equity"] == pytest.approx(done.equity) and got[3]["position"] == done.position
    assert "position=" in capsys.readouterr().out
    diff, sums, worst = live.reconcile(spark, str(tmp_path / "log.jsonl"), lambda header, since, limit: bars)
    assert sums["bars"] == 3 and sums["max_abs_diff"] == pytest.approx(0, abs=1e-6) and worst.count() == 3
    late = bars.withColumn("timestamp", F.col("timestamp") + F.expr("interval 10 years"))
    with pytest.raises(ValueError):
        live.reconcile(spark, str(tmp_path / "log.jsonl"), lambda *a: late)
    asked = []
    live.reconcile(spark, str(tmp_path / "log.jsonl"), lambda header, since, limit: asked.append((since, limit)) or bars, 5)
    assert asked[0][1] == 13 and str(asked[0][0])[:10] == "2020-01-04"
    with pytest.raises(ValueError):
        live.rebuilt({"strategy_registry_name": None})
    with pytest.raises(ValueError):
        live.Session(spark, None, G.BuyAndHold(), "", "")


def test_log_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "session_start"}\n\n{"type": "decision", "equity":\n')
    (tmp_path / "b.jsonl").write_text('{"type": "decision"}\n')
    for name in "ab":
        with pytest.raises(ValueError):
            B.read_log(spark, str(tmp_path / f"{name}.jsonl"))


def test_stream_again(spark, tmp_path, monkeypatch):
    """A batch that fails after its history is written is run again and loses no decision."""
    src = str(tmp_path / "in")
    bars = synthetic(spark, 12)
    bars.coalesce(1).write.parquet(src)
    stream = lambda: live.run_stream(spark.readStream.schema(bars.schema).parquet(src), G.MACrossover(1, 2), *(str(tmp_path / x) for x in ("h", "o", "c")))
    plain = live.decisions
    with monkeypatch.context() as m:
        m.setattr(live, "decisions", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception):
            stream().awaitTermination()
    assert B.exists(spark, str(tmp_path / "h"))
    stream().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o")).collect()
    want = plain(bars.orderBy("timestamp").limit(11), G.MACrossover(1, 2)).first()
    assert len(out) == 1 and out[0].equity == pytest.approx(want.equity)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 11


def test_stitched_ledger(spark):
    bars = B.synthetic_bars(spark, 200)
    chosen, flat = V.walk_forward(bars, [G.MACrossover(3, 8), G.BuyAndHold()], 60, 30)
    assert flat.where("abs(cash + units * close - equity) > 1e-6").count() == 0
    first = chosen.orderBy("fold").first().strategy
    assert {r.strategy for r in flat.select("strategy").collect()} == {f"WalkForward({first})"} and flat.count() == 120
    assert V.fold_report(chosen, flat).count() == 4


def test_ewm_passes_nulls(spark):
    data = [("A", 0, None), ("A", 1, 1.0), ("A", 2, 3.0), ("A", 3, None), ("B", 0, 5.0)]
    df = spark.createDataFrame(data, "symbol string, bar_idx long, x double").withColumn("keep", F.array(F.lit(1)))
    got = {(r.symbol, r.bar_idx): r.m for r in S.with_ewm(df, {"m": ("x", 0.5)}).collect()}
    assert got == {("A", 0): None, ("A", 1): 1.0, ("A", 2): 2.0, ("A", 3): 2.0, ("B", 0): 5.0}


def test_equity_curves(spark):
    done = L.ledger(L.signals(B.synthetic_bars(spark, 30), [G.MACrossover(2, 5), G.BuyAndHold()]), E.RUN)
    got = E.equity_curves(done, "BuyAndHold")
    assert got.count() == 60 and got.where("strategy = 'BuyAndHold' and equity <> benchmark").count() == 0
