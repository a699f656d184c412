"""Worked examples and properties of the bar engine."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import clean, evaluate as E, ledger as L, strategies as G, validate as V
from tidemark.plans.queries import QUERIES
from tidemark.sources import bars as B
from tidemark.streaming import live


def flat(spark, close, signal=None, symbol="A"):
    rows = [(symbol, i, float(c), float(signal[i]) if signal else 0.0) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, close double, signal double")
    return df.withColumn("timestamp", F.expr("timestamp_ntz'2022-01-01' + make_dt_interval(cast(bar_idx as int))"))


def column(df, c):
    return [None if r[0] is None else round(r[0], 6) for r in df.orderBy("bar_idx").select(c).collect()]


class Given(G.Strategy):
    name = "Given"

    def add(self, df, out="signal", keys=S.KEYS):
        return df


@pytest.mark.parametrize(("strategy", "close", "want"), [
    (G.MACrossover(2, 3), [10, 10, 10, 12, 14, 16, 10, 8, 6, 4], [0, 0, 0, 1, 1, 1, 0, 0, 0, 0]),
    (G.RSIMeanReversion(3, 30, 70), [100, 99, 98, 97, 96, 97, 98, 99, 100, 101, 102, 101, 100, 99], [0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]),
    (G.DonchianBreakout(3, 2), [10, 11, 9, 12, 8, 13, 7, 14, 6, 15], [0, 0, 0, 1, 0, 1, 0, 1, 0, 1]),
    (G.TSMOM(2), [10, 12, 9, 15, 8, 20], [0, 0, 0, 1, 0, 1]),
])
def test_signals(spark, strategy, close, want):
    assert column(strategy.add(flat(spark, close)), "signal") == want


def test_filter_and_nesting(spark):
    up = flat(spark, range(10, 40))
    got = column(G.RSIFilter(G.BuyAndHold()).add(up), "signal")
    assert got == [1.0] * 14 + [0.0] * 16
    nested = G.Voting([G.RSIFilter(G.MACrossover(2, 3)), G.RSIFilter(G.BuyAndHold()), G.RSIMeanReversion(14)], 1)
    assert set(nested.add(up).columns) == {*up.columns}


def test_parameters():
    for bad in (lambda: G.MACrossover(5, 5), lambda: G.RSIMeanReversion(14, 50, 50), lambda: G.Voting([G.BuyAndHold()], 2), lambda: G.SoftVoting([G.BuyAndHold()], [1, 2])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        G.build("no such")
    assert G.sharpe_weights([0.25, -0.5, 0.75]) == [0.25, 0, 0.75] and G.sharpe_weights([-1, -2]) is None
    assert V.fold_count(730, 365, 90) == 4


@pytest.mark.parametrize(("close", "signal", "fee", "capital", "bps", "hold", "want"), [
    ([100, 110, 90, 130], [0, 1, 0, 0], 0, 100, 0, 0, {"position": [0, 0, 1, 0]}),
    ([100] * 4, [1, 0, 0, 0], 0.001, 1000, 0, 0, {"position": [0, 1, 0, 0], "equity": [1000, 999, 998.001, 998.001]}),
    ([100, 120, 90], [1, 0, 1], 0.01, 1000, 0, 0, {"gross_return": [0, 0.2, 0], "equity": [1000, 1190, 1178.1], "units": [0, 10, 0], "cash": [1000, -10, 1178.1]}),
    ([100, 120, 90], [1, 0, 1], 0.01, 1000, 100, 0, {"equity": [1000, 1180, 1156.4]}),
    ([100] * 7, [0, 1, 0, 1, 0, 1, 0], 0, 100, 0, 3, {"position": [0, 0, 0, 0, 1, 1, 1]}),
    ([100] * 7, [0, 1, 0, 1, 0, 1, 0], 0, 100, 0, 0, {"position": [0, 0, 1, 0, 1, 0, 1]}),
    ([100] * 3, [0.6] * 3, 0.001, 1000, 5, 0, {"position": [0, 0.6, 0.6], "fee_drag": [0, 0.0006, 0]}),
])
def test_ledger(spark, close, signal, fee, capital, bps, hold, want):
    got = L.ledger(flat(spark, close, signal), fee=fee, capital=float(capital), slippage_bps=bps, min_holding=hold).cache()
    for c, values in want.items():
        assert column(got, c) == pytest.approx(values)
    assert got.where("abs(cash + units * close - equity) > 1e-9").count() == 0


def test_trades(spark):
    done = L.ledger(flat(spark, [100, 110, 90, 130, 120, 140], [1, 1, 0, 0, 0, 0])).withColumn("strategy", F.lit("x"))
    t = E.trades(done).collect()
    assert [(r.entry_idx, r.exit_idx, r.entry_price, r.exit_price, r.holding_bars) for r in t] == [(1, 2, 100, 90, 2)]
    always = L.ledger(flat(spark, [100, 110, 90], [1, 1, 1])).withColumn("strategy", F.lit("x"))
    s = E.trade_summary(E.trades(always), always).first()
    assert s.num_trades == 0 and s.win_rate is None and s.total_pnl_dollars == 0


def test_metrics(spark):
    df = flat(spark, [1] * 4).withColumn("equity", F.element_at(F.array(*map(F.lit, [100.0, 120.0, 90.0, 100.0])), F.col("bar_idx").cast("int") + 1)).withColumn("strategy_return", F.lit(0.01)).withColumn("turnover", F.lit(0.0)).withColumn("strategy", F.lit("x"))
    m = E.summary(df).first()
    assert m.max_drawdown == pytest.approx(-0.25) and m.sharpe is None and m.total_return == pytest.approx(0)


def test_gap_fill(spark):
    days = [1, 2, 3, 4, 10, 11, 12, 13, 14]
    rows = [("A", f"2022-01-{d:02d}", float(d)) for d in days] + [("A", "2022-01-11 12:00:00", 99.0)]
    df = spark.createDataFrame(rows, "symbol string, t string, close double").select("symbol", F.col("t").cast("timestamp_ntz").alias("timestamp"), *[F.col("close").alias(c) for c in B.PRICES])
    got = {str(r.timestamp)[:10]: r.close for r in clean.fill_gaps(df).collect()}
    assert len(got) == 12 and [got[f"2022-01-{d:02d}"] for d in (5, 6, 7)] == [4.0] * 3 and "2022-01-08" not in got


def test_no_lookahead(spark):
    close = [10, 11, 12, 11, 10, 9, 10, 11, 12, 13]
    whole, part = flat(spark, close), flat(spark, close[:6])
    means = lambda df: column(S.with_ewm(df, {"x": ("close", 0.5)}), "x")
    assert means(whole)[:6] == means(part)
    for f in (lambda w: S.rolling(F.avg, "close", 3, w), lambda w: S.change("close", w)):
        assert column(whole.withColumn("x", f(S.by())), "x")[:6] == column(part.withColumn("x", f(S.by())), "x")


def test_bootstrap(spark):
    done = L.ledger(flat(spark, [100 + i % 7 for i in range(40)], [1] * 40)).withColumn("strategy", F.lit("x")).cache()
    whole = V.trial_stats(V.bootstrap(done, 5, block=40))
    assert len({round(r.sharpe, 9) for r in whole.collect()}) == 1  # one block of all bars repeats history
    one = V.bootstrap_index(spark.createDataFrame([("x", 9)], "k string, n long"), 3, 1)
    assert one.count() == 27 and one.where("idx < 0 or idx > 8").count() == 0


def test_bootstrap_paths(spark):
    """Every step takes the return of the bar that its draw names, a null one too, and the last block is cut at the run's length."""
    runs = {("A", "x"): 23, ("A", "y"): 23, ("B", "x"): 7, ("C", "x"): 2}
    back = {(*k, i): None if i == 5 else (i * 37 % 11 - 5) / 100 for k, n in runs.items() for i in range(n)}
    rows = [(*k, 50.0 + k[2], r) for k, r in back.items()]
    done = spark.createDataFrame(rows, "symbol string, strategy string, bar_idx long, equity double, strategy_return double")
    index = V.bootstrap_index(spark.createDataFrame([(*k, n) for k, n in runs.items()], "symbol string, strategy string, n long"), 3, 4)
    want = {}
    for r in index.orderBy("symbol", "strategy", "trial", "step").collect():
        x, before = back[r.symbol, r.strategy, r.idx], want.get((r.symbol, r.strategy, r.trial, r.step - 1), (0, 0, 50.0))[2]
        want[r.symbol, r.strategy, r.trial, r.step] = (r.idx, x, before * (1 + (x or 0.0)))
    found = V.bootstrap(done, 3, 4).collect()
    got = {(r.symbol, r.strategy, r.trial, r.step): (r.idx, r.strategy_return, r.equity) for r in found}
    assert len(found) == len(got) == len(want) == 3 * (23 + 23 + 7) and {r.start for r in found} == {50.0}
    assert all(got[k][:2] == v[:2] and abs(got[k][2] - v[2]) < 1e-9 for k, v in want.items())


def test_drawdowns_broadcast_nothing(spark):
    """A broadcast table takes 64 MB of the driver, however few its rows: three were too many for its 750 MB."""
    df = QUERIES["mc_ensemble_drawdowns"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_live(spark, tmp_path):
    assert [live.timeframe_seconds(c) for c in ("1m", "5m", "1h", "4h", "1d", "1w")] == [60, 300, 3600, 14400, 86400, 604800]
    with pytest.raises(ValueError):
        live.timeframe_seconds("1x")
    waits = []
    assert live.with_retry(lambda: 1 / 0, sleep=waits.append) is None and waits == [2, 4, 8, 16]
    closes = flat(spark, [90, 90, 90, 110, 110, 130, 90, 90])
    bars = closes.select("symbol", "timestamp", "bar_idx", *[F.col("close").alias(c) for c in B.PRICES])
    seen = bars.where("bar_idx < 3")
    assert sorted(r.bar_idx for r in live.new_bars(bars, seen).collect()) == [3, 4, 5, 6]
    src = str(tmp_path / "in")
    bars.where("bar_idx < 5").drop("bar_idx").coalesce(1).write.parquet(src)
    strategy = G.MACrossover(1, 2)

    def run():
        live.run_stream(spark.readStream.schema(bars.drop("bar_idx").schema).parquet(src), strategy, str(tmp_path / "h"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()

    run()
    bars.where("bar_idx >= 3").drop("bar_idx").coalesce(1).write.mode("append").parquet(src)
    run()
    out = spark.read.parquet(str(tmp_path / "o")).orderBy("poll").collect()
    batch = L.ledger(strategy.add(B.indexed(bars.where("bar_idx < 7").drop("bar_idx")))).orderBy(F.desc("bar_idx")).first()
    assert len(out) == 2 and out[-1].equity == pytest.approx(batch.equity) and out[-1].position == batch.position


def test_log(spark, tmp_path):
    path = str(tmp_path / "x" / "log.jsonl")
    B.append_jsonl(path, {"type": "session_start", "symbol": "A", "strategy_params": json.dumps({"fast": 2})})
    B.append_jsonl(path, {"type": "decision", "bar_timestamp": "2022-01-02T00:00:00", "equity": 2.0})
    B.append_jsonl(path, {"type": "decision", "bar_timestamp": "2022-01-01T00:00:00", "equity": 1.0})
    header, found = B.read_log(spark, path)
    assert header["strategy_params"] == {"fast": 2} and [r.equity for r in found.collect()] == [1.0, 2.0]


def test_sources(spark):
    df = B.synthetic_bars(spark, 50)
    assert df.collect() == B.synthetic_bars(spark, 50).repartition(3).orderBy("bar_idx").collect()
    assert df.where("high < greatest(open, close) or low > least(open, close) or volume < 100 or volume > 1000").count() == 0
    with pytest.raises(ValueError):
        B.validate(df.drop("open"))
    with pytest.raises(TypeError):
        B.validate(df.withColumn("timestamp", F.lit("x")))
    assert B.file_name("MACrossover(5,20)") == "MACrossover_5_20_trades.csv"
    assert "1.0000" in B.text_table(["a"], [(1.0,)], "t")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
