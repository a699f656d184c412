"""Every query of the bar engine by name, over whole tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import clean, evaluate as E, ledger as L, strategies as G, validate as V
from tidemark.plans import oracle as O
from tidemark.sources import bars as B
from tidemark.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FAST, SLOW, LOOK, TRAIN, TEST, TRIALS, NOISY, SHOWN, COMPARED, BLOCK, SIGMA = 5, 20, 24, 200, 60, 2000, 2000, 20, 500, 20, 0.001
TRIO = (G.MACrossover(FAST, SLOW), G.TSMOM(LOOK), G.BuyAndHold())
CANDIDATES = (G.MACrossover(5, 20), G.MACrossover(10, 30), G.TSMOM(24))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.index_bars(ticks(spark, sf))


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at"


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query(O.query(
    O.BARS,
    select=f"SELECT symbol, {STAMP}, {O.r('open')} AS open, {O.r('high')} AS high, {O.r('low')} AS low, {O.r('close')} AS close, "
        f"{O.r('volume', 4)} AS volume FROM hb"))
def bars_hourly(spark, sf):
    df = stamped(B.tick_bars(ticks(spark, sf)).drop("mean"))
    prices = [(F.round(c, 6) + 0.0).alias(c) for c in ("open", "high", "low", "close")]
    return df.select("symbol", "at", *prices, (F.round("volume", 4) + 0.0).alias("volume"))


@query(O.query(
    O.BARS,
    select=f"SELECT symbol, {STAMP}, bar_idx, {O.r('open')} AS open, {O.r('high')} AS high, {O.r('low')} AS low, {O.r('close')} AS close FROM bars"))
def bars_index(spark, sf):
    return rounded(stamped(bars(spark, sf).drop("volume")))


@query(O.query(
    O.BARS,
    select=f"SELECT symbol, {STAMP}, event_id, {O.r('value')} AS value FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER "
        f"BY event_id) = 1"))
def clean_dedupe(spark, sf):
    df = ticks(spark, sf).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts")).alias("timestamp"), "event_id", "value")
    return rounded(stamped(clean.dedupe(df, seq="event_id")))


GAPS = (
    "gp AS (SELECT symbol, timestamp, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY symbol ORDER BY timestamp) AS gap FROM "
    "hb), st AS (SELECT symbol, cast(floor(quantile_cont(gap, 0.5)) AS BIGINT) AS step_us FROM gp GROUP BY 1 HAVING count(*) >= 3)"
)


@query(O.query(O.BARS, GAPS, select="SELECT symbol, step_us FROM st"))
def clean_median_step(spark, sf):
    return clean.median_step(B.tick_bars(ticks(spark, sf)))


def _filled() -> str:
    cols = ("open", "high", "low", "close", "volume")
    last = ", ".join(f"last_value(hb.{c} IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.timestamp ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in cols)
    return O.query(
        O.BARS, GAPS,
        "gr AS (SELECT e.symbol, unnest(generate_series(e.a, e.b, to_microseconds(st.step_us))) AS timestamp FROM (SELECT symbol, "
        "min(timestamp) AS a, max(timestamp) AS b FROM hb GROUP BY 1) e JOIN st USING (symbol))",
        "lk AS (SELECT DISTINCT g.symbol FROM gr g LEFT JOIN hb USING (symbol, timestamp) WHERE hb.symbol IS NULL)",
        f"fl AS (SELECT g.symbol, g.timestamp, {last} FROM (SELECT * FROM gr WHERE symbol IN (SELECT symbol FROM lk)) g LEFT JOIN hb "
        f"USING (symbol, timestamp))",
        f"al AS (SELECT * FROM fl WHERE open IS NOT NULL UNION ALL SELECT symbol, timestamp, {', '.join(cols)} FROM hb WHERE symbol NOT "
        f"IN (SELECT symbol FROM lk))",
        select=f"SELECT symbol, {STAMP}, {', '.join(f'{O.r(c, 4)} AS {c}' for c in cols)} FROM al")


@query(_filled())
def clean_gap_fill(spark, sf):
    return rounded(stamped(clean.fill_gaps(B.tick_bars(ticks(spark, sf)).drop("mean"))), 4)


def _feature(name: str, expression, sql: str, n: int = 6):
    def f(spark, sf):
        return rounded(bars(spark, sf).select("symbol", "bar_idx", expression(S.by()).alias("value")), n)

    f.__name__ = name
    query(O.query(O.BARS, select=f"SELECT symbol, bar_idx, {O.r(sql, n)} AS value FROM bars"))(f)


_feature("feat_sma", lambda w: S.rolling(F.avg, "close", 20, w), O.rolling("avg", 20))


@query(O.query(O.BARS, select=f"SELECT symbol, bar_idx, {O.r(O.ewm('close', 2 / 21))} AS value FROM bars"))
def feat_ema(spark, sf):
    return rounded(S.with_ewm(bars(spark, sf), {"value": ("close", 2 / 21)}).select("symbol", "bar_idx", "value"))


_feature("feat_returns", lambda w: S.change("close", w), f"close / lag(close) {O.over('symbol')} - 1", 9)
_feature("feat_rolling_max", lambda w: S.rolling(F.max, "close", 20, w), O.rolling("max", 20))
_feature("feat_rolling_min", lambda w: S.rolling(F.min, "close", 20, w), O.rolling("min", 20))


@query(O.query(
    O.BARS, f"rt AS (SELECT *, close / lag(close) {O.over('symbol')} - 1 AS ret FROM bars)",
    select=f"SELECT symbol, bar_idx, {O.r(O.rolling('stddev_samp', 20, c='ret'), 9)} AS value FROM rt"))
def feat_volatility(spark, sf):
    df = bars(spark, sf).withColumn("ret", S.change("close", S.by()))
    return rounded(df.select("symbol", "bar_idx", S.rolling(F.stddev_samp, "ret", 20, S.by()).alias("value")), 9)


@query(O.query(O.BARS, O.rsi("bars", 14, "rs"), select=f"SELECT symbol, bar_idx, {O.r('rsi')} AS value FROM rs"))
def feat_rsi(spark, sf):
    return rounded(S.with_rsi(bars(spark, sf), 14, "value").select("symbol", "bar_idx", "value"))


RSI_MR = O.hold("rsi < 30", "rsi > 50")
_MA = O.ma(FAST, SLOW)
_SIGNALS = {
    "sig_buy_hold": (G.BuyAndHold(), (), "1.0", "bars"),
    "sig_ma_cross": (G.MACrossover(FAST, SLOW), (), _MA, "bars"),
    "sig_tsmom": (G.TSMOM(LOOK), (), O.tsmom(LOOK), "bars"),
    "sig_rsi_mr": (G.RSIMeanReversion(14, 30, 50), (O.rsi("bars", 14, "rs"),), RSI_MR, "rs"),
    "sig_donchian": (G.DonchianBreakout(20, 10), (O.donchian("bars", 20, 10, "dc"),), "donchian", "dc"),
    "sig_rsi_filter": (
        G.RSIFilter(G.MACrossover(FAST, SLOW), 14, 70), (O.rsi("bars", 14, "rs"), f"mm AS (SELECT *, {_MA} AS s FROM rs)"),
        "CASE WHEN rsi > 70 THEN 0.0 ELSE s END", "mm"),
    "sig_vote_hard": (
        G.Voting([G.MACrossover(FAST, SLOW), G.TSMOM(LOOK), G.DonchianBreakout(20, 10)], 2), (O.donchian("bars", 20, 10, "dc"),),
        f"CASE WHEN {_MA} + {O.tsmom(LOOK)} + donchian >= 2 THEN 1.0 ELSE 0.0 END", "dc"),
    "sig_vote_soft": (
        G.SoftVoting([G.MACrossover(FAST, SLOW), G.TSMOM(LOOK), G.BuyAndHold()], [1, 2, 1]), (), f"({_MA} + 2 * {O.tsmom(LOOK)} + 1.0) / 4",
        "bars"),
}


def _signal(name: str, strategy, ctes, sql: str, src: str):
    def f(spark, sf):
        return rounded(strategy.add(bars(spark, sf)).select("symbol", "bar_idx", "signal"))

    f.__name__ = name
    query(O.query(O.BARS, *ctes, select=f"SELECT symbol, bar_idx, {O.r(f'({sql})::DOUBLE')} AS signal FROM {src}"))(f)


_HARD = (
    O.rsi("bars", 14, "rs"), f"mm AS (SELECT * EXCLUDE (rsi), CASE WHEN rsi > 70 THEN 0.0 ELSE {O.ma(20, 50)} END AS s1 FROM rs)",
    O.rsi("mm", 10, "rt"), f"mr AS (SELECT * EXCLUDE (rsi), {O.hold('rsi < 20', 'rsi > 50')} AS s2 FROM rt)", O.donchian("mr", 20, 10, "dd"),
)
_SIGNALS["sig_hard_ensemble"] = (G.hard_voting(), _HARD, "CASE WHEN s1 + s2 + donchian >= 2 THEN 1.0 ELSE 0.0 END", "dd")
_SIGNALS["sig_soft_ensemble"] = (
    G.build("soft_voting_ensemble", rsi_window=10, buy_below=20, member_sharpes=[0.25, -0.5, 0.75]), _HARD,
    f"0.25 * {O.ma(20, 50)} + 0.75 * donchian", "dd")

for _name, _parts in _SIGNALS.items():
    _signal(_name, *_parts)

MA_LEDGER = (O.BARS, f"sg AS (SELECT symbol, bar_idx, timestamp, close, {_MA} AS signal FROM bars)", O.ledger("sg", "lg", "symbol"))
_TRIO = " UNION ALL ".join(
    f"SELECT symbol, bar_idx, timestamp, close, '{s.name}' AS strategy, {sql} AS signal FROM bars" for s,
    sql in zip(TRIO, (_MA, O.tsmom(LOOK), "1.0"), strict=True))
TRIO_LEDGER = (O.BARS, f"sg AS ({_TRIO})", O.ledger("sg", "lg", "symbol, strategy"))
RUN = "symbol, strategy"


def one_ledger(spark, sf, **more) -> DataFrame:
    return L.ledger(TRIO[0].add(bars(spark, sf)), **more)


def trio_ledger(spark, sf) -> DataFrame:
    return L.ledger(L.signals(bars(spark, sf), TRIO), E.RUN)


_LEDGER = ("position", "asset_return", "turnover", "gross_return", "fee_drag", "slippage_drag", "strategy_return", "equity", "units", "cash")


@query(O.query(*MA_LEDGER, select=f"SELECT symbol, bar_idx, {', '.join(f'{O.r(c)} AS {c}' for c in _LEDGER)} FROM lg"))
def bt_ledger(spark, sf):
    return rounded(one_ledger(spark, sf).select("symbol", "bar_idx", *_LEDGER))


@query(O.query(
    *MA_LEDGER,
    select=f"SELECT symbol, count(*) FILTER (WHERE turnover > 0) AS trade_count, {O.r('sum(turnover)')} AS turnover, {O.r('sum(fee_drag)')} AS "
        f"fees, {O.r('max(abs(cash + units * close - equity))', 4)} AS worst FROM lg GROUP BY 1"))
def bt_turnover(spark, sf):
    df = one_ledger(
        spark, sf).groupBy("symbol").agg(F.count_if(F.col("turnover") > 0).alias("trade_count"), F.sum("turnover").alias("turnover"),
        F.sum("fee_drag").alias("fees"),
        F.round(F.max(F.abs(F.col("cash") + F.col("units") * F.col("close") - F.col("equity"))), 4).alias("worst"))
    return rounded(df)


def _held(src: str, least: int, keys: str = "symbol") -> str:
    on = " AND ".join(f"p.{k} = h.{k}" for k in keys.split(", "))
    return f"""hp AS (SELECT *, coalesce(lag(signal) {O.over(keys)}, 0.0) AS raw FROM {src}),
hr AS (SELECT {keys}, bar_idx, raw AS position, 0::BIGINT AS at FROM hp WHERE bar_idx = 0
UNION ALL SELECT {', '.join('p.' + k for k in keys.split(', '))}, p.bar_idx, CASE WHEN p.raw <> h.position AND p.bar_idx - h.at >= {least} THEN p.raw ELSE h.position END, CASE WHEN p.raw <> h.position AND p.bar_idx - h.at >= {least} THEN p.bar_idx ELSE h.at END FROM hr h JOIN hp p ON {on} AND p.bar_idx = h.bar_idx + 1),
hh AS (SELECT hp.* EXCLUDE (raw), hr.position FROM hp JOIN hr USING ({keys}, bar_idx))"""


HELD = (O.BARS, MA_LEDGER[1], _held("sg", 12), O.ledger("sg", "lg", "symbol", positions="hh"))


@query(O.query(*HELD, select=f"SELECT symbol, bar_idx, {O.r('position')} AS position, {O.r('equity')} AS equity FROM lg", recursive=True))
def bt_min_hold(spark, sf):
    return rounded(one_ledger(spark, sf, min_holding=12).select("symbol", "bar_idx", "position", "equity"))


@query(O.query(*TRIO_LEDGER, select=f"SELECT symbol, strategy, bar_idx, {O.r('drawdown')} AS drawdown FROM lg"))
def m_drawdown(spark, sf):
    return rounded(E.drawdown(trio_ledger(spark, sf)).select("symbol", "strategy", "bar_idx", "drawdown"))


@query(O.query(*TRIO_LEDGER, select=O.summary("lg", RUN)))
def m_summary(spark, sf):
    return rounded(E.summary(trio_ledger(spark, sf)))


@query(O.query(
    *TRIO_LEDGER,
    select=f"SELECT a.symbol, a.strategy AS strategy_a, b.strategy AS strategy_b, "
        f"{O.r('covar_pop(a.strategy_return, b.strategy_return) / nullif(stddev_pop(a.strategy_return) * stddev_pop(b.strategy_return), 0)')} "
        f"AS corr FROM lg a JOIN lg b USING (symbol, bar_idx) GROUP BY 1, 2, 3"))
def m_correlation(spark, sf):
    return rounded(E.correlation(trio_ledger(spark, sf)))


@query(O.query(
    *TRIO_LEDGER,
    select=f"SELECT symbol, strategy, {O.r('product(1 + gross_return) - 1')} AS gross, {O.r('sum(fee_drag)')} AS fees, "
        f"{O.r('sum(slippage_drag)')} AS slippage, {O.r('product(1 + strategy_return) - 1')} AS net FROM lg GROUP BY 1, 2"))
def m_cost_impact(spark, sf):
    return rounded(E.cost_impact(trio_ledger(spark, sf)))


@query(O.query(
    *TRIO_LEDGER, f"sm AS ({O.summary('lg', RUN)})",
    select="SELECT symbol, strategy, sharpe FROM sm ORDER BY sharpe DESC NULLS LAST, symbol, strategy LIMIT 1"))
def m_best_run(spark, sf):
    return V.best_run(rounded(E.summary(trio_ledger(spark, sf))).select("symbol", "strategy", "sharpe"))


_TW = O.over(RUN)
TRADES = (
    f"tq AS (SELECT *, position <> 0 AS i, coalesce(lag(position <> 0) {_TW}, false) AS was, lag(close) {_TW} AS price, lag(timestamp) "
    f"{_TW} AS ts_before, lag(equity) {_TW} AS before FROM lg)",
    f"ti AS (SELECT *, sum(CASE WHEN i AND NOT was THEN 1 ELSE 0 END) {_TW} AS trade_id FROM tq)",
    "tr AS (SELECT symbol, strategy, trade_id::BIGINT AS trade_id, max(bar_idx) FILTER (i AND NOT was) AS entry_idx, max(bar_idx) FILTER "
    "(was AND NOT i) AS x, max(price) FILTER (i AND NOT was) AS entry_price, max(price) FILTER (was AND NOT i) AS exit_price, "
    "max(before) FILTER (i AND NOT was) AS e0, max(equity) FILTER (was AND NOT i) AS e1, max(timestamp) FILTER (i AND NOT was) AS t0, "
    "max(ts_before) FILTER (was AND NOT i) AS t1, sum(fee_drag) AS fees_paid, sum(slippage_drag) AS slippage_paid FROM ti WHERE i OR was "
    "GROUP BY 1, 2, 3 HAVING count(*) FILTER (was AND NOT i) > 0)",
)


@query(O.query(
    *TRIO_LEDGER, *TRADES,
    select=f"SELECT symbol, strategy, trade_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS entry_time, strftime(t1, '%Y-%m-%d %H:%M:%S') AS exit_time, "
        f"entry_idx, x - 1 AS exit_idx, {O.r('entry_price')} AS entry_price, {O.r('exit_price')} AS exit_price, x - entry_idx AS "
        f"holding_bars, {O.r('e1 - e0')} AS pnl_dollars, {O.r('(e1 - e0) / e0')} AS pnl_pct, {O.r('fees_paid')} AS fees_paid, "
        f"{O.r('slippage_paid')} AS slippage_paid FROM tr"))
def trades_extract(spark, sf):
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("entry_time", "exit_time")}
    return rounded(E.trades(trio_ledger(spark, sf)).withColumns(times))


_P = "(e1 - e0)"


@query(O.query(*TRIO_LEDGER, *TRADES, select=f"""SELECT u.symbol, u.strategy, count(x) AS num_trades, {O.r(f'avg(CASE WHEN x IS NULL THEN NULL WHEN {_P} > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {O.r(f'avg(CASE WHEN {_P} > 0 THEN {_P} END)')} AS avg_win, {O.r(f'avg(CASE WHEN {_P} <= 0 THEN {_P} END)')} AS avg_loss,
{O.r(f"CASE WHEN sum(CASE WHEN {_P} <= 0 THEN -{_P} END) > 0 THEN coalesce(sum(CASE WHEN {_P} > 0 THEN {_P} END), 0) / sum(CASE WHEN {_P} <= 0 THEN -{_P} END) WHEN sum(CASE WHEN {_P} > 0 THEN {_P} END) > 0 THEN 'inf'::DOUBLE END")} AS profit_factor,
{O.r(f'coalesce(sum({_P}), 0)')} AS total_pnl_dollars, {O.r('coalesce(sum(fees_paid), 0)')} AS total_fees_paid, {O.r('coalesce(sum(slippage_paid), 0)')} AS total_slippage_paid FROM (SELECT DISTINCT symbol, strategy FROM lg) u LEFT JOIN tr USING (symbol, strategy) GROUP BY 1, 2"""))
def trades_summary(spark, sf):
    done = trio_ledger(spark, sf)
    return rounded(E.trade_summary(E.trades(done), done))


FOLDS = (
    f"nn AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), fo AS (SELECT symbol, fold::INT AS fold, fold * {TEST} AS train_start, fold * "
    f"{TEST} + {TRAIN} AS train_end, fold * {TEST} + {TRAIN} AS test_start, fold * {TEST} + {TRAIN + TEST} AS test_end FROM (SELECT symbol, "
    f"unnest(range(0, (n - {TRAIN}) // {TEST})) AS fold FROM nn WHERE n >= {TRAIN + TEST}))"
)


@query(O.query(O.BARS, FOLDS, select="SELECT symbol, fold, train_start, train_end, test_start, test_end FROM fo"))
def wf_folds(spark, sf):
    return V.folds(bars(spark, sf), TRAIN, TEST)


def _fold_runs(role: str, out: str) -> tuple[str, ...]:
    k = "symbol, fold"
    each = " UNION ALL ".join(
        f"SELECT *, {i} AS param_id, '{c.name}' AS strategy, {sql} AS signal FROM {out}_b" for i,
        (c, sql) in enumerate(zip(CANDIDATES, (O.ma(5, 20, k), O.ma(10, 30, k), O.tsmom(24, k)), strict=True)))
    return (
        f"{out}_b AS (SELECT b.symbol, f.fold, b.bar_idx AS global_idx, b.bar_idx - f.{role}_start AS bar_idx, b.close FROM bars b JOIN "
        f"fo f ON b.symbol = f.symbol AND b.bar_idx >= f.{role}_start AND b.bar_idx < f.{role}_end)",
        f"{out}_s AS ({each})", O.ledger(f"{out}_s", out, "symbol, fold, param_id"))


SELECT_CTE = (
    O.BARS, FOLDS, *_fold_runs("train", "tn"),
    f"sc AS (SELECT symbol, fold, param_id, strategy, {O.SHARPE} AS score FROM tn GROUP BY 1, 2, 3, 4)",
    "ch AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC NULLS LAST, param_id) = 1)")


@query(O.query(*SELECT_CTE, select=f"SELECT symbol, fold, param_id, strategy, {O.r('score')} AS score FROM ch"))
def wf_select(spark, sf):
    return rounded(V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)[0])


_SW = "OVER (PARTITION BY symbol ORDER BY global_idx)"
STITCH = (
    *_fold_runs("test", "te"),
    "jn AS (SELECT te.* EXCLUDE (equity, units, cash, drawdown, strategy), te.strategy AS chosen FROM te JOIN ch USING (symbol, fold, param_id))",
    f"je AS (SELECT *, 'WalkForward(' || first_value(chosen) {_SW} || ')' AS strategy, 10000.0 * product(1 + strategy_return) {_SW} AS equity FROM jn)",
    f"js AS (SELECT * EXCLUDE (bar_idx), row_number() {_SW} - 1 AS bar_idx, coalesce(position * coalesce(lag(equity) {_SW}, 10000.0) / "
    f"lag(close) {_SW}, 0) AS units,"
    f" coalesce(lag(equity) {_SW}, 10000.0) * (1 - position - fee_drag - slippage_drag) AS cash, equity / max(equity) {_SW} - 1 AS drawdown FROM je)",
)
_STITCHED_COLUMNS = ", ".join(f"{O.r(c)} AS {c}" for c in ("position", "equity", "units", "cash"))


@query(O.query(
    *SELECT_CTE, *STITCH,
    select=f"SELECT symbol, fold, strategy, chosen, global_idx, bar_idx, {O.r('strategy_return', 9)} AS strategy_return, {_STITCHED_COLUMNS} "
        f"FROM js"))
def wf_stitch(spark, sf):
    df = V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)[1]
    money = [(F.round(c, 6) + 0.0).alias(c) for c in ("position", "equity", "units", "cash")]
    return df.select("symbol", "fold", "strategy", "chosen", "global_idx", "bar_idx", (F.round("strategy_return", 9) + 0.0).alias("strategy_return"), *money)


@query(O.query(
    *SELECT_CTE, *STITCH,
    select=f"SELECT symbol, strategy, count(*) FILTER (WHERE turnover > 0) AS trade_count, {O.r('max(abs(cash + units * close - equity))', 4)} "
        f"AS worst FROM js GROUP BY 1, 2"))
def wf_stitched_trades(spark, sf):
    df = V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)[1]
    off = F.max(F.abs(F.col("cash") + F.col("units") * F.col("close") - F.col("equity")))
    return rounded(df.groupBy("symbol", "strategy").agg(F.count_if(F.col("turnover") > 0).alias("trade_count"), F.round(off, 4).alias("worst")))


_FR = "fr AS (SELECT *, product(1 + strategy_return) OVER (PARTITION BY symbol, fold ORDER BY global_idx) AS own FROM js)"


@query(O.query(
    *SELECT_CTE, *STITCH, _FR,
    f"fs AS (SELECT symbol, fold, param_id, chosen AS strategy, {O.SHARPE} AS sharpe, arg_max(own, global_idx) / arg_min(own, global_idx) "
    f"- 1 AS total_return FROM fr GROUP BY 1, 2, 3, 4)",
    select=f"SELECT symbol, fold, fs.strategy, {O.r('sharpe')} AS sharpe, {O.r('total_return')} AS total_return, {O.r('score')} AS train_score "
        f"FROM fs JOIN ch USING (symbol, fold)"))
def wf_fold_report(spark, sf):
    return rounded(V.fold_report(*V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)))


_EXPANDING = FOLDS.replace(f"fold * {TEST} AS train_start", "0 AS train_start")


@query(O.query(
    O.BARS, _EXPANDING, *_fold_runs("train", "tn"), SELECT_CTE[-2], SELECT_CTE[-1],
    select=f"SELECT symbol, fold, param_id, strategy, {O.r('score')} AS score FROM ch"))
def wf_expanding(spark, sf):
    return rounded(V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST, expanding=True)[0])


@query(O.query(
    *SELECT_CTE, "ct AS (SELECT symbol, param_id, strategy, count(*) AS times, min(fold) AS first FROM ch GROUP BY 1, 2, 3)",
    "cu AS (SELECT *, sum(times) OVER (PARTITION BY symbol)::BIGINT AS folds FROM ct)",
    select="SELECT symbol, param_id, strategy, times, folds, times * 2 > folds AS stable FROM cu QUALIFY row_number() OVER (PARTITION BY symbol "
        "ORDER BY times DESC, first) = 1"))
def wf_stability(spark, sf):
    return V.stability(V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)[0])


GRID = {"fast": (5, 10, 20), "slow": (10, 20, 30)}


@query("SELECT (row_number() OVER (ORDER BY f.i, s.j) - 1)::INT AS param_id, f.fast, s.slow FROM (VALUES (0, 5), (1, 10), (2, 20)) f(i, fast), "
    "(VALUES (0, 10), (1, 20), (2, 30)) s(j, slow) WHERE f.fast < s.slow")
def grid_expand(spark, sf):
    found = V.grid({}, GRID, lambda p: p["fast"] < p["slow"])
    return spark.createDataFrame([(k, p["fast"], p["slow"]) for k, p in enumerate(found)], "param_id int, fast int, slow int")


_PAIRS = [(f, s) for f in GRID["fast"] for s in GRID["slow"] if f < s]
_SWEPT = " UNION ALL ".join(
    f"SELECT symbol, bar_idx, close, {k} AS param_id, 'MACrossover({f},{s})' AS strategy, 0 AS min_holding, {O.ma(f, s)} AS signal FROM bars" for k,
    (f, s) in enumerate(_PAIRS))
_SK = "symbol, param_id, strategy, min_holding"


def _sweep_select(src: str) -> str:
    return (
        f"SELECT s.*, {O.r('c.cost_drag')} AS cost_drag FROM ({O.summary(src, _SK)}) s JOIN (SELECT {_SK}, sum(fee_drag) + sum(slippage_drag) "
        f"AS cost_drag FROM {src} GROUP BY {_SK}) c USING ({_SK})"
    )


@query(O.query(O.BARS, f"sg AS ({_SWEPT})", O.ledger("sg", "lg", _SK), select=_sweep_select("lg")))
def sweep_ma(spark, sf):
    return rounded(V.sweep(bars(spark, sf), [G.MACrossover(f, s) for f, s in _PAIRS]))


def _hold_sweep() -> str:
    ctes = [
        O.BARS,
        f"s0 AS (SELECT symbol, bar_idx, close, 0 AS param_id, '{TRIO[0].name}' AS strategy, unnest([0, 6, 24]) AS min_holding, signal "
        f"FROM (SELECT *, {_MA} AS signal FROM bars))"]
    k = "symbol, min_holding"
    held = _held("s0", 0, k).replace(">= 0", ">= h.min_holding")
    return O.query(*ctes, held, O.ledger("s0", "lg", _SK, positions="hh"), select=_sweep_select("lg"), recursive=True)


@query(_hold_sweep())
def sweep_min_hold(spark, sf):
    return rounded(V.sweep(bars(spark, sf), [TRIO[0]], (0, 6, 24)))


_B = f"cast(42 AS VARCHAR) || ':' || t || ':' || b"
INDEX = (
    f"rn AS (SELECT symbol, count(*) AS n, arg_min(equity, bar_idx) AS start FROM lg GROUP BY 1)",
    f"tb AS (SELECT symbol, n, start, t, b, floor({O.unit(_B)} * (n - {BLOCK} + 1))::BIGINT AS first FROM rn, range({TRIALS}) q(t), "
    f"range(1000000) p(b) WHERE n >= {BLOCK} AND b < ceil(n / {BLOCK}.0))".replace(
        "range(1000000) p(b)", "(SELECT unnest(range((SELECT ceil(max(n) / %d.0)::BIGINT FROM rn))) AS b) p" % BLOCK),
    f"ix AS (SELECT symbol, start, t::INT AS trial, b * {BLOCK} + o AS step, first + o AS idx FROM tb, range({BLOCK}) k(o) WHERE b * {BLOCK} + o < n)",
)


@query(O.query(
    *MA_LEDGER, *INDEX,
    select="SELECT symbol, trial, count(*) AS steps, sum(idx)::BIGINT AS total, min(idx) AS lo, max(idx) AS hi FROM ix GROUP BY 1, 2"))
def mc_block_index(spark, sf):
    n = bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return V.bootstrap_index(
        n, TRIALS, BLOCK).groupBy("symbol", "trial").agg(F.count("*").alias("steps"), F.sum("idx").alias("total"), F.min("idx").alias("lo"),
        F.max("idx").alias("hi"))


@query(O.query(
    *MA_LEDGER,
    *(x.replace(
        f"n - {BLOCK} + 1", "n").replace(f"n >= {BLOCK}", "n >= 1").replace(f"n / {BLOCK}.0", "n / 1.0").replace(f"max(n) / {BLOCK}.0",
        "max(n) / 1.0").replace(f"b * {BLOCK}", "b").replace(f"range({BLOCK})", "range(1)").replace(f"range({TRIALS})",
        "range(100)") for x in INDEX),
    select="SELECT symbol, trial, count(*) AS steps, sum(idx)::BIGINT AS total, min(idx) AS lo, max(idx) AS hi FROM ix GROUP BY 1, 2"))
def mc_iid_index(spark, sf):
    n = bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return V.bootstrap_index(
        n, 100, 1).groupBy("symbol", "trial").agg(F.count("*").alias("steps"), F.sum("idx").alias("total"), F.min("idx").alias("lo"),
        F.max("idx").alias("hi"))


MC = (
    *MA_LEDGER, *INDEX,
    "dr AS (SELECT ix.*, lg.strategy_return, ix.start * product(1 + lg.strategy_return) OVER (PARTITION BY ix.symbol, trial ORDER BY "
    "step) AS equity FROM ix JOIN lg ON ix.symbol = lg.symbol AND ix.idx = lg.bar_idx)",
    "dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, trial ORDER BY step) - 1 AS down FROM dr)",
    f"ts AS (SELECT symbol, trial, arg_max(equity, step) AS final_equity, min(down) AS max_drawdown, {O.SHARPE} AS sharpe, min(start) AS "
    f"start FROM dd GROUP BY 1, 2)",
)


def _trials(spark, sf) -> DataFrame:
    return V.trial_stats(V.bootstrap(one_ledger(spark, sf), TRIALS, BLOCK, keys=("symbol",)), ("symbol",))


@query(O.query(
    *MC,
    select=f"SELECT symbol, trial, {O.r('final_equity', 4)} AS final_equity, {O.r('max_drawdown')} AS max_drawdown, {O.r('sharpe')} AS sharpe "
        f"FROM ts"))
def mc_bootstrap(spark, sf):
    df = _trials(spark, sf)
    return df.select(
        "symbol", "trial", (F.round("final_equity", 4) + 0.0).alias("final_equity"),
        (F.round("max_drawdown", 6) + 0.0).alias("max_drawdown"), (F.round("sharpe", 6) + 0.0).alias("sharpe"))


_PC = ", ".join(f"{O.r(f'quantile_cont({c}, {q / 100})', 4)} AS {c}_p{q}" for c in ("final_equity", "max_drawdown", "sharpe") for q in (5, 25, 50, 75, 95))


@query(O.query(*MC, select=f"SELECT symbol, {_PC}, {O.r('avg(CASE WHEN final_equity < start THEN 1.0 ELSE 0.0 END)', 4)} AS prob_loss FROM ts GROUP BY 1"))
def mc_percentiles(spark, sf):
    return rounded(V.percentiles(_trials(spark, sf), ("symbol",)), 4)


@query(O.query(
    *MC, "en AS (SELECT min(final_equity) AS a, max(final_equity) AS b FROM ts)",
    select="SELECT coalesce(least(floor((final_equity - a) / nullif(b - a, 0) * 50), 49), 0)::INT AS bin, count(*) AS n FROM ts, en GROUP BY 1"))
def mc_hist(spark, sf):
    return E.histogram(_trials(spark, sf), "final_equity")


_RUNS = (
    INDEX[0].replace(
        "AS (SELECT symbol, count(*) AS n", "AS (SELECT symbol, strategy, count(*) AS n").replace("FROM lg GROUP BY 1)",
        "FROM {src} GROUP BY 1, 2)"),
    INDEX[1].replace("SELECT symbol, n,", "SELECT symbol, strategy, n,"), INDEX[2].replace("SELECT symbol, start,", "SELECT symbol, strategy, start,"),
    "dr AS (SELECT ix.*, l.strategy_return, ix.start * product(1 + l.strategy_return) OVER (PARTITION BY ix.symbol, ix.strategy, trial ORDER BY step) AS equity"
    " FROM ix JOIN {src} l ON ix.symbol = l.symbol AND ix.strategy = l.strategy AND ix.idx = l.bar_idx)",
    "dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, strategy, trial ORDER BY step) - 1 AS down FROM dr)",
    f"ts AS (SELECT symbol, strategy, trial, arg_max(equity, step) AS final_equity, min(down) AS max_drawdown, {O.SHARPE} AS sharpe, "
    f"min(start) AS start FROM dd GROUP BY 1, 2, 3)",
    f"ac AS (SELECT symbol, strategy, arg_max(equity, bar_idx) AS actual_final_equity, min(drawdown) AS actual_max_drawdown, {O.SHARPE} "
    f"AS actual_sharpe FROM {{src}} GROUP BY 1, 2)",
)
_DOWN = ", ".join(f"{O.r(f'quantile_cont(max_drawdown, {q / 100})', 4)} AS max_drawdown_p{q}" for q in (5, 25, 50, 75, 95))
_VOTED = f"SELECT symbol, bar_idx, timestamp, close, 'vote' AS strategy, CASE WHEN {_MA} + {O.tsmom(LOOK)} + 1.0 >= 2 THEN 1.0 ELSE 0.0 END AS signal FROM bars"


@query(O.query(
    O.BARS, f"sg AS ({_TRIO} UNION ALL {_VOTED})", O.ledger(
        "sg", "lg", RUN), *(x.replace("{src}", "lg").replace(f"range({TRIALS})", f"range({COMPARED})") for x in _RUNS),
    f"pc AS (SELECT symbol, strategy, {_DOWN} FROM ts GROUP BY 1, 2)",
    select=f"SELECT symbol, strategy, strategy = 'vote' AS is_ensemble, {O.r('actual_max_drawdown', 4)} AS actual_max_drawdown, pc.* EXCLUDE "
        f"(symbol, strategy) FROM pc JOIN ac USING (symbol, strategy)"))
def mc_ensemble_drawdowns(spark, sf):
    vote = G.Voting(TRIO, 2)
    done = L.ledger(L.signals(bars(spark, sf), (*TRIO, vote)), E.RUN)
    found = V.drawdown_comparison(done, vote.name, [s.name for s in TRIO], COMPARED, BLOCK)
    return rounded(found.withColumn("strategy", F.when(F.col("is_ensemble"), "vote").otherwise(F.col("strategy"))), 4)


@query(O.query(
    *TRIO_LEDGER, f"sm AS (SELECT symbol, strategy, {O.SHARPE} AS sharpe FROM lg GROUP BY 1, 2)",
    "bs AS (SELECT symbol, strategy FROM sm QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC NULLS LAST, strategy) = 1)",
    "lb AS (SELECT lg.* FROM lg JOIN bs USING (symbol, strategy))", *(x.replace("{src}", "lb") for x in _RUNS),
    f"pc AS (SELECT symbol, strategy, {_PC}, {O.r('avg(CASE WHEN final_equity < start THEN 1.0 ELSE 0.0 END)', 4)} AS prob_loss FROM ts GROUP BY 1, 2)",
    select=f"SELECT pc.*, {', '.join(f'{O.r(c, 4)} AS {c}' for c in ('actual_final_equity', 'actual_max_drawdown', 'actual_sharpe'))} FROM pc "
        f"JOIN ac USING (symbol, strategy)"))
def mc_best_run(spark, sf):
    return rounded(V.best_bootstrap(trio_ledger(spark, sf), TRIALS, BLOCK), 4)


@query(O.query(*MC, select=f"SELECT symbol, trial, step, {O.r('equity', 4)} AS equity FROM dd WHERE trial < 20"))
def mc_sample_paths(spark, sf):
    drawn = V.bootstrap(one_ledger(spark, sf), TRIALS, BLOCK, keys=("symbol",))
    return rounded(V.sample_paths(drawn, 20).select("symbol", "trial", "step", "equity"), 4)


_PT = "cast(42 AS VARCHAR) || ':' || t || ':' || symbol || ':' || bar_idx"
NOISE = (
    O.BARS,
    f"nb AS (SELECT symbol, t::INT AS trial, bar_idx, timestamp, open * f AS open, close * f AS close, volume FROM (SELECT *, 1 + {SIGMA} "
    f"* {O.normal(_PT)} AS f FROM bars, range({SHOWN}) q(t)))")


@query(O.query(*NOISE, select=f"SELECT symbol, trial, bar_idx, {O.r('open')} AS open, {O.r('close')} AS close, {O.r('volume', 4)} AS volume FROM nb"))
def mc_perturb(spark, sf):
    df = V.perturbed(bars(spark, sf), SHOWN, SIGMA)
    return df.select(
        "symbol", "trial", "bar_idx", (F.round("open", 6) + 0.0).alias("open"), (F.round("close", 6) + 0.0).alias("close"),
        (F.round("volume", 4) + 0.0).alias("volume"))


@query(O.query(
    O.BARS, NOISE[1].replace(f"range({SHOWN})", f"range({NOISY})"),
    f"sg AS (SELECT *, {O.ma(FAST, SLOW, 'symbol, trial')} AS signal FROM nb)", O.ledger("sg", "lg", "symbol, trial"),
    select=f"SELECT symbol, trial, {O.r('arg_max(equity, bar_idx)', 4)} AS final_equity FROM lg GROUP BY 1, 2"))
def mc_noise(spark, sf):
    return rounded(V.noise_robustness(bars(spark, sf), TRIO[0], NOISY, SIGMA), 4)


@query(O.query(
    O.BARS,
    select=f"SELECT symbol, bar_idx, {O.r('close')} AS close FROM bars WHERE bar_idx >= 100 AND bar_idx < (SELECT max(bar_idx) FROM bars b WHERE "
        f"b.symbol = bars.symbol)"))
def live_new_bars(spark, sf):
    df = bars(spark, sf)
    return rounded(live.new_bars(df.where("bar_idx >= 90"), df.where("bar_idx < 100")).select("symbol", "bar_idx", "close"))


@query(O.query(
    *MA_LEDGER,
    select=f"SELECT symbol, bar_idx, {O.r('close')} AS close, {O.r('position')} AS position, turnover > 0 AS is_trade, {O.r('equity')} AS "
        f"equity, {O.r('cash')} AS cash, {O.r('units')} AS units FROM lg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx "
        f"DESC) = 1"))
def live_decision(spark, sf):
    df = live.decisions(bars(spark, sf), TRIO[0])
    return rounded(df.select("symbol", "bar_idx", "close", "position", "is_trade", "equity", "cash", "units"))


DIFF = (
    *TRIO_LEDGER, f"la AS (SELECT symbol, timestamp, equity FROM lg WHERE strategy = '{TRIO[0].name}' AND bar_idx >= 50)", f"lb AS (SELECT symbol, timestamp, equity FROM lg WHERE strategy = '{TRIO[2].name}')",
    "lj AS (SELECT symbol, timestamp, la.equity AS live, lb.equity AS raw FROM la JOIN lb USING (symbol, timestamp))",
    "lk AS (SELECT symbol, timestamp, raw AS backtested, live * first_value(raw / live) OVER (PARTITION BY symbol ORDER BY timestamp) AS live FROM lj)",
)
_DIFF = (
    f"SELECT symbol, {STAMP}, {O.r('live')} AS live, {O.r('backtested')} AS backtested, {O.r('live - backtested')} AS abs_diff, "
    f"{O.r('(live - backtested) / backtested')} AS pct_diff FROM lk"
)


def _diff(spark, sf) -> DataFrame:
    done = trio_ledger(spark, sf)
    return live.equity_diff(done.where((F.col("strategy") == TRIO[0].name) & (F.col("bar_idx") >= 50)), done.where(F.col("strategy") == TRIO[2].name))


@query(O.query(*DIFF, select=_DIFF))
def live_diff(spark, sf):
    return rounded(stamped(_diff(spark, sf)))


@query(O.query(*DIFF, select=_DIFF + " ORDER BY round(abs((live - backtested) / backtested), 9) DESC, symbol, timestamp LIMIT 5"))
def live_worst5(spark, sf):
    return rounded(stamped(live.worst(_diff(spark, sf))))


@query(O.query(
    "sy AS (SELECT i AS bar_idx, CASE WHEN floor(i / 90) % 2 = 0 THEN 0.0015 ELSE -0.0015 END + 0.02 * " + O.normal("'42:c:' || i") + " AS x FROM range(730) q(i))",
    "sc AS (SELECT *, 100 * exp(sum(x) OVER (ORDER BY bar_idx)) AS close FROM sy)",
    "so AS (SELECT *, coalesce(lag(close) OVER (ORDER BY bar_idx), 100.0) AS open, abs(" + O.normal("'42:w:' || bar_idx") + ") * 0.02 / 2 AS wick FROM sc)",
    select=f"SELECT bar_idx, {O.r('open')} AS open, {O.r('greatest(open, close) * (1 + wick)')} AS high, "
        f"{O.r('least(open, close) * (1 - wick)')} AS low, {O.r('close')} AS close, "
        f"{O.r('100 + 900 * ' + O.unit(chr(39) + '42:v:' + chr(39) + ' || bar_idx'))} AS volume FROM so"))
def synthetic(spark, sf):
    return rounded(B.synthetic_bars(spark).select("bar_idx", "open", "high", "low", "close", "volume"))


@query(O.query(
    *MA_LEDGER, f"ch AS (SELECT *, position - coalesce(lag(position) {O.over('symbol')}, 0) AS change FROM lg)",
    select=f"SELECT symbol, bar_idx, {O.r('close')} AS close, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side FROM ch WHERE change <> 0"))
def plot_markers(spark, sf):
    return rounded(E.markers(one_ledger(spark, sf), ("symbol",)))


_VOTE = f"SELECT symbol, bar_idx, timestamp, close, 'vote' AS strategy, CASE WHEN {_MA} + {O.tsmom(LOOK)} + 1.0 >= 2 THEN 1.0 ELSE 0.0 END AS signal FROM bars"


@query(O.query(
    O.BARS, f"sg AS ({_TRIO} UNION ALL {_VOTE})", O.ledger("sg", "lg", RUN),
    "nt AS (SELECT symbol, strategy, count(*) FILTER (WHERE turnover > 0) AS t FROM lg GROUP BY 1, 2)",
    select="SELECT symbol, max(t) FILTER (strategy = 'vote') AS ensemble_trades, max(t) FILTER (strategy <> 'vote') AS most_of_members, max(t) "
        "FILTER (strategy = 'vote') > max(t) FILTER (strategy <> 'vote') AS trades_more FROM nt GROUP BY 1"))
def m_ensemble_turnover(spark, sf):
    vote = G.Voting(TRIO, 2)
    done = L.ledger(L.signals(bars(spark, sf), (*TRIO, vote)), E.RUN)
    return E.ensemble_turnover(E.summary(done), vote.name, [s.name for s in TRIO])


@query(O.query(
    *SELECT_CTE, *STITCH, *TRIO_LEDGER[1:],
    select=f"SELECT *, 'plain' AS mode FROM ({O.summary('lg', RUN)}) UNION ALL SELECT *, 'walk_forward' AS mode FROM ({O.summary('js', RUN)})"))
def m_by_mode(spark, sf):
    flat = V.walk_forward(bars(spark, sf), CANDIDATES, TRAIN, TEST)[1]
    return rounded(E.by_mode(plain=E.summary(trio_ledger(spark, sf)), walk_forward=E.summary(flat)))


@query(O.query(
    *TRIO_LEDGER,
    select=f"SELECT a.symbol, a.strategy, a.bar_idx, {O.r('a.equity')} AS equity, {O.r('b.equity')} AS benchmark FROM lg a JOIN lg b ON a.symbol "
        f"= b.symbol AND a.bar_idx = b.bar_idx AND b.strategy = 'BuyAndHold'"))
def plot_equity(spark, sf):
    return rounded(E.equity_curves(trio_ledger(spark, sf), "BuyAndHold"))


@query(O.query(
    O.BARS,
    select=f"SELECT symbol, bar_idx, {O.r('close + CASE WHEN bar_idx BETWEEN 90 AND 99 THEN 1 ELSE 0 END')} AS close FROM bars WHERE bar_idx < 200"))
def live_history(spark, sf):
    df = bars(spark, sf)
    revised = df.where("bar_idx >= 90 and bar_idx < 200").withColumn("close", F.col("close") + F.when(F.col("bar_idx") < 100, 1.0).otherwise(0.0))
    return rounded(live.merged(df.where("bar_idx < 100"), revised).select("symbol", "bar_idx", "close"))


_RAW = "rw AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp FROM events)"


@query(O.query(
    O.BARS, GAPS, _RAW, "dp AS (SELECT symbol, count(*) - count(DISTINCT timestamp) AS duplicates FROM rw GROUP BY 1)",
    "gr AS (SELECT e.symbol, unnest(generate_series(e.a, e.b, to_microseconds(st.step_us))) AS timestamp FROM (SELECT symbol, "
    "min(timestamp) AS a, max(timestamp) AS b FROM hb GROUP BY 1) e JOIN st USING (symbol))",
    "gp2 AS (SELECT g.symbol, g.timestamp, hb.symbol IS NULL AS lacks, count(hb.symbol) OVER (PARTITION BY g.symbol ORDER BY g.timestamp "
    "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM gr g LEFT JOIN hb USING (symbol, timestamp))",
    "gs AS (SELECT symbol, count(*) FILTER (lacks) AS missing, count(*) FILTER (lacks AND near > 0) AS filled, count(*) FILTER (lacks "
    "AND near = 0) AS dropped FROM gp2 GROUP BY 1)",
    select="SELECT symbol, duplicates, coalesce(missing, 0) AS missing, coalesce(filled, 0) AS filled, coalesce(dropped, 0) AS dropped FROM dp "
        "LEFT JOIN gs USING (symbol)"))
def clean_report(spark, sf):
    raw = ticks(spark, sf)
    stamps = raw.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("timestamp"))
    return clean.report(stamps, B.tick_bars(raw).drop("mean"))


@query(O.query(
    O.BARS,
    "fn AS (SELECT symbol, min(timestamp) AS b FROM bars WHERE bar_idx >= 100 AND bar_idx < (SELECT max(bar_idx) FROM bars x WHERE "
    "x.symbol = bars.symbol) GROUP BY 1)",
    "ls AS (SELECT symbol, max(timestamp) AS a FROM bars WHERE bar_idx < 95 GROUP BY 1)",
    select="SELECT symbol, strftime(a, '%Y-%m-%d %H:%M:%S') AS last_seen, strftime(b, '%Y-%m-%d %H:%M:%S') AS first_new, (epoch(b) - "
        "epoch(a))::BIGINT AS seconds FROM fn JOIN ls USING (symbol) WHERE epoch(b) - epoch(a) > 3600"))
def live_gaps(spark, sf):
    df = bars(spark, sf)
    seen = df.where("bar_idx < 95")
    found = live.gaps(live.new_bars(df.where("bar_idx >= 100"), seen), seen, live.timeframe_seconds("1h"))
    return found.select("symbol", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_seen", "first_new")], "seconds")
