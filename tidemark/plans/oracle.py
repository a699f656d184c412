"""DuckDB SQL that says the same as the queries, put together from common table expressions."""

from __future__ import annotations

import math

BARS = """ev AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, event_id, ts, value FROM events),
hb AS (SELECT symbol, timestamp, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, avg(value) AS mean FROM ev GROUP BY 1, 2),
zs AS (SELECT symbol, timestamp, volume, row_number() OVER w - 1 AS bar_idx, coalesce((mean - avg(mean) OVER a) / nullif(stddev_samp(mean) OVER a, 0), 0) AS z FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY timestamp), a AS (PARTITION BY symbol)),
px AS (SELECT *, 100 * exp(0.02 * sum(z) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS close FROM zs),
po AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx), 100.0) AS open FROM px),
bars AS (SELECT symbol, timestamp, bar_idx, open, greatest(open, close) * 1.005 AS high, least(open, close) * 0.995 AS low, close, volume FROM po)"""


def r(x: str, n: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {n}) + 0.0)"


def over(keys: str, back: int | None = None, last: int = 0, order: str = "bar_idx") -> str:
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"OVER (PARTITION BY {keys} ORDER BY {order}" + (f" ROWS BETWEEN {back} PRECEDING AND {end})" if back is not None else ")")


def rolling(fn: str, n: int, keys: str = "symbol", c: str = "close", last: int = 0) -> str:
    w = over(keys, n - 1 + last, last)
    return f"(CASE WHEN count({c}) {w} = {n} THEN {fn}({c}) {w} END)"


def ewm(c: str, alpha: float, keys: str = "symbol") -> str:
    back = max(1, math.ceil(math.log(1e-16) / math.log(1 - alpha)))
    return f"list_reduce(list({c}) FILTER (WHERE {c} IS NOT NULL) {over(keys, back)}, lambda a, v: a * {1 - alpha!r} + v * {alpha!r})"


def rsi(src: str, n: int, out: str, keys: str = "symbol") -> str:
    return f"""{out}_d AS (SELECT *, close - lag(close) {over(keys)} AS d FROM {src}),
{out}_g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS down FROM {out}_d),
{out}_e AS (SELECT *, count(d) {over(keys)} AS nd, {ewm('up', 1 / n, keys)} AS g, {ewm('down', 1 / n, keys)} AS l FROM {out}_g),
{out} AS (SELECT * EXCLUDE (d, up, down, nd, g, l), CASE WHEN nd >= {n} THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END END AS rsi FROM {out}_e)"""


def ma(fast: int, slow: int, keys: str = "symbol") -> str:
    return f"CASE WHEN {rolling('avg', fast, keys)} > {rolling('avg', slow, keys)} THEN 1.0 ELSE 0.0 END"


def tsmom(n: int, keys: str = "symbol") -> str:
    return f"CASE WHEN close > lag(close, {n}) {over(keys)} THEN 1.0 ELSE 0.0 END"


def hold(enter: str, leave: str, keys: str = "symbol") -> str:
    return f"coalesce(last_value(CASE WHEN {leave} THEN 0.0 WHEN {enter} THEN 1.0 END IGNORE NULLS) {over(keys)}, 0.0)"


def donchian(src: str, n: int, m: int, out: str) -> str:
    return f"{out}_x AS (SELECT *, {rolling('max', n, last=1)} AS top, {rolling('min', m, last=1)} AS bottom FROM {src}),\n{out} AS (SELECT * EXCLUDE (top, bottom), {hold('close > top', 'close < bottom')} AS donchian FROM {out}_x)"


def ledger(src: str, out: str, keys: str, fee: float = 0.001, capital: float = 10_000.0, bps: float = 5.0, positions: str | None = None) -> str:
    w, k = over(keys), keys
    pos = f"{out}_p AS (SELECT *, coalesce(lag(signal) {w}, 0.0) AS position FROM {src})," if positions is None else ""
    return f"""{pos}
{out}_t AS (SELECT *, coalesce(close / nullif(lag(close) {w}, 0) - 1, 0) AS asset_return, coalesce(abs(position - lag(position) {w}), 0) AS turnover FROM {positions or out + '_p'}),
{out}_r AS (SELECT *, position * asset_return AS gross_return, turnover * {fee} AS fee_drag, turnover * {bps / 10_000} AS slippage_drag, position * asset_return - turnover * {fee} - turnover * {bps / 10_000} AS strategy_return FROM {out}_t),
{out}_e AS (SELECT *, {capital} * product(1 + strategy_return) {w} AS equity FROM {out}_r),
{out} AS (SELECT *, coalesce(position * coalesce(lag(equity) {w}, {capital}) / nullif(lag(close) {w}, 0), 0) AS units, coalesce(lag(equity) {w}, {capital}) * (1 - position - fee_drag - slippage_drag) AS cash, equity / max(equity) OVER (PARTITION BY {k} ORDER BY bar_idx) - 1 AS drawdown FROM {out}_e)"""


SHARPE = "CASE WHEN min(strategy_return) < max(strategy_return) THEN avg(strategy_return) / stddev_samp(strategy_return) * sqrt(365.0) END"
RATIO = "(arg_max(equity, bar_idx) / arg_min(equity, bar_idx))"


def summary(src: str, keys: str) -> str:
    return f"SELECT {keys}, {r(RATIO + ' - 1')} AS total_return, {r(f'pow({RATIO}, 365.0 / count(*)) - 1')} AS cagr, {r('stddev_samp(strategy_return) * sqrt(365.0)')} AS annualised_volatility, {r(SHARPE)} AS sharpe, {r('min(drawdown)')} AS max_drawdown, count(*) FILTER (WHERE turnover > 0) AS trade_count FROM {src} GROUP BY {keys}"


def unit(text: str, first: int = 1) -> str:
    return f"(cast('0x' || substr(md5({text}), {first}, 8) AS BIGINT) / 4294967296.0)"


def normal(text: str) -> str:
    return f"(sqrt(-2 * ln(1 - {unit(text)})) * cos(2 * 3.141592653589793 * {unit(text, 9)}))"


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{select}"
