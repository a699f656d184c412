"""Live decisions: new bars by strict watermark, decisions that agree with the batch, comparison with a log."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import strategies as G
from tidemark.operators.ledger import ledger
from tidemark.sources.bars import append_jsonl, exists, indexed, read_log, validate

LOG = logging.getLogger(__name__)
_UNIT = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
#: Bars before the first logged one that a comparison runs through, so that indicators are warm.
WARM_UP = 200


def timeframe_seconds(code: str) -> int:
    m = re.fullmatch(r"(\d+)([mhdw])", code)
    if not m:
        raise ValueError(f"not a timeframe: {code}")
    return int(m[1]) * _UNIT[m[2]]


def waits(attempts: int, base: float, most: float) -> list[float]:
    """Seconds between attempts: doubled each time, ``most`` at most."""
    return [min(base * 2**k, most) for k in range(attempts - 1)]


def with_retry(fetch: Callable, attempts: int = 5, base: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """fetch(), again after growing waits; None when all attempts failed, each of which is logged."""
    for pause in (*waits(attempts, base, most), None):
        try:
            return fetch()
        except Exception as error:  # whatever a source raises, the next poll may succeed
            LOG.warning("a fetch failed: %s", error)
        if pause is not None:
            sleep(pause)
    return None


def without_forming(window: DataFrame) -> DataFrame:
    """The window without each symbol's last bar, which may still change."""
    last = F.max("timestamp").over(Window.partitionBy("symbol"))
    return window.withColumn("_last", last).where("timestamp < _last").drop("_last")


def new_bars(window: DataFrame, seen: DataFrame) -> DataFrame:
    """Closed bars later than the last seen of their symbol; late and revised bars are ignored."""
    last = seen.groupBy("symbol").agg(F.max("timestamp").alias("_seen"))
    return without_forming(window).join(last, "symbol", "left").where("_seen is null or timestamp > _seen").drop("_seen")


def gaps(fresh: DataFrame, seen: DataFrame, seconds: float) -> DataFrame:
    """Symbols whose first new bar is more than one interval after the last seen one: bars are missing between."""
    first = fresh.groupBy("symbol").agg(F.min("timestamp").alias("first_new")).join(seen.groupBy("symbol").agg(F.max("timestamp").alias("last_seen")), "symbol")
    apart = F.unix_timestamp("first_new") - F.unix_timestamp("last_seen")
    return first.withColumn("seconds", apart).where(F.col("seconds") > seconds).select("symbol", "last_seen", "first_new", "seconds")


def merged(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """History and new bars, the later copy of a timestamp winning."""
    both = history.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "timestamp").orderBy(F.desc("_v")))).where("_n = 1").drop("_n", "_v")


def decisions(history: DataFrame, strategy, **costs) -> DataFrame:
    """The last row of each symbol's batch ledger over its history: what to hold now, and whether that trades."""
    df = ledger(strategy.add(indexed(history.drop("bar_idx"))), **costs)
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_idx"))
    df = df.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    traded, at = (F.col("turnover") > 0).alias("is_trade"), F.col("timestamp").alias("bar_timestamp")
    return df.select("symbol", "bar_idx", at, "close", "position", traded, "equity", "cash", "units", "fee_drag", "slippage_drag")


def equity_diff(live: DataFrame, backtested: DataFrame) -> DataFrame:
    """Two equity paths on their common timestamps; the live one is rebased to the first backtested value; abs_diff is signed."""
    mine = live.select("symbol", "timestamp", F.col("equity").alias("raw"))
    both = mine.join(backtested.select("symbol", "timestamp", F.col("equity").alias("backtested")), ["symbol", "timestamp"])
    scale = both.groupBy("symbol").agg(F.min_by(F.try_divide("backtested", "raw"), "timestamp").alias("_k"))
    both = both.join(scale, "symbol").withColumn("live", F.col("raw") * F.col("_k")).withColumn("abs_diff", F.col("live") - F.col("backtested"))
    return both.select("symbol", "timestamp", "live", "backtested", "abs_diff", F.try_divide("abs_diff", "backtested").alias("pct_diff"))


def worst(diff: DataFrame, n: int = 5) -> DataFrame:
    """The rows that differ most; differences equal to nine places go by symbol and time."""
    return diff.orderBy(F.round(F.abs("pct_diff"), 9).desc(), "symbol", "timestamp").limit(n)


def run_stream(bars: DataFrame, strategy, history_path: str, out_path: str, checkpoint: str, **costs):
    """A stream of bars: each micro-batch adds its new closed bars to the history and writes one decision a symbol, by the batch ledger.

    Both tables have a folder a batch (``batch=``, ``poll=``), which a batch that is run again after a failure writes anew from the
    folders before it; so no decision is lost and none is written twice.
    """
    spark = bars.sparkSession

    def poll(batch: DataFrame, number: int) -> None:
        seen = batch.limit(0)
        if exists(spark, history_path):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            seen = spark.read.schema(f"{fields}, batch long").parquet(history_path).where(F.col("batch") < number).drop("batch")
        fresh = new_bars(batch, seen).cache()
        if not fresh.isEmpty():
            fresh.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
            found = decisions(seen.unionByName(fresh), strategy, **costs)
            found.write.mode("overwrite").parquet(f"{out_path}/poll={number}")
        fresh.unpersist()

    return bars.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_line(record: dict) -> str:
    trade = " (TRADE)" if record["is_trade"] else ""
    money = f"position={record['position']:.2f} close={record['close']:.2f} equity={record['equity']:,.2f}"
    return f"[{record['bar_timestamp']}] {record['strategy_name']}: {money}{trade}"


class Session:
    """A paper-trading session of one symbol: polls a source and logs one decision for each poll that brings closed bars.

    ``fetch`` gives the current window of bars as a DataFrame; ``source`` holds symbol, timeframe and exchange_id; ``entry`` is the
    configuration's name and params of the strategy, so that ``reconcile`` can build it again.  The history is kept as a table,
    a folder a poll.
    """

    def __init__(
        self, spark: SparkSession, fetch: Callable[[], DataFrame], strategy, history_path: str, log_path: str,
        source: dict | None = None, entry: dict | None = None, costs: dict | None = None, seconds: float | None = None,
        retry: dict | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], datetime] = lambda: datetime.now(UTC),
    ):
        self.spark, self.fetch, self.strategy, self.history_path, self.log_path = spark, fetch, strategy, history_path, log_path
        self.source, self.entry = dict(source or {}), dict(entry or {})
        self.costs = {"fee": 0.001, "capital": 10_000.0, "slippage_bps": 5.0, **(costs or {})}
        if seconds is None and not self.source.get("timeframe"):
            raise ValueError("without a timeframe the seconds between polls must be given")
        self.seconds = seconds if seconds is not None else timeframe_seconds(self.source["timeframe"])
        self.retry, self.sleep, self.clock = dict(retry or {}), sleep, clock
        self.polls, self.started = 0, False

    def header(self) -> dict:
        return {
            "type": "session_start", **{k: self.source.get(k) for k in ("symbol", "timeframe", "exchange_id")}, "strategy_name": self.strategy.name,
            "strategy_registry_name": self.entry.get("name"), "strategy_params": self.entry.get("params") or {}, "initial_capital": self.costs["capital"],
            "fee": self.costs["fee"], "slippage_bps": self.costs["slippage_bps"], "started_at": self.clock().isoformat(),
        }

    def history(self) -> DataFrame | None:
        return self.spark.read.parquet(self.history_path).drop("poll") if self.polls else None

    def poll(self) -> dict | None:
        """The decision that was logged, or None: no data, or no new closed bar."""
        window = with_retry(self.fetch, sleep=self.sleep, **self.retry)
        if window is None:
            LOG.warning("no data; the next poll tries again")
            return None
        window = validate(window).drop("bar_idx")
        seen = self.history()
        before = window.limit(0) if seen is None else seen
        fresh = new_bars(window, before).cache()
        if fresh.isEmpty():
            LOG.info("no new closed bar")
            return None
        for r in gaps(fresh, before, self.seconds).collect():  # a row a symbol
            LOG.warning("bars may be missing between %s and %s", r["last_seen"], r["first_new"])
        fresh.write.mode("overwrite").parquet(f"{self.history_path}/poll={self.polls}")
        self.polls += 1
        if not self.started:
            append_jsonl(self.log_path, self.header())
            self.started = True
        row = decisions(self.history(), self.strategy, **self.costs).collect()[0].asDict()  # one symbol, one row
        fresh.unpersist()
        stamp, polled = row.pop("bar_timestamp"), self.clock().isoformat()
        money = {k: v for k, v in row.items() if k not in ("symbol", "bar_idx")}
        record = {"polled_at": polled, "bar_timestamp": stamp.isoformat(), "strategy_name": self.strategy.name, **money}
        append_jsonl(self.log_path, {"type": "decision", **record})
        print(status_line(record))
        return record

    def run(self, times: int | None = None) -> None:
        poll_forever(self.poll, self.seconds, times, self.sleep)


def rebuilt(header: dict):
    """The strategy that a session's header names."""
    if not header.get("strategy_registry_name"):
        raise ValueError("the log names no strategy of the registry")
    return G.build(header["strategy_registry_name"], **header["strategy_params"])


def reconcile(spark: SparkSession, log_path: str, fetch: Callable[..., DataFrame], warm_up: int = WARM_UP) -> tuple[DataFrame, dict, DataFrame]:
    """(differences, mean and greatest of them, the five worst) of a log's equity and a backtest over the same bars.

    ``fetch(header, since, limit)`` gives the bars from ``warm_up`` bars before the first decision on.  A log without decisions, or
    without a bar in common with the backtest, is a ValueError.
    """
    header, logged = read_log(spark, log_path)
    ends = logged.agg(F.min("timestamp").alias("first"), F.count("*").alias("n")).first()
    if not ends["n"]:
        raise ValueError("the log has no decisions")
    strategy, apart = rebuilt(header), timeframe_seconds(header["timeframe"])
    since = logged.agg(F.min("timestamp") - F.make_dt_interval(secs=F.lit(float(apart * warm_up)))).first()[0]
    bars = validate(fetch(header, since, warm_up + ends["n"] + 5))
    done = ledger(strategy.add(indexed(bars.drop("bar_idx"))), fee=header["fee"], capital=header["initial_capital"], slippage_bps=header["slippage_bps"])
    mine = logged.select(F.lit(header["symbol"]).alias("symbol"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "equity")
    diff = equity_diff(mine, done.select(F.lit(header["symbol"]).alias("symbol"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "equity"))
    sums = diff.agg(
        F.count("*").alias("bars"), F.avg(F.abs("abs_diff")).alias("mean_abs_diff"), F.max(F.abs("abs_diff")).alias("max_abs_diff"),
        F.avg(F.abs("pct_diff")).alias("mean_pct_diff"), F.max(F.abs("pct_diff")).alias("max_pct_diff")).first().asDict()
    if not sums["bars"]:
        raise ValueError("the log and the backtest have no bar in common")
    return diff, sums, worst(diff)


def poll_forever(once: Callable[[], object], seconds: float, times: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    k = 0
    while times is None or k < times:
        once()
        k += 1
        if times is None or k < times:
            sleep(seconds)
