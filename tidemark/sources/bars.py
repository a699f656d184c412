"""Where bars come from, and the plain sinks."""

from __future__ import annotations

import contextlib
import json
import re
import sys
from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Columns that a bar has (others may follow).
PRICES = ("open", "high", "low", "close", "volume")


def validate(df: DataFrame) -> DataFrame:
    """The same frame if it is one of bars; looks at the schema only."""
    if "timestamp" not in df.columns:
        raise ValueError("bars need a column named timestamp")
    if not isinstance(df.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError("timestamp must hold timestamps")
    if lacking := [c for c in PRICES if c not in df.columns]:
        raise ValueError(f"bars lack {', '.join(lacking)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it belongs to; what goes wrong in looking is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_bars(spark: SparkSession, path: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars in parquet; ``since`` reaches the scan as a filter; ``limit``: the first bars of each symbol from there on."""
    return first_bars(validate(spark.read.parquet(path)), since, limit)


def first_bars(df: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    if since is not None:
        df = df.where(F.col("timestamp") >= F.lit(str(since)).cast(df.schema["timestamp"].dataType))
    if limit is None:
        return df
    keys = ["symbol"] if "symbol" in df.columns else []
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp"))).where(F.col("_n") <= limit).drop("_n")


def cache_name(exchange: str, symbol: str, timeframe: str, limit: int) -> str:
    return f"{exchange}_{symbol.replace('/', '-')}_{timeframe}_{limit}.parquet"


def read_through(spark: SparkSession, fetch: Callable[[], DataFrame], folder: str, name: str, since: str | None = None) -> DataFrame:
    """Bars from the cache, or from ``fetch()`` and then into it; with ``since`` the cache is left alone."""
    if since:
        return validate(fetch())
    path = f"{folder}/{name}"
    if not exists(spark, path):
        validate(fetch()).write.mode("overwrite").parquet(path)
    return validate(spark.read.parquet(path))


def first_that_works(*sources) -> DataFrame:
    """The first source that gives bars; the last one's error if none does."""
    for k, fetch in enumerate(sources):
        try:
            return validate(fetch())
        except Exception:
            if k == len(sources) - 1:
                raise


def indexed(df: DataFrame, keys=("symbol",)) -> DataFrame:
    return df.withColumn("bar_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")).cast("long") - 1)


def tick_bars(ticks: DataFrame) -> DataFrame:
    """Hourly open, high, low, close, volume of each event type; ties in time go by event_id."""
    at = F.struct("ts", "event_id")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return ticks.groupBy(F.col("event_type").alias("symbol"), hour.alias("timestamp")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.sum("value").alias("volume"),
        F.avg("value").alias("mean"),
    )


def index_bars(ticks: DataFrame) -> DataFrame:
    """Bars of a price-like index: each hour's standardised mean value moves the price by 2 per cent."""
    w, whole = Window.partitionBy("symbol").orderBy("timestamp"), Window.partitionBy("symbol")
    df = indexed(tick_bars(ticks).select("symbol", "timestamp", "volume", "mean"))
    z = F.try_divide(F.col("mean") - F.avg("mean").over(whole), F.stddev_samp("mean").over(whole))
    df = df.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("close", 100 * F.exp(0.02 * F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    high, low = F.greatest("open", "close") * 1.005, F.least("open", "close") * 0.995
    return df.select("symbol", "timestamp", "bar_idx", "open", high.alias("high"), low.alias("low"), "close", "volume")


def uniform(*parts: Column | str, first: int = 1) -> Column:
    """A number in [0, 1) that the parts alone decide: eight hex digits of their digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), first, 8), 16, 10).cast("double") / float(1 << 32)


def normal(*parts: Column | str) -> Column:
    """A standard normal number that the parts alone decide (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - uniform(*parts))) * F.cos(F.lit(2 * 3.141592653589793) * uniform(*parts, first=9))


def synthetic_bars(
    spark: SparkSession, n: int = 730, start: str = "2020-01-01", price: float = 100.0, regime: int = 90, bull: float = 0.0015, bear: float = -0.0015,
    volatility: float = 0.02, seed: int = 42, symbol: str = "SYN", freq: str = "1 day",
) -> DataFrame:
    """Geometric random walk whose drift alternates by regime, a bar each ``freq`` (an interval such as 4 hour); the seed alone decides every bar."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    i = F.col("bar_idx").cast("string")
    df = spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("bar_idx"))
    drift = F.when(F.floor(F.col("bar_idx") / regime) % 2 == 0, bull).otherwise(bear)
    df = df.withColumn("x", drift + volatility * normal(F.lit(f"{seed}:c"), i))
    df = df.withColumn("close", price * F.exp(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(price)))
    wick = F.abs(normal(F.lit(f"{seed}:w"), i)) * volatility / 2
    return df.select(
        "symbol",
        F.expr(f"timestamp_ntz'{start}' + bar_idx * interval '{freq}'").alias("timestamp"),
        "bar_idx",
        "open",
        (F.greatest("open", "close") * (1 + wick)).alias("high"),
        (F.least("open", "close") * (1 - wick)).alias("low"),
        "close",
        (100 + 900 * uniform(F.lit(f"{seed}:v"), i)).alias("volume"),
    )


def append_jsonl(path: str, record: dict) -> None:
    """One object a line, at the end of a log."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as log:
        log.write(json.dumps(record) + "\n")


# The fields of the log's two kinds of line.
LOG = """type string, polled_at string, bar_timestamp string, strategy_name string, close double, position double, is_trade boolean,
equity double, cash double, units double, fee_drag double, slippage_drag double, symbol string, timeframe string, exchange_id string,
strategy_registry_name string, strategy_params string, initial_capital double, fee double, slippage_bps double, started_at string"""


def read_log(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The first session header and all decisions in order of their bars; blank lines are skipped; no header, or a line that is no JSON, is an error."""
    text = spark.read.text(path).where(F.trim("value") != "")
    text = text.select(F.monotonically_increasing_id().alias("line"), F.from_json("value", LOG).alias("r"), "value")
    broken = text.where(F.col("r").isNull() | F.col("r.type").isNull()).orderBy("line").limit(1).collect()
    if broken:
        raise ValueError(f"not a line of a log: {broken[0]['value'][:100]}")
    lines = text.select("line", "r.*")
    header = lines.where("type = 'session_start'").orderBy("line").limit(1).collect()
    if not header:
        raise ValueError("the log has no session_start line")
    found = {k: v for k, v in header[0].asDict().items() if v is not None and k != "line"}
    found["strategy_params"] = json.loads(found.get("strategy_params") or "{}")
    return found, lines.where("type = 'decision'").withColumn("timestamp", F.to_timestamp("bar_timestamp")).drop("line").orderBy("timestamp")


def candles(spark: SparkSession, rows: list[list], symbol: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars from an exchange's candles: [milliseconds since 1970, open, high, low, close, volume]."""
    plain = [(symbol, int(r[0]), *(None if x is None else float(x) for x in r[1:6])) for r in rows]
    df = spark.createDataFrame(plain, "symbol string, ms long, " + ", ".join(f"{c} double" for c in PRICES))
    at = F.timestamp_millis("ms").cast("timestamp_ntz")  # in the session's zone, which is UTC
    return validate(first_bars(df.select("symbol", at.alias("timestamp"), *PRICES), since, limit))


class ExchangeBars(DataSource):
    """Format ``exchange_bars``: candles of an exchange, through the ccxt package where it is installed, or from recorded ones.

    Options: symbol, timeframe, limit, since (milliseconds), exchange; ``path``: a JSON file with a list of candles instead.
    """

    @classmethod
    def name(cls) -> str:
        return "exchange_bars"

    def schema(self) -> str:
        return "symbol string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in PRICES)

    def reader(self, schema):
        return _CandleReader(dict(self.options))


class _CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        symbol, since = self.options.get("symbol", "BTC/USDT"), self.options.get("since")
        limit = int(self.options.get("limit", 730))
        if path := self.options.get("path"):
            with open(path) as f:
                rows = [r for r in json.load(f) if since is None or r[0] >= int(since)][:limit]
        else:
            import ccxt

            exchange = getattr(ccxt, self.options.get("exchange", "binance"))()
            rows = exchange.fetch_ohlcv(symbol, timeframe=self.options.get("timeframe", "1d"), since=None if since is None else int(since), limit=limit)
        for ms, *prices in rows:
            yield (symbol, datetime(1970, 1, 1) + timedelta(milliseconds=int(ms)), *map(float, prices[:5]))


def file_name(label: str, suffix: str = "_trades.csv") -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", label).strip("_") + suffix


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trade_logs(trades: DataFrame, runs: list[str], folder: str) -> list[str]:
    """A CSV folder of closed trades for each strategy; one without trades has the header alone."""
    paths = [f"{folder}/{file_name(name)}" for name in runs]
    for name, path in zip(runs, paths, strict=True):
        mine = trades.where(F.col("strategy") == name)
        write_csv(mine.coalesce(1).orderBy("symbol", "trade_id") if "trade_id" in trades.columns else mine.coalesce(1), path)
    return paths


class Tee:
    """What is printed goes to several files."""

    def __init__(self, *files):
        self.files = files

    def write(self, text: str) -> int:
        for f in self.files:
            f.write(text)
        return len(text)

    def flush(self) -> None:
        for f in self.files:
            f.flush()


@contextlib.contextmanager
def printed_to(path: str):
    """Copies all that is printed inside to a file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f, contextlib.redirect_stdout(Tee(sys.stdout, f)):
        yield


def text_table(columns: list[str], rows: list, title: str | None = None) -> str:
    """Aligned columns; floats to four places."""
    cells = [[f"{x:.4f}" if isinstance(x, float) else str(x) for x in row] for row in rows]
    width = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    lines = ["  ".join(x.ljust(n) for x, n in zip(r, width, strict=True)).rstrip() for r in [columns, *cells]]
    return "\n".join([*([title] if title else []), *lines])
