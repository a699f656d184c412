"""Rules that turn bars into a signal, and ensembles of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S


class Strategy(ABC):
    """Adds a column ``out``; helper columns go again, so strategies nest."""

    name: str

    @abstractmethod
    def add(self, df: DataFrame, out: str = "signal", keys: Sequence[str] = S.KEYS) -> DataFrame: ...


class BuyAndHold(Strategy):
    name = "BuyAndHold"

    def add(self, df, out="signal", keys=S.KEYS):
        return df.withColumn(out, F.lit(1.0))


class MACrossover(Strategy):
    """Long while the fast mean is above the slow one."""

    def __init__(self, fast: int = 20, slow: int = 50):
        if fast >= slow:
            raise ValueError("fast must be less than slow")
        self.fast, self.slow, self.name = fast, slow, f"MACrossover({fast},{slow})"

    def add(self, df, out="signal", keys=S.KEYS):
        w = S.by(keys)
        above = S.rolling(F.avg, "close", self.fast, w) > S.rolling(F.avg, "close", self.slow, w)
        return df.withColumn(out, F.coalesce(above, F.lit(False)).cast("double"))


class TSMOM(Strategy):
    """Long while the close is above that of ``lookback`` bars ago."""

    def __init__(self, lookback: int = 90):
        self.lookback, self.name = lookback, f"TSMOM({lookback})"

    def add(self, df, out="signal", keys=S.KEYS):
        return df.withColumn(out, F.coalesce(F.col("close") > F.lag("close", self.lookback).over(S.by(keys)), F.lit(False)).cast("double"))


class RSIMeanReversion(Strategy):
    def __init__(self, window: int = 14, buy_below: float = 30.0, exit_above: float = 50.0):
        if buy_below >= exit_above:
            raise ValueError("buy_below must be less than exit_above")
        self.window, self.low, self.high = window, buy_below, exit_above
        self.name = f"RSIMeanReversion({window},{buy_below},{exit_above})"

    def add(self, df, out="signal", keys=S.KEYS):
        rsi = f"_{out}_rsi"
        return S.with_rsi(df, self.window, rsi, keys).withColumn(out, S.trigger_hold(F.col(rsi) < self.low, F.col(rsi) > self.high, S.by(keys))).drop(rsi)


class DonchianBreakout(Strategy):
    """Enters above the highest of the closes before, leaves below the lowest."""

    def __init__(self, entry_window: int = 20, exit_window: int = 10):
        self.entry, self.exit, self.name = entry_window, exit_window, f"DonchianBreakout({entry_window},{exit_window})"

    def add(self, df, out="signal", keys=S.KEYS):
        w, top, low = S.by(keys), f"_{out}_top", f"_{out}_low"
        df = df.withColumn(top, S.rolling(F.max, "close", self.entry, w, -1)).withColumn(low, S.rolling(F.min, "close", self.exit, w, -1))
        return df.withColumn(out, S.trigger_hold(F.col("close") > F.col(top), F.col("close") < F.col(low), w)).drop(top, low)


class RSIFilter(Strategy):
    """Another strategy's signal, flat on every overbought bar."""

    def __init__(self, strategy: Strategy, window: int = 14, overbought: float = 70.0):
        self.strategy, self.window, self.over, self.name = strategy, window, overbought, f"RSIFilter({strategy.name},{overbought})"

    def add(self, df, out="signal", keys=S.KEYS):
        rsi = f"_{out}_rsi"
        df = S.with_rsi(self.strategy.add(df, out, keys), self.window, rsi, keys)
        return df.withColumn(out, F.when(F.coalesce(F.col(rsi) > self.over, F.lit(False)), 0.0).otherwise(F.col(out))).drop(rsi)


class _Ensemble(Strategy):
    def _members(self, df, out, keys):
        names = [f"_{out}_{k}" for k in range(len(self.members))]
        for member, column in zip(self.members, names, strict=True):
            df = member.add(df, column, keys)
        return df, names


class Voting(_Ensemble):
    """Long where ``k`` members are."""

    def __init__(self, members: Sequence[Strategy], k: int):
        if not 1 <= k <= len(members):
            raise ValueError("k must be from 1 to the number of members")
        self.members, self.k, self.name = members, k, f"Voting({','.join(m.name for m in members)};k={k})"

    def add(self, df, out="signal", keys=S.KEYS):
        df, names = self._members(df, out, keys)
        return df.withColumn(out, (sum(F.col(c) for c in names) >= self.k).cast("double")).drop(*names)


class SoftVoting(_Ensemble):
    """The members' weighted mean."""

    def __init__(self, members: Sequence[Strategy], weights: Sequence[float] | None = None):
        weights = list(weights) if weights is not None else [1.0] * len(members)
        if len(weights) != len(members):
            raise ValueError("as many weights as members")
        if not sum(weights):
            raise ValueError("weights must not add to zero")
        self.members, self.weights, self.name = members, weights, f"SoftVoting({','.join(m.name for m in members)})"

    def add(self, df, out="signal", keys=S.KEYS):
        df, names = self._members(df, out, keys)
        total = sum(self.weights)
        return df.withColumn(out, sum(F.col(c) * w for c, w in zip(names, self.weights, strict=True)) / total).drop(*names)


def sharpe_weights(values: Sequence[float]) -> list[float] | None:
    """Shares of the positive values; None (equal weights) if none is."""
    up = [max(v, 0.0) for v in values]
    return [v / sum(up) for v in up] if sum(up) > 0 else None


def filtered_crossover(fast: int = 20, slow: int = 50, rsi_window: int = 14, rsi_overbought: float = 70.0) -> RSIFilter:
    return RSIFilter(MACrossover(fast, slow), rsi_window, rsi_overbought)


def soft_voting(
    fast: int = 20, slow: int = 50, rsi_window: int = 14, buy_below: float = 30.0, exit_above: float = 50.0, entry_window: int = 20, exit_window: int = 10,
    member_sharpes: Sequence[float] | None = None, weights: Sequence[float] | None = None,
) -> SoftVoting:
    """Crossover, mean reversion and breakout; given weights count before those that Sharpe ratios give."""
    members = [MACrossover(fast, slow), RSIMeanReversion(rsi_window, buy_below, exit_above), DonchianBreakout(entry_window, exit_window)]
    return SoftVoting(members, weights if weights is not None else sharpe_weights(member_sharpes or []))


def hard_voting() -> Voting:
    """The fixed ensemble: two of three."""
    return Voting([RSIFilter(MACrossover(20, 50)), RSIMeanReversion(10, 20, 50), DonchianBreakout(20, 10)], 2)


# The names that a configuration uses.
REGISTRY = {
    "buy_and_hold": BuyAndHold,
    "ma_crossover": MACrossover,
    "rsi_mean_reversion": RSIMeanReversion,
    "donchian_breakout": DonchianBreakout,
    "tsmom": TSMOM,
    "rsi_filtered_crossover": filtered_crossover,
    "soft_voting_ensemble": soft_voting,
    "hard_voting_ensemble": hard_voting,
}


def build(strategy: str, **params) -> Strategy:
    """A strategy by its name; an unknown name is a KeyError."""
    return REGISTRY[strategy](**params)


def build_all(entries: Sequence[dict]) -> list[Strategy]:
    """The strategies of a configuration's list of names and params."""
    return [build(e["name"], **(e.get("params") or {})) for e in entries]
