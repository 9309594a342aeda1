"""Structured Streaming versions of the order-dependent operators.

A symbol's state is a few numbers, kept between micro-batches; rows of a micro-batch are folded
in (time, seq) order.  A row that is not later than the last one folded for its symbol can't be placed
any more (its bar may be closed) and is dropped: sources should deliver a symbol in order, or be
delayed by a watermark first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR = "symbol string, bar_id long, ts timestamp, ts_end timestamp, open double, high double, low double, close double, vwap double, volume double, num_ticks long"
BAR_STATE = "bar_id long, total double, first_us long, last_us long, last_seq long, open double, high double, low double, close double, value double, volume double, num_ticks long"
_EMPTY = (0, 0.0, 0, -(2**62), -(2**62), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["us", "seq"], kind="stable")


def _keyed(trades: DataFrame) -> DataFrame:
    return trades.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq", "price", "quantity")


def threshold_bars(trades: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Tick, volume or dollar bars: a bar is emitted in the micro-batch of the trade that closes it."""
    if kind not in ("tick", "volume", "dollar"):
        raise ValueError("kind must be tick, volume or dollar")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, total, first, last_us, last_seq, o, h, low, c, value, volume, n = state.get if state.exists else _EMPTY
        out = []
        for r in _ordered(frames).itertuples():
            if (r.us, r.seq) <= (last_us, last_seq):
                continue
            last_us, last_seq = r.us, r.seq
            if not n:
                first, o, h, low = r.us, r.price, r.price, r.price
            h, low, c, n = max(h, r.price), min(low, r.price), r.price, n + 1
            value, volume = value + r.price * r.quantity, volume + r.quantity
            total += {"tick": 1.0, "volume": r.quantity, "dollar": r.price * r.quantity}[kind]
            if total >= threshold:
                out.append((key[0], bar, first, r.us, o, h, low, c, value / volume if volume else None, volume, n))
                bar, total, value, volume, n = bar + 1, 0.0, 0.0, 0.0, 0
        state.update((int(bar), float(total), int(first), int(last_us), int(last_seq), float(o), float(h), float(low), float(c), float(value), float(volume), int(n)))
        names = [x.split()[0] for x in BAR.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        for t in ("ts", "ts_end"):
            frame[t] = pd.to_datetime(frame[t].astype("int64"), unit="us")
        yield frame

    return _keyed(trades).groupBy("symbol").applyInPandasWithState(step, BAR, BAR_STATE, "append", GroupStateTimeout.NoTimeout)


EVENT = "symbol string, ts timestamp, seq long, direction int"
CUSUM_STATE = "up double, down double, last double, last_us long, last_seq long"


def cusum_events(trades: DataFrame, threshold: float) -> DataFrame:
    """The symmetric CUSUM filter on prices."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last, last_us, last_seq = state.get if state.exists else (0.0, 0.0, None, -(2**62), -(2**62))
        out = []
        for r in _ordered(frames).itertuples():
            if (r.us, r.seq) <= (last_us, last_seq):
                continue
            last_us, last_seq = r.us, r.seq
            if last is not None:
                up, down = max(0.0, up + (r.price - last)), min(0.0, down + (r.price - last))
                if down < -threshold:
                    down = 0.0
                    out.append((key[0], r.us, r.seq, -1))
                elif up > threshold:
                    up = 0.0
                    out.append((key[0], r.us, r.seq, 1))
            last = r.price
        state.update((float(up), float(down), None if last is None else float(last), int(last_us), int(last_seq)))
        frame = pd.DataFrame(out, columns=["symbol", "ts", "seq", "direction"])
        frame["ts"] = pd.to_datetime(frame["ts"].astype("int64"), unit="us")
        yield frame

    return _keyed(trades).groupBy("symbol").applyInPandasWithState(step, EVENT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


TICK = "symbol string, ts timestamp, seq long, bar_id long, tick_sign int, closes boolean"
IMBALANCE_STATE = "bar long, count double, theta double, flow double, ticks double, threshold double, last double, sign int, last_us long, last_seq long"


def imbalance_bar_ids(trades: DataFrame, alpha_ticks: float = 0.1, alpha_flow: float = 0.1, expected_flow: float = 0.5, expected_ticks: float = 10.0) -> DataFrame:
    """Tick-imbalance bar ids of every trade but a symbol's first."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, count, theta, flow, ticks, limit, last, sign, last_us, last_seq = state.get if state.exists else (0, 0.0, 0.0, expected_flow, expected_ticks, expected_flow * expected_ticks, None, 1, -(2**62), -(2**62))
        out = []
        for r in _ordered(frames).itertuples():
            if (r.us, r.seq) <= (last_us, last_seq):
                continue
            last_us, last_seq = r.us, r.seq
            if last is not None:
                sign = sign if r.price == last else (1 if r.price > last else -1)
                count, theta, flow = count + 1, theta + sign, alpha_flow * sign + (1 - alpha_flow) * flow
                done = abs(theta) >= limit
                out.append((key[0], r.us, r.seq, bar, sign, done))
                if done:
                    ticks = alpha_ticks * count + (1 - alpha_ticks) * ticks
                    bar, count, theta, limit = bar + 1, 0.0, 0.0, ticks * abs(flow)
            last = r.price
        state.update((int(bar), float(count), float(theta), float(flow), float(ticks), float(limit), None if last is None else float(last), int(sign), int(last_us), int(last_seq)))
        frame = pd.DataFrame(out, columns=["symbol", "ts", "seq", "bar_id", "tick_sign", "closes"])
        frame["ts"] = pd.to_datetime(frame["ts"].astype("int64"), unit="us")
        yield frame

    return _keyed(trades).groupBy("symbol").applyInPandasWithState(step, TICK, IMBALANCE_STATE, "append", GroupStateTimeout.NoTimeout)


def time_bars(trades: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Time bars, emitted once the watermark (``late`` behind the newest trade) has passed their end; later trades are dropped."""
    at = F.struct("ts", "seq")
    marked = trades.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = marked.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
