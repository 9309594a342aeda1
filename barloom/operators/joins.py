"""Time joins as equi-joins, unions and windows: nothing here plans as a nested loop.

Both sides carry the keys; times are timestamps.  A side that shares its keys' partitioning
isn't shuffled again for the window that follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS


def _asof(left: DataFrame, right: DataFrame, values: Sequence[str], at: str, ts: str, keys: Sequence[str], forward: bool) -> DataFrame:
    row = F.struct(*left.columns)
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1 if not forward else 0).alias("_tag"), row.alias("_row"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(None).cast("timestamp").alias("_match"))
    b = right.select(*keys, F.col(ts).alias("_t"), F.lit(0 if not forward else 1).alias("_tag"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values, F.col(ts).cast("timestamp").alias("_match"))
    # forward: back in time, as a frame that ends with the key's rows is summed anew for each row
    order = [F.desc("_t"), F.desc("_tag")] if forward else ["_t", "_tag"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one struct, so that the values are those of one row even where some are null
    found = F.last(F.when(F.col("_match").isNotNull(), F.struct(*values, "_match")), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_f", found).filter("_row IS NOT NULL")
    return out.select("_row.*", *(F.col(f"_f.{v}").alias(v) for v in values), F.col("_f._match").alias("match_ts"))


def asof_backward(left: DataFrame, right: DataFrame, values: Sequence[str], at: str = "ts", ts: str = "ts", keys: Sequence[str] = KEYS) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at or before ``at`` (null if none) and its time, ``match_ts``."""
    return _asof(left, right, values, at, ts, keys, forward=False)


def asof_forward(left: DataFrame, right: DataFrame, values: Sequence[str], at: str = "ts", ts: str = "ts", keys: Sequence[str] = KEYS) -> DataFrame:
    """``left`` with the values of the first row of ``right`` at or after ``at``."""
    return _asof(left, right, values, at, ts, keys, forward=True)


def interval_join(intervals: DataFrame, points: DataFrame, bucket_seconds: int, t0: str = "t0", t1: str = "t1", ts: str = "ts", keys: Sequence[str] = KEYS) -> DataFrame:
    """Every point inside each closed interval: an equi-join on time buckets, then the exact test.

    Choose the bucket near the typical interval's length: an interval is copied once for each
    bucket it touches, a point never."""
    size = bucket_seconds * 1_000_000
    low, high = (F.floor(F.unix_micros(F.col(c).cast("timestamp")) / size) for c in (t0, t1))
    cut = intervals.filter(F.col(t0) <= F.col(t1)).withColumn("_b", F.explode(F.sequence(low, high)))
    dealt = points.withColumn("_b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / size))
    return cut.join(dealt, [*keys, "_b"]).filter((F.col(ts) >= F.col(t0)) & (F.col(ts) <= F.col(t1))).drop("_b")


def sweep(intervals: DataFrame, values: Sequence[str], closed_at: DataFrame | None = None, t0: str = "t0", t1: str = "t1", keys: Sequence[str] = KEYS) -> DataFrame:
    """At every distinct end point: ``n``, the intervals open there, and the sums of ``values`` over them.

    Intervals are right-open; a null end never closes; an empty one is never open.  Sums are gated on
    the integer count, so no rounding is left where nothing is open."""
    live = intervals.filter(F.col(t1).isNull() | (F.col(t1) >= F.col(t0)))
    on = live.select(*keys, F.col(t0).alias("ts"), F.lit(1).alias("_n"), *(F.col(v).alias(v) for v in values))
    off = live.filter(F.col(t1).isNotNull()).select(*keys, F.col(t1).alias("ts"), F.lit(-1).alias("_n"), *((-F.col(v)).alias(v) for v in values))
    steps = on.unionByName(off).groupBy(*keys, "ts").agg(F.sum("_n").alias("_n"), *(F.sum(v).alias(v) for v in values))
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("_n").over(w)
    return steps.select(*keys, "ts", n.alias("n"), *(F.when(n > 0, F.sum(v).over(w)).otherwise(F.lit(0.0)).alias(v) for v in values))


def concurrency(bars: DataFrame, intervals: DataFrame, t0: str = "t0", t1: str = "t1", keys: Sequence[str] = KEYS) -> DataFrame:
    """``bars`` with ``n``: how many closed intervals ``[t0, t1]`` hold each (an open end holds to the last bar).

    Starts count from their own time, ends stop counting just after theirs; one window over the union."""
    on = intervals.select(*keys, F.col(t0).alias("ts"), F.lit(0).alias("_tag"), F.lit(1).alias("_n"))
    off = intervals.filter(F.col(t1).isNotNull()).select(*keys, F.col(t1).alias("ts"), F.lit(2).alias("_tag"), F.lit(-1).alias("_n"))
    rows = bars.select(*keys, F.col("ts"), F.lit(1).alias("_tag"), F.lit(0).alias("_n"), F.struct(*bars.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("ts", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    all_ = rows.unionByName(on, allowMissingColumns=True).unionByName(off, allowMissingColumns=True)
    return all_.withColumn("n", F.sum("_n").over(w)).filter("_row IS NOT NULL").select("_row.*", "n")


def prefix_average(bars: DataFrame, value: str, intervals: DataFrame, out: str, t0: str = "t0", t1: str = "t1", keys: Sequence[str] = KEYS) -> DataFrame:
    """``intervals`` with the mean of ``value`` over the bars in ``[t0, t1]``, by two reads of a running sum."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = bars.select(*keys, "ts", F.sum(value).over(w).alias("_s"), F.count(value).over(w).alias("_c"), F.col(value).alias("_v"), "seq")
    last = sums.groupBy(*keys, "ts").agg(F.max_by(F.struct("_s", "_c"), "seq").alias("_e"), F.min_by(F.struct((F.col("_s") - F.coalesce("_v", F.lit(0.0))).alias("_s"), (F.col("_c") - F.col("_v").isNotNull().cast("int")).alias("_c")), "seq").alias("_b"))
    ends = asof_backward(intervals, last, ["_e"], at=t1, keys=keys).withColumnRenamed("_e", "_end").drop("match_ts")
    both = asof_forward(ends, last, ["_b"], at=t0, keys=keys).drop("match_ts")
    n = F.col("_end._c") - F.col("_b._c")
    return both.withColumn(out, F.try_divide(F.col("_end._s") - F.col("_b._s"), F.nullif(n, F.lit(0)))).drop("_end", "_b")


def without_overlap(train: DataFrame, test: DataFrame, t0: str = "t0", t1: str = "t1", keys: Sequence[str] = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """``train`` less the intervals that overlap any of ``test`` (start in, end in, or envelop): purging.

    The test intervals are merged into disjoint stretches first; each row then looks up the one stretch that
    starts last before its end, so no pair of intervals is ever formed."""
    own = [*keys, *by]
    w = Window.partitionBy(*own).orderBy(t0, t1)
    before = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = test.withColumn("_new", F.when(before.isNull() | (F.col(t0) > before), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*own, "_g").agg(F.min(t0).alias("_a"), F.max(t1).alias("_z")).select(*own, F.col("_a").alias("ts"), "_z")
    found = asof_backward(train, merged, ["_z"], at=t1, keys=own)
    return found.filter(F.col("_z").isNull() | (F.col("_z") < F.col(t0))).drop("_z", "match_ts")


def unique_times(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k-th repetition of a time is moved by k microseconds (by ``seq``)."""
    w = Window.partitionBy(*keys, "ts").orderBy("seq")
    return df.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.row_number().over(w) - 1))


def repeated_times(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``n_rows``, ``n_repeated`` (rows whose time another row of the key has)."""
    again = (F.count("*").over(Window.partitionBy(*keys, "ts")) > 1).cast("long")
    return df.withColumn("_r", again).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("_r").alias("n_repeated"))


def union_features(a: DataFrame, b: DataFrame, prefix: str, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Full outer join on the keys; ``b``'s columns get a prefix, so no name repeats."""
    return a.join(b.select(*keys, *(F.col(c).alias(prefix + c) for c in b.columns if c not in keys)), list(keys), "full")
