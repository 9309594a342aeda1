import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, sampling
from barloom.sources import fixtures
from barloom.streaming import bars as stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Trades cut into four files in time order, one file a micro-batch."""
    folder = tmp_path_factory.mktemp("trades")
    t = fixtures.trades(spark, DATA).select("symbol", "ts", "seq", "price", "quantity")
    n = t.count()
    import time

    for k in range(4):
        t.filter((F.col("seq") >= k * n // 4) & (F.col("seq") < (k + 1) * n // 4)).coalesce(1).write.mode("append").parquet(f"file://{folder}/t")
        time.sleep(1.1)
    return t, f"file://{folder}/t"


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def source(spark, parts):
    t, path = parts
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_dollar_bars_like_batch(spark, parts):
    got = run(spark, stream.threshold_bars(source(spark, parts), "dollar", 20000.005), "dollar_stream")
    want = bars.dollar_bars(parts[0], 20000.005)
    keys = ["symbol", "bar_id", "ts", "ts_end", "open", "high", "low", "close", "num_ticks"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect())) and got.count() > 5


def test_cusum_like_batch(spark, parts):
    got = run(spark, stream.cusum_events(source(spark, parts), 100.005), "cusum_stream").select("symbol", "seq", "direction")
    want = sampling.cusum_events(parts[0].withColumnRenamed("price", "close").withColumn("h", F.lit(100.005))).select("symbol", "seq", "direction")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_imbalance_like_batch(spark, parts):
    got = run(spark, stream.imbalance_bar_ids(source(spark, parts)), "imbalance_stream").select("symbol", "seq", "bar_id", "tick_sign")
    want = bars.imbalance_bar_ids(parts[0]).filter("bar_id IS NOT NULL").select("symbol", "seq", "bar_id", "tick_sign")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_time_bars_up_to_the_watermark(spark, parts):
    got = run(spark, stream.time_bars(source(spark, parts), "1 hour", "1 minute"), "time_stream")
    want = {(r["symbol"], r["ts"]): r for r in bars.time_bars(parts[0], "1 hour").collect()}
    rows = got.collect()
    assert len(rows) > 0.9 * len(want) and all(want[r["symbol"], r["ts"]]["close"] == r["close"] for r in rows)


def test_late_rows_are_dropped(spark, parts):
    with pytest.raises(ValueError):
        stream.threshold_bars(parts[0], "weekly", 1.0)
