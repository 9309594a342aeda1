"""Lookups forward in time over one long key."""

from pyspark.sql import functions as F

from barloom.operators import joins as J


def test_forward_lookups_add_rows_to_their_frame(spark):
    """A frame that ends with the key's rows is summed anew for each of them: the square of a key's rows."""
    df = spark.range(10).select(F.lit("O").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("close"))
    spans = df.select("symbol", "seq", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("t1"))
    out = J.prefix_average(df, "close", spans, "m")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["seq"]: r["m"] for r in out.collect()} == {k: (k + min(k + 3, 9)) / 2 for k in range(10)}
