"""Places in a global order."""

from pyspark.sql import functions as F

from barloom.sources import trades as T


def test_places_of_many_rows(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("ts"), F.col("id").cast("string").alias("symbol"), F.col("id").alias("seq"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(8)).alias("rest"))
    placed = T.with_place(df, ["ts", "symbol", "seq"])
    found = placed.agg(F.count("*").alias("n"), F.min("place").alias("a"), F.max("place").alias("z"), F.count_distinct("place", "rest").alias("d")).first()
    assert tuple(found) == (40_000, 1, 40_000, 40_000)
