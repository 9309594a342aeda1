"""The test tables as the frames that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .trades import side_sign


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, symbol: str = "user_id") -> DataFrame:
    """TRADES from ``events``: a symbol for each ``user_id`` (many short series) or ``event_type`` (few long ones)."""
    e = _table(spark, sf_dir, "events")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell")
    return e.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("long") + 1).cast("double").alias("quantity"),
        side.alias("side"),
        side_sign(side).alias("sign"),
    )


def day_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRADES from ``lineitem``: a symbol for each supplier, one time a day, so times repeat."""
    line = _table(spark, sf_dir, "lineitem")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", *tie)
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return line.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.row_number().over(w).cast("long").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        side.alias("side"),
        side_sign(side).alias("sign"),
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series from ``orders``: ``symbol, ts, seq, close``, the mean order value of each day in cents."""
    o = _table(spark, sf_dir, "orders")
    days = o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return days.select(F.lit("O").alias("symbol"), "ts", day.cast("long").alias("seq"), (F.col("s") / F.col("n")).alias("close"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIGNALS from ``orders``: held for 1 to 25 days, many open at once; side by order key."""
    o = _table(spark, sf_dir, "orders")
    t0 = F.col("o_orderdate").cast("timestamp")
    days = (F.col("o_orderkey") % 25 + 1).cast("int")
    return o.select(
        F.lit("O").alias("symbol"),
        F.col("o_orderkey").alias("seq"),
        t0.alias("t0"),
        (t0 + F.make_dt_interval(days)).alias("t1"),
        (F.floor("o_totalprice").cast("double") / 524288).alias("signal"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"),
    )


def samples(spark: SparkSession, sf_dir: str, features: int = 64) -> DataFrame:
    """SAMPLES from ``embeddings``: features ``f0`` on, ``bin`` (label under 5), weight 1, day-long label spans of 5 days."""
    e = _table(spark, sf_dir, "embeddings")
    t0 = F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.col("vec_id").cast("int"))
    return e.select(
        F.lit("S").alias("symbol"),
        F.col("vec_id").alias("row_id"),
        t0.alias("t0"),
        (t0 + F.make_dt_interval(F.lit(5))).alias("t1"),
        (F.col("label") < 5).cast("int").alias("bin"),
        F.lit(1.0).alias("w"),
        *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(features)),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y``, ``pred``, a probability ``p`` of class 1 and a weight ``w`` from ``labels``."""
    return _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("y"),
        (1 - F.col("toxic")).cast("int").alias("pred"),
        ((F.col("doc_id") % 97 + 1) / 99).alias("p"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("w"),
    )


SQL_TRADES = """trades AS (
  SELECT user_id::VARCHAR AS symbol, ts, event_id AS seq, value AS price, (regexp_extract(props, '[0-9]+', 0)::BIGINT + 1)::DOUBLE AS quantity,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS sign
  FROM events)"""
SQL_LONG_TRADES = SQL_TRADES.replace("user_id::VARCHAR", "event_type")
SQL_DAY_TRADES = """trades AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate AS ts,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
         l_extendedprice / l_quantity AS price, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side
  FROM lineitem)"""
SQL_SERIES = """series AS (
  SELECT 'O' AS symbol, o_orderdate AS ts, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS seq,
         sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS close
  FROM orders GROUP BY o_orderdate)"""
SQL_INTERVALS = """intervals AS (
  SELECT 'O' AS symbol, o_orderkey AS seq, o_orderdate AS t0, o_orderdate + to_days((o_orderkey % 25 + 1)::INTEGER) AS t1, floor(o_totalprice) / 524288 AS signal,
         CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side
  FROM orders)"""
SQL_SAMPLES = """samples AS (
  SELECT vec_id AS row_id, TIMESTAMP '2020-01-01' + to_days(vec_id::INTEGER) AS t0, TIMESTAMP '2020-01-06' + to_days(vec_id::INTEGER) AS t1,
         (label < 5)::INTEGER AS bin, embedding
  FROM embeddings)"""
SQL_PREDICTIONS = """preds AS (
  SELECT doc_id AS row_id, quality::INTEGER AS y, (1 - toxic)::INTEGER AS pred, (doc_id % 97 + 1) / 99.0::DOUBLE AS p, (doc_id % 5 + 1)::DOUBLE AS w FROM labels)"""


def sql_q6(x: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"


def sql_us(ts: str) -> str:
    return f"epoch_us({ts})"
