"""Reading and writing trades and bars, and the normal form of both.

TRADES: symbol string, ts timestamp, seq long, price, quantity double, side string, sign int.
Every row has a ``seq`` that is unique within its symbol; ``(ts, seq)`` is its place in time.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_TRADES = "timestamp long, side string, volume double, price double"
BARS = "timestamp string, open double, high double, low double, close double, VWAP double, volume double"


def side_sign(side: str | Column, ignore_case: bool = False) -> Column:
    """+1 for exactly ``buy``, -1 for anything else (also null)."""
    side = F.col(side) if isinstance(side, str) else side
    side = F.lower(side) if ignore_case else side
    return F.when(side == "buy", 1).otherwise(-1).cast("int")


def _by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a glob by their first line, each opened once on the driver; unreadable ones are left out with a warning."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(path)
    fs, found = glob.getFileSystem(conf), {}
    for status in sorted(fs.globStatus(glob) or [], key=lambda s: s.getPath().toString()):
        name = status.getPath().toString()
        try:
            stream = fs.open(status.getPath())
            try:
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
        except Exception as e:  # as wide as what a file system may raise
            warnings.warn(f"{name} is skipped: {e}", stacklevel=2)
            continue
        if line:
            found.setdefault(line, []).append(name)
    return found


def read_trade_files(spark: SparkSession, path: str, symbol: str | None = None, schema: str = RAW_TRADES) -> DataFrame:
    """All CSV files of a glob; columns are matched by each file's own header, others ignored.

    Unreadable files are skipped; values that aren't of their column's type are null.  The symbol is the file's name unless given;
    ``seq`` is a row's place in (time, file) order."""
    kinds = dict(c.split() for c in schema.split(", "))
    parts = []
    for paths in _by_header(spark, path).values():
        raw = spark.read.option("header", True).option("ignoreCorruptFiles", True).csv(paths)
        parts.append(raw.select(*(F.col(c).try_cast(k).alias(c) if c in raw.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.col("_metadata.file_path").alias("source_file")))
    df = concat(*parts) if parts else spark.createDataFrame([], f"{schema}, source_file string")
    return normalise_trades(df.withColumn("symbol", F.lit(symbol) if symbol else F.regexp_extract("source_file", r"([^/]+?)(?:\.csv)?$", 1)))


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def normalise_trades(raw: DataFrame) -> DataFrame:
    """Epoch milliseconds to timestamps, ``volume`` to ``quantity``, side to sign, and a ``seq``."""
    tie = [c for c in ("source_file", "id", "price", "volume", "side") if c in raw.columns]
    order = Window.partitionBy("symbol").orderBy("timestamp", *tie)
    return raw.select(
        "symbol",
        F.timestamp_millis("timestamp").alias("ts"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("price").cast("double").alias("price"),
        F.col("volume").cast("double").alias("quantity"),
        "side",
        side_sign("side").alias("sign"),
    )


def utc_string(epoch_ms: str | Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss.ffffff``."""
    epoch_ms = F.col(epoch_ms) if isinstance(epoch_ms, str) else epoch_ms
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def read_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from CSV, with or without a leading unnamed index column."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.lower(): c for c in raw.columns}
    names = ["open", "high", "low", "close", "vwap", "volume"]
    rows = raw.select(F.lit(symbol).alias("symbol"), F.to_timestamp(F.col(lower["timestamp"])).alias("ts"), *(F.col(f"`{lower[c]}`").cast("double").alias(c) if c in lower else F.lit(None).cast("double").alias(c) for c in names))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts", *names)).cast("long"))


def read_table(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Partitioned Parquet (``symbol``, ``date``), pruned at the source by symbol and time range."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.filter(F.col("symbol").isin(symbols))
    if start:
        df = df.filter((F.col("date") >= F.to_date(F.lit(start))) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end:
        df = df.filter((F.col("date") <= F.to_date(F.lit(end))) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol and day, so that reads prune; one shuffle, no symbol-day split over small files."""
    df.withColumn("date", F.to_date("ts")).repartition("symbol", "date").write.mode(mode).partitionBy("symbol", "date").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sorted_trades(df: DataFrame) -> DataFrame:
    """Global time order with a tie-breaker; frames without a time column are returned as they are."""
    return df.orderBy(*(c for c in ("ts", "symbol", "seq") if c in df.columns)) if "ts" in df.columns else df


def with_place(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """The place of each row in a global order, from 1: ranges of the order's first column (a time or a number) are numbered apart and shifted by the sizes of those before.

    The ranges have fixed cuts: partitions of ``repartitionByRange`` differ each time that they are computed."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order[0])
    key = F.unix_micros(key.cast("timestamp")) if df.schema[order[0]].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else key.cast("double")
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 1000).alias("c")).first()["c"] or []
    marks = F.array(*(F.lit(c) for c in sorted(set(cuts))))
    ranged = df.withColumn("_part", F.size(F.filter(marks, lambda c: c < key)) if cuts else F.lit(0))
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # as many rows as partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_part", "_before")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of CSV files; columns are matched by the header, in any order, missing ones are null."""
    raw = spark.read.option("header", True).csv(path)
    kinds = dict(c.split() for c in schema.split(", "))
    return raw.select(*(F.col(c).try_cast(k).alias(c) if c in raw.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors share; it goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"{(found or 'file:///tmp/barloom-scratch').rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root
