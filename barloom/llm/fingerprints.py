"""Document fingerprints: the bottom-k sketch of a text's word-shingle hashes.

Only DataFrame functions run here.  A sketch is the sorted array of the ``k``
smallest distinct hashes; ``merge`` gives the sketch of a union from the
sketches of its parts (a text's parts, or a collection's documents), and
``resemblance``, ``containment`` and ``distinct_shingles`` estimate from sketches
alone.  Everything a text needs is in its own row, so nothing but the pairing of
neighbours moves between tasks.

Words are runs of characters other than ASCII white space, lower-cased; fewer
words than ``SHINGLE`` are one shingle; null and blank texts have the empty
sketch.  Two empty sketches resemble each other fully, an empty one and another
not at all.  Equal texts have equal sketches.  ``as_text`` writes a sketch as 16
hexadecimal digits a hash, in order, and ``from_text`` reads it back; the empty
sketch is the empty string.

``fingerprint_edits`` takes a null id as the lowest one; rows that share an id (or
have none) follow each other by a hash of their text, and rows that repeat an id and a
text are successors of each other.  An empty table gives no rows; a single row is its own
successor; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

K = 128
SHINGLE = 5
WORDS = r"[ \t\n\x0B\f\r]+"
_LOWEST = -(2**63)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of ``text`` as array<bigint>; the word hashes are a column of
    their own in between, so each is computed once and not once a shingle."""
    words = f"_{out}_words"
    df = df.withColumn(words, word_hashes(F.col(text)))
    h = F.col(words)
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.least(F.size(h), F.lit(1))))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(h, i + d) for d in range(1, shingle))))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` sketch."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group's union: hashes are made distinct before the shuffle and
    cut to ``k`` per ``(group, salt)`` first, so no group's hashes meet in one task."""
    hashes = df.select(*by, F.explode(sketch).alias("_h")).distinct().withColumn("_salt", F.pmod(F.hash("_h"), F.lit(64)))
    part = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_h"))).filter(F.col("_r") <= k)
    whole = part.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).filter(F.col("_r") <= k)
    return whole.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """Without loss: each hash as 16 lower-case hexadecimal digits."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def from_text(text: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / 16).cast("int") - 1), lambda i: F.substring(text, (i * 16 + 1).cast("int"), F.lit(16)))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(digits, lambda x: F.conv(x, 16, -10).cast("long")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k-1) over the k-th smallest as a share of all hashes."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def with_next(spark: SparkSession, docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Rows of ``docs`` (``doc_id, text``) beside, as rows of the same chunk, those that come
    next by descending doc_id: ``_chunk``, ``_guest`` (true: there only to be a successor),
    ``_k``, ``_h`` (the order).  Chunks are ranges of doc_id between approximate quantiles, a
    fixed number for each shuffle partition; each chunk gets a copy of the first row of the
    chunk below, the lowest one of the highest.  Null ids come last; rows that share an id
    are ordered by a hash of the text.
    """
    chunks = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    ids = docs.select(key.alias("_k"))
    # at most `chunks` numbers reach the driver, twice
    cuts = ids.agg(F.percentile_approx("_k", [i / chunks for i in range(1, chunks)], 20 * chunks).alias("c")).first()["c"] if chunks > 1 else None
    cuts = F.array(*(F.lit(c) for c in sorted(set(cuts or ())))).cast("array<bigint>")

    def chunk_of(k: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < k))

    tops = ids.withColumn("_chunk", chunk_of(F.col("_k"))).groupBy("_chunk").agg(F.max("_k").alias("_top")).orderBy("_chunk").collect()
    dests = [(r["_chunk"], r["_top"], tops[(i + 1) % len(tops)]["_chunk"]) for i, r in enumerate(tops)]
    tops = F.broadcast(spark.createDataFrame(dests, "_chunk int, _top long, _dest int"))
    rows = docs.withColumn("_k", key).withColumn("_chunk", chunk_of(F.col("_k"))).join(tops, "_chunk")
    own = F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("g"))
    guest = F.struct(F.col("_dest").alias("c"), F.lit(True).alias("g"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_k") == F.col("_top"), F.array(own, guest)).otherwise(F.array(own))))
    return rows.select(F.col("_at.c").alias("_chunk"), F.col("_at.g").alias("_guest"), "_k", F.xxhash64("text").alias("_h"), *docs.columns)


def fingerprint_edits(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint, its edited text's (both as text), and their likeness; the only
    shuffle that carries texts puts each chunk's rows together."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_sketch(with_next(spark, docs).repartition("_chunk"), "text", "fingerprint", k)
    after = Window.partitionBy("_chunk").orderBy("_guest", F.desc("_k"), F.desc("_h"))
    rows = rows.withColumn("_next", F.lead(F.struct("text", "fingerprint")).over(after)).filter(~F.col("_guest"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next.text", F.lit(1), third)))
    rows = with_sketch(rows, "_edited", "edited_fingerprint", k)
    fp = F.col("fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(fp).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        resemblance(fp, F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(fp, F.col("_next.fingerprint"), k).alias("near_next"),
        distinct_shingles(fp, k).alias("distinct_shingles"),
        containment(fp, F.col("edited_fingerprint"), k).alias("contained_in_edited"),
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark, table(spark, sf_dir, "documents"))
