"""Line deduplication: units repeated anywhere in the corpus are kept once.

A unit is a line (or, with ``separator="\\n\\n"``, a paragraph) of at least ``MIN_WORDS``
words, and within a line of several sentences each sentence of as many:
passages that were pasted into a line are found by the sentences inside them.  A unit is normalised (lower case, runs of white space as one
space) and hashed to 128 bits.  Digests are grouped globally: the occurrence with
the smallest ``(doc_id, offset)`` stays and all others are removed, with their
character offsets in the original text.  Shorter units are never removed.  The first
line with a given text has the first of each of its sentences, so nothing is lost
by removing both.

A document's later occurrences form runs: those with at most ``GAP`` characters between them.  A run goes
only if it spans ``MIN_RUN`` characters or more, so that a passage goes and a short line that many clean
documents share stays; ``min_run=0`` removes every later occurrence.

Texts are split once: the units are written as numbers.  The grouping combines before its
shuffle, and the repeated digests are a table before they are joined back to the units: with an
exchange on both sides, Spark can split the join where a digest is hot.  Nothing else is
gathered by digest, and texts are only joined to the removed spans of their own document.

A document's text without the removed units keeps the separators between the units that
stay; a line whose sentences are all removed goes with its separator.  Null texts stay null; empty texts have no units; documents that share
an id are told apart by a hash of their text, and the rows of one text under one id
count as one occurrence, so none of them loses it to another; a null id ranks first.
Empty tables give no rows.  Other columns are carried along by ``dedup_table``; where the table has a column
named like the result, the result's name gets underscores added until it is free.  Columns that begin with an underscore are reserved.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, batch, free_names, map_batches, table

MIN_WORDS = 5
#: In characters (code points): the least run that goes, and what may lie between two units of a run.
MIN_RUN = 100
GAP = 40
SEPARATOR = "\n"
_LOWEST = -(2**63)

UNITS = "k long, t long, begin int, stop int, h1 long, h2 long"
_UNITS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
_SENTENCE_END = re.compile(r"(?<=[.!?]) ")


def split_units(text: str, separator: str = SEPARATOR, min_words: int = MIN_WORDS):
    """``(begin, stop, digest)`` of each unit that counts; offsets in code points."""
    begin = 0
    for line in text.split(separator):
        words = line.lower().split()
        if len(words) >= min_words:
            yield begin, begin + len(line), _digest(words)
            sentences = _SENTENCE_END.split(line)
            if len(sentences) > 1:
                at = begin
                for sentence in sentences:
                    words = sentence.lower().split()
                    if len(words) >= min_words:
                        yield at, at + len(sentence), _digest(words)
                    at += len(sentence) + 1
        begin += len(line) + len(separator)


def _digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def keyed(docs: DataFrame) -> DataFrame:
    """``_k, _t`` tell the documents apart: id and hash of the text."""
    return docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))).withColumn("_t", F.xxhash64(F.col("text").cast("string")))


def units(docs: DataFrame, separator: str = SEPARATOR, min_words: int = MIN_WORDS) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                columns, digests = ([], [], [], []), []
                for k, t, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for begin, stop, digest in split_units(text, separator, min_words):
                        for column, v in zip(columns, (k, t, begin, stop)):
                            column.append(v)
                        digests.append(digest)
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield batch(_UNITS, *columns, halves[:, 0], halves[:, 1])

    return map_batches(keyed(docs).filter("text IS NOT NULL").select("_k", "_t", F.col("text").cast("string")), run, UNITS)


def later_spans(docs: DataFrame, separator: str = SEPARATOR, min_words: int = MIN_WORDS) -> DataFrame:
    """``k, t, spans`` of every document with a later occurrence; spans are ``(begin, stop, first_doc_id)`` in order."""
    scratch = Scratch(docs.sparkSession, "linededup")
    found = scratch.keep(units(docs, separator, min_words), "units")
    place = F.struct("k", "begin", "t")
    repeated = found.select("h1", "h2", place.alias("p")).groupBy("h1", "h2").agg(F.min("p").alias("first"), F.max("p").alias("other")).filter("first <> other").drop("other")
    repeated = scratch.keep(repeated, "repeated")
    later = found.join(repeated, ["h1", "h2"]).filter(place > F.col("first"))
    first = F.when(F.col("first.k") != _LOWEST, F.col("first.k"))
    # one text's own units: bounded by the text, not by the corpus
    return later.groupBy("k", "t").agg(F.sort_array(F.collect_set(F.struct("begin", "stop", first.alias("first_doc_id")))).alias("spans"))


def long_runs(spans: list[dict], min_run: int = MIN_RUN) -> list[dict]:
    """The spans (sorted) that belong to runs of ``min_run`` characters or more."""
    kept, run, end = [], [], 0
    for s in [*spans, None]:
        if run and (s is None or s["begin"] > end + GAP):
            if end - run[0]["begin"] >= min_run:
                kept += run
            run = []
        if s is not None:
            end = max(end, s["stop"]) if run else s["stop"]
            run.append(s)
    return kept


def without_spans(text: str, spans: list[tuple[int, int]], separator: str = SEPARATOR) -> str:
    """``text`` less the spans, each with one separator (or space) beside it."""
    gone = set(spans)
    kept, begin = [], 0
    for line in text.split(separator):
        if (begin, begin + len(line)) not in gone:
            at, sentences, stay = begin, _SENTENCE_END.split(line), []
            for sentence in sentences:
                if (at, at + len(sentence)) not in gone:
                    stay.append(sentence)
                at += len(sentence) + 1
            if stay:
                kept.append(" ".join(stay))
        begin += len(line) + len(separator)
    return separator.join(kept)


def dedup_table(docs: DataFrame, separator: str = SEPARATOR, min_words: int = MIN_WORDS, out: str = "removed", min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text`` less its removed units, and ``removed``: their spans (null if none)."""
    out = free_names(docs.columns, out)[0]
    spans = later_spans(docs, separator, min_words).select(F.col("k").alias("_sk"), F.col("t").alias("_st"), F.col("spans").alias(out))
    joined = keyed(docs).join(spans, (F.col("_k") == F.col("_sk")) & (F.col("_t") == F.col("_st")), "left").drop("_k", "_t", "_sk", "_st")
    at, schema = joined.columns.index("text"), joined.schema

    def run(batches):
        for b in batches:
            last = b.num_columns - 1
            texts = b.column(at).to_pylist()
            gone = [long_runs(s, min_run) or None if s else None for s in b.column(last).to_pylist()]
            left = [without_spans(t, [(s["begin"], s["stop"]) for s in g], separator) if g else t for t, g in zip(texts, gone, strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array(left, b.schema.field(at).type))
            yield b.set_column(last, b.schema.field(last), pa.array(gone, b.schema.field(last).type))

    return map_batches(joined, run, schema)


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``n_chars``) less all repeated passages; a text of which nothing is left goes."""
    out = dedup_table(docs, out="_removed")
    left = F.col("_removed").isNull() | ~F.col("text").rlike(r"\A\s*\z")
    kind = docs.schema["n_chars"].dataType
    return out.filter(left).withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))).select(*docs.columns)


def _query(spark: SparkSession, sf_dir: str, min_run: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    out = dedup_table(docs, min_run=min_run)
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["begin"], s["stop"]))
    firsts = F.array_sort(F.array_distinct(F.transform("removed", lambda s: s["first_doc_id"])))
    return out.select(
        "doc_id",
        "text",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed_spans"),
        F.coalesce(F.array_join(firsts.cast("array<string>"), ","), F.lit("")).alias("first_doc_ids"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, MIN_RUN)


def substring_dedup_every_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence goes, however short its run."""
    return _query(spark, sf_dir, 0)


def _sql(min_run: int) -> str:
    return rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL
),
placed AS (
  SELECT doc_id, line, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS begin_at,
         string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM line
),
part AS (SELECT doc_id, line_no, begin_at, len(parts) AS n_parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_no FROM placed),
sentence AS (
  SELECT doc_id, line_no, n_parts, part, part_no,
         begin_at + sum(length(part) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY part_no) - length(part) - 1 AS begin_at
  FROM part
),
unit AS (
  SELECT doc_id, line_no, 0 AS part_no, begin_at, begin_at + length(line) AS stop_at, line AS unit, {MIN_WORDS} AS least FROM placed
  UNION ALL
  SELECT doc_id, line_no, part_no, begin_at, begin_at + length(part), part, {MIN_WORDS} FROM sentence
  WHERE n_parts > 1 AND (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM placed WHERE len(string_split(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), ' ')) >= {MIN_WORDS})
),
norm AS (SELECT *, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM unit),
later AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, row_number() OVER w > 1 AS later FROM norm
  WHERE len(string_split(norm, ' ')) >= least WINDOW w AS (PARTITION BY norm ORDER BY doc_id, begin_at)
),
edge AS (
  SELECT *, coalesce(begin_at > max(stop_at) OVER (PARTITION BY doc_id ORDER BY begin_at, stop_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP}, true)::INTEGER AS opens
  FROM later WHERE later
),
run AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY begin_at, stop_at ROWS UNBOUNDED PRECEDING) AS run FROM edge),
ranked AS (SELECT *, max(stop_at) OVER r - min(begin_at) OVER r >= {min_run} AS gone FROM run WINDOW r AS (PARTITION BY doc_id, run)),
left_over AS (
  SELECT s.doc_id, s.line_no, string_agg(s.part, ' ' ORDER BY s.part_no) FILTER (NOT coalesce(r.gone, false)) AS line
  FROM sentence s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.line_no = s.line_no AND r.part_no = s.part_no
  GROUP BY s.doc_id, s.line_no
),
clean AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (l.line IS NOT NULL AND NOT coalesce(r.gone, false)), '') AS text
  FROM left_over l LEFT JOIN ranked r ON r.doc_id = l.doc_id AND r.line_no = l.line_no AND r.part_no = 0
  GROUP BY l.doc_id
),
spans AS (
  SELECT doc_id, count(*) AS n, string_agg(begin_at || '-' || stop_at, ',' ORDER BY begin_at, stop_at) AS spans,
         array_to_string(list_sort(list_distinct(list(first_id))), ',') AS firsts
  FROM ranked WHERE gone GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, c.text AS text, coalesce(length(c.text), 0)::BIGINT AS n_chars, coalesce(s.n, 0)::BIGINT AS n_removed,
       coalesce(s.spans, '') AS removed_spans, coalesce(s.firsts, '') AS first_doc_ids
FROM documents d LEFT JOIN clean c USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""


SQL, SQL_ALL = _sql(MIN_RUN), _sql(0)
