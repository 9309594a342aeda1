"""Language identification by rank-order profiles (out-of-place distance).

``learn`` counts letter n-grams (1 to 3, words padded) of every training text and
keeps each language's ``PROFILE`` most frequent ones in order; ``predict`` ranks a
whole document's own most frequent n-grams and takes the language with the
smallest sum of rank differences (``PROFILE`` for an n-gram that the profile lacks).
Counts are summed per task, then by Spark, so no language meets in one task;
only ``PROFILE`` rows for each language reach the driver and the tasks.

The languages are the distinct values of ``lang``; more than ``LANGUAGES_MOST`` of them are an
error, since their profiles are gathered on the driver.

Ties between n-grams go to the smaller code, ties between languages to the first
by name.  Null texts and texts without a letter are ``und`` with score 0, and so is
everything if nothing was learned.  Null languages aren't learned.  Repeated rows
are predicted (and counted) as often as they occur; empty tables give no rows.  Other columns of
``predict``'s table are carried along; where it has a column named like a result, the result's name gets
underscores added until it is free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch, free_names, map_batches, table

PROFILE = 300
UNDECIDED = "und"
#: A documented bound on the languages that one set of profiles may have.
LANGUAGES_MOST = 10_000
FOLDS = 5
#: A document must be at least so close to a profile to be kept by ``keep_identified``.
LEAST_SCORE = 0.25
#: Texts are taken in parts of about so many characters.
PART_CHARS = 500_000
#: Distinct n-grams of a language that a task holds before it hands them on.
HELD = 500_000


class Folder:
    """Code points to letters: the lower-case code point, 0 for anything else."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.known[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                self.known[p] = min(ord(c.lower()[0]), 0xFFFF) if c.isalpha() else 0
            out = self.known[points]
        return out


def grams(letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams, n 1 to 3, that hold a letter and no gap inside; gaps count once."""
    f = np.zeros(len(letters) + 2, np.int64)
    f[1:-1] = letters
    f = f[(f != 0) | np.append(True, f[:-1] != 0)]
    one, two = f[f != 0], (f[:-1] << 16 | f[1:])[(f[:-1] != 0) | (f[1:] != 0)]
    a, b, c = f[:-2], f[1:-1], f[2:]
    inner = b != 0
    three = (a << 32 | b << 16 | c)[inner]
    return np.concatenate([one, two | 1 << 60, three | 2 << 60])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order."""
    found, n = np.unique(codes, return_counts=True)
    if len(found) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        some = n >= least
        found, n = found[some], n[some]
    return found[np.lexsort((found, -n))][:most]


def parts(texts: list[str | None]):
    """Index ranges of about PART_CHARS characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


COUNTS = "lang string, gram long, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the languages of ``docs`` (``text, lang``): at most ``profile`` codes each."""

    def run(batches):
        fold, held = Folder(), {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in parts(texts):
                by: dict[str, list[str]] = {}
                for t, lang in zip(texts[lo:hi], langs[lo:hi], strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    found, n = np.unique(grams(fold("\n".join(some))), return_counts=True)
                    if lang in held:
                        both = np.concatenate([held[lang][0], found])
                        counts = np.concatenate([held[lang][1], n])
                        found, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, counts).astype(np.int64)
                    held[lang] = (found, n)
                    if len(found) > HELD:
                        yield batch(_COUNTS, [lang] * len(found), *held.pop(lang))
        for lang, (found, n) in held.items():
            yield batch(_COUNTS, [lang] * len(found), found, n)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = map_batches(rows, run, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), F.col("gram"))
    # the best of each part first: a language's n-grams needn't meet in one task
    part = counts.withColumn("_salt", F.pmod(F.hash("gram"), F.lit(32))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    best = part.filter(F.col("_r") <= profile).withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_r") <= profile)
    if rows.select("lang").distinct().limit(LANGUAGES_MOST + 1).count() > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} languages")
    found: dict[str, list] = {}
    for r in sorted(best.select("lang", "gram", "_r").collect(), key=lambda r: (r["lang"], r["_r"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(codes, np.int64) for lang, codes in found.items()}


class Profiles:
    """Out-of-place distances of a ranking to each profile."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size, self.sorted = sorted(profiles), size, []
        for lang in self.langs:
            order = np.argsort(profiles[lang])
            self.sorted.append((profiles[lang][order], order))

    def nearest(self, ranking: np.ndarray) -> tuple[str, float]:
        if not len(ranking) or not self.langs:
            return UNDECIDED, 0.0
        place, sums = np.arange(len(ranking)), []
        for codes, rank in self.sorted:
            at = np.minimum(np.searchsorted(codes, ranking), len(codes) - 1)
            hit = codes[at] == ranking
            sums.append(int(np.where(hit, np.abs(rank[at] - place), self.size).sum()))
        best = int(np.argmin(sums))
        return self.langs[best], max(0.0, 1.0 - sums[best] / (self.size * len(ranking)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``text`` alone decides."""
    names = docs.columns
    out = free_names(names, *out)
    fields = [f for f in docs.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{out[0]} string", f"{out[1]} double"])
    at = names.index("text")

    def run(batches):
        fold, table_ = Folder(), Profiles(profiles, size)
        for b in batches:
            texts, langs, scores = b.column(at).to_pylist(), [], []
            for lo, hi in parts(texts):
                some = [t or "" for t in texts[lo:hi]]
                letters, begin = fold("".join(some)), 0
                for t in some:
                    own = letters[begin : begin + len(t)]
                    begin += len(t)
                    lang, score = table_.nearest(ranked(grams(own), size)) if own.any() else (UNDECIDED, 0.0)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, *out])

    return map_batches(docs, run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages with a score of ``least``."""
    learned = learn(docs.filter(~held_out(F.col("doc_id"))))
    told = predict(docs, learned, out=("_lang_pred", "_score"))
    return told.filter((F.col("_lang_pred") != UNDECIDED) & (F.col("_score") >= least)).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn(docs.filter(~held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(slim, learned).drop("text")
