"""Best-fit packing planned over a histogram of lengths.

``cut_pieces`` tokenises every text once and keeps only numbers: each document
becomes its pieces (at most ``capacity`` tokens; only a longer document is cut,
and its first piece is the short one).  ``plan_best_fit`` runs best-fit
decreasing over the *counts per length* (at most ``capacity`` rows on the
driver, whatever the corpus), and returns runs of slots.  ``assign`` ranks the
pieces within their length and joins each rank to its planned slot.

A length may hold any share of all pieces: ranks are taken per
``(length, salt)`` and shifted by the sizes of the lower salts, with as many salts as
each length needs for parts of PART_PIECES, so no task gets a whole length.  Null and empty texts are documents of the single end token;
repeated rows are packed as often as they occur; ties between equal lengths are
broken by ``(doc_id, piece)``; an empty table packs to no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, batch, map_batches, table

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Ranks within a length are taken in independent parts of about so many pieces.
PART_PIECES = 1_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Token ids of whole texts, as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Texts of characters on which the Unicode tables of both libraries agree (``PLAIN``:
    ASCII and the Latin blocks) go to ``tiktoken``, loaded with the very vocabulary of the
    tokenizer file, which is several times faster; all others go to ``tokenizers``.
    Strings of added tokens in a text are those tokens, as the library has it by default:
    texts that hold one go to ``tokenizers``.
    """

    PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u20ac]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, special))) if special else None
        byte_of = self._bytes(ByteLevel.alphabet())
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes(alphabet: list[str]) -> dict[str, int]:
        """The byte that each character of a byte-level token stands for: printable ones
        stand for themselves, the rest are numbered from 256."""
        own = {c: ord(c) for c in alphabet if ord(c) < 256}
        rest = [b for b in range(256) if chr(b) not in own]
        return own | {chr(256 + k): b for k, b in enumerate(rest)}

    def ids(self, text: str) -> np.ndarray:
        if (text.isascii() and text.isprintable() or self.PLAIN.fullmatch(text)) and not (self.added and self.added.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = encoder(path).ids
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out = ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = encode(text or "").astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        for column, v in zip(out, (doc, k, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]))):
                            column.append(v)
                yield batch(_PIECES, *out)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs ``(length, rank_lo, rank_hi, seq_lo, per_seq, offset)``.

    Rank ``r`` of a run lies in sequence ``seq_lo + (r - rank_lo) // per_seq`` at
    ``offset + (r - rank_lo) % per_seq * length``.  Sequences that are equally
    full are one interval, so the work follows the number of lengths, not of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit into {capacity}")
        while left:
            free = next((r for r in range(length, capacity) if room[r]), capacity)
            fit = free // length
            if free < capacity:
                lo, hi = room[free].pop()
            else:
                lo = sequences
                hi = sequences = lo + -(-left // fit)
            whole = min(hi - lo, left // fit)
            if whole:
                runs.append((length, rank, rank + whole * fit, lo, fit, capacity - free))
                room[free - fit * length].append((lo, lo + whole))
                rank, left, lo = rank + whole * fit, left - whole * fit, lo + whole
            if lo < hi and left and left < fit:
                runs.append((length, rank, rank + left, lo, left, capacity - free))
                room[free - left * length].append((lo, lo + 1))
                lo, left = lo + 1, 0
            if lo < hi:
                room[free].append((lo, hi))
    return runs


def assign(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, part: int = PART_PIECES) -> DataFrame:
    """``pieces`` (read three times) with ``sequence_id`` and ``offset``."""
    # one row per length, at most `capacity`
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_best_fit(histogram, capacity)
    # at most `capacity` numbers
    salts = F.element_at(F.array(*(F.lit(1 + histogram.get(n, 0) // part) for n in range(1, capacity + 1))), F.col("length").cast("int"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    lowered = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"))
    # sent to every task: a run ends a length, a room or an interval of sequences, of which there are at most
    # two for each length and room, so the capacity alone bounds it
    if len(runs) > 2 * capacity * (capacity + 1):
        raise ValueError(f"a plan of {len(runs)} runs is beyond its bound")
    plan = spark.createDataFrame(runs, "length long, _lo long, _hi long, _seq long, _per long, _at long")
    ranked = salted.join(lowered, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    slot = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["_rank"] >= plan["_lo"]) & (ranked["_rank"] < plan["_hi"])).drop(plan["length"])
    step = F.col("_rank") - F.col("_lo")
    return slot.select(
        *pieces.columns,
        (F.col("_seq") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + step % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces, each with its place in a sequence of at most ``capacity`` tokens."""
    scratch = Scratch(spark, "packing")
    return assign(spark, scratch.keep(cut_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
