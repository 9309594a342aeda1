"""Bounded things that are sent to every task: a bitmap of ids, and the most frequent keys of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

#: A bitmap has about 16 bits for each id, and at most 2 ** 27 bits (16 MB) whatever their number.
BITMAP_MOST = 27


def bits_for(n: int) -> int:
    return min(BITMAP_MOST, max(10, (16 * n).bit_length()))


def frequent(rows: DataFrame, count: str, most: int) -> int:
    """The least value of ``count`` such that at most ``most`` rows have it or more.

    Only a histogram by steps of an eighth of a doubling reaches the driver, whatever the number of rows."""
    step = F.floor(8 * F.log2(F.col(count).cast("double"))).cast("int")
    held, least = 0, None
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least if least is not None else (1 << 62)


class IdBitmap:
    """A filter that may pass too much and never too little: ids beyond what its bits tell apart all pass."""

    def __init__(self, words: np.ndarray, bits: int, spark):
        self.shared, self.bits = spark.sparkContext.broadcast(words), bits

    @classmethod
    def of(cls, ids: DataFrame, column: str, hashed: bool = False) -> IdBitmap:
        """``hashed``: the ids are hashes, tested by ``has``.  At most ``2 ** (BITMAP_MOST - 6)`` words reach the driver."""
        bits = bits_for(ids.count())
        slot = F.col(column).bitwiseAND((1 << bits) - 1) if hashed else F.pmod(F.xxhash64(column), F.lit(1 << bits))
        words = ids.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("1L").alias("one"), slot.bitwiseAND(63).cast("int").alias("b"))
        found = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("b"))).alias("v")).toArrow()
        out = np.zeros(1 << (bits - 6), np.int64)
        out[found.column("w").to_numpy()] = found.column("v").to_numpy()
        return cls(out, bits, ids.sparkSession)

    def has(self, hashed_id: int) -> bool:
        slot = hashed_id & ((1 << self.bits) - 1)
        return bool(int(self.shared.value[slot >> 6]) >> (slot & 63) & 1)

    def has_all(self, hashed_ids: np.ndarray) -> np.ndarray:
        return self.test(hashed_ids.view(np.int64) & ((1 << self.bits) - 1))

    def test(self, slots: np.ndarray) -> np.ndarray:
        words = self.shared.value
        return (words[slots >> 6] >> (slots & 63) & 1).astype(bool)

    def filter(self, df: DataFrame, column: str, inside: bool = True, unless: IdBitmap | None = None) -> DataFrame:
        """The rows of ``df`` whose id may be in the bitmap, or else those whose id isn't; none whose id may be in ``unless``."""
        test, other, names = self.test, unless and unless.test, df.columns

        def run(batches):
            for b in batches:
                hit = test(b.column(len(names)).to_numpy()) == inside
                if other:
                    hit &= ~other(b.column(len(names) + 1).to_numpy())
                yield b.select(names).filter(pa.array(hit))

        slots = {name: F.pmod(F.xxhash64(column), F.lit(1 << x.bits)) for name, x in (("_slot", self), ("_other", unless)) if x}
        return map_batches(df.withColumns(slots), run, df.schema)
