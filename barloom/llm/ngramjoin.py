"""N-gram Jaccard join: an exact, size-aware join of documents' word-shingle sets.

Two documents link when ``100 * |A & B| >= percent * |A | B|``.  The join is made in
five steps.

1. ``describe``: every text's set of 64-bit shingle hashes, as its size, its digest and
   a parity sketch; documents with equal sets are one class from here on.  The tokens
   that many documents hold (``heavy``, at most ``HEAVY_MOST`` of them, by a threshold on their count) come last in
   the global token order, all others in the order of their hash.
2. Keys.  Two linked sets share at least ``c`` of the first
   ``n - ceil(percent * n / 100) + c`` tokens of each, for any global order.  A *light* set
   (``n <= boundary``) enumerates the 2-subsets of that prefix for ``c = 2``; a *heavy* one
   posts each token of the prefix for ``c = 1`` into inverted lists, and so do the
   light sets large enough to meet a heavy one.  ``boundary`` minimises the
   expected number of keys and list entries over the sizes that occur.
3. Each list is a star: its members are paired with a pivot (of four pivots, by key),
   never with each other.  Half of the pivots are the sets of the largest share of
   heavy tokens: of a group of edited copies that is the text they were made from.
   Pairs whose parity sketches differ in too many bits can't link (exact bound); the others
   are verified on their whole sets.
4. What is outside a list's largest component then is paired with members of other
   components, if the places of the shared key in both orders leave room for enough
   overlap (exact bound: all common tokens come at or after the first), checked by sketch and
   verified.  Before it meets anything, a member must leave room for a set as large as itself to be
   the smaller side of a pair, and it meets only members whose size is in a bucket that can link: sets that
   share a template but not the needed part of it form no pairs.  Pairs inside a component can't change the result and aren't made.
5. Components of the verified links; the smallest doc_id of each.

Lists of heavy tokens are dealt by ``(key, salt)``, in as many parts as the most frequent needs; all others are shorter
than the least of these.  Copies are dropped within each task before the shuffle, and meet only in aggregations
that combine first.  The bitmap that picks the sets to verify is sized by their number, up to a bound.

Words are lower-cased (A-Z) runs of bytes other than ASCII white space; a text of fewer than
``shingle`` words is one shingle; null texts and texts without words have no set and
link with nothing.  Rows that repeat a text link fully.  A null doc_id takes part like any
other (the smallest id of a component is the smallest that isn't null, null if there is
none).  An empty table gives no rows; other columns are ignored.  Sets are told apart by 128 bits: by 64, and by the other
64 where two sets have the same 64 (``collided``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, batch, map_batches, table
from .components import components
from .hashing import MIX, finish, pair_hashes, token_parts
from .hashing import U as _U
from .sketches import IdBitmap, frequent

SHINGLE = 5
PERCENT = 80
#: A token is heavy if about so many documents hold it; only the most frequent are.
HEAVY_DOCS = 16
HEAVY_MOST = 1 << 18
#: Counted in a task only if so many of its texts hold the token.
LOCAL_LEAST = 3
#: A task's table of tokens seen once has 2 ** 24 slots; counted tokens are buffered up to so many.
SEEN_BITS = 24
BUFFERED = 1_000_000
#: A heavy list is dealt in parts of about so many members.
PART = 50_000
#: Collisions of 64-bit digests that are sent to every task, at most.
COLLIDED_MOST = 1 << 20
PIVOTS = 4
#: Sizes up to which enumerating subsets is considered.
LIGHT_MOST = 128
#: Digests that a task remembers to drop copies.
REMEMBERED = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """``(row, sorted distinct hashes)`` of every text of a string column that has words."""
    for lo, words, bounds in token_parts(column, _WORD, _LOWER):
        if len(words) >= shingle:
            last = len(words) - shingle + 1
            mixed = np.zeros(last, _U)
            for k in range(shingle):
                mixed += words[k : k + last] * _U(int(MIX[k % 5]) * (2 * k + 1) % (1 << 64))
            mixed = finish(mixed)
        for row in range(len(bounds) - 1):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a >= shingle:
                found = np.sort(mixed[a : b - shingle + 1])
                yield lo + row, found[np.append(True, found[1:] != found[:-1])]
            elif b > a:
                yield lo + row, np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], _U)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens in each of 2 ** k >= n bits."""
    bits = max(64, 1 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the sets; the longer sketch is folded."""
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while size > 8 * min(len(a), len(b)):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ y).bit_count()


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with a set it links to."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int, c: int = 1) -> int:
    return min(n, n - needed(n, percent) + c)


DESCRIBED = "kind int, id long, t long, n long, c long, c2 long, sketch binary"
_DESCRIBED = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("sketch", pa.binary())])


def digests(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two halves of a set's 128-bit digest, as signed numbers; fewer bits of the first for tests."""
    whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
    first = whole & ((1 << bits) - 1)
    return first - (1 << 64) if first >= 1 << 63 else first, (whole >> 64) - (1 << 63)


class Naming:
    """The class of a set: the first half of its digest, or the second where two sets share the first."""

    def __init__(self, collided: frozenset[int] = frozenset(), bits: int = 64):
        self.collided, self.bits = collided, bits

    def __call__(self, tokens: np.ndarray) -> int:
        first, second = digests(tokens, self.bits)
        return second if first in self.collided else first


class TokenCounter:
    """Counts tokens from their second text in a task on, in bounded memory: the first
    time only marks a slot of a table, so a count may be too high and never too low by more than one."""

    def __init__(self):
        self.seen, self.again, self.size = np.zeros(1 << SEEN_BITS, bool), [], 0

    def add(self, tokens: np.ndarray) -> None:
        slots = (tokens >> _U(64 - SEEN_BITS)).astype(np.int64)
        known = tokens[self.seen[slots]]
        self.seen[slots] = True
        self.again.append(known)
        self.size += len(known)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of LOCAL_LEAST texts or more since the last flush, with the number of texts."""
        tokens, n = np.unique(np.concatenate(self.again) if self.again else np.zeros(0, _U), return_counts=True)
        self.again, self.size = [], 0
        often = n >= LOCAL_LEAST - 1
        return tokens[often], n[often] + 1


def describe(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64) -> DataFrame:
    """Kind 0: a document's id, text hash, set size, class and sketch; kind 1: a token (``c``) and in how many texts of a task it is (``n``)."""

    def run(batches):
        counter = TokenCounter()

        def counted():
            tokens, n = counter.flush()
            return batch(_DESCRIBED, [1] * len(n), [None] * len(n), [None] * len(n), n, tokens.view(np.int64), [None] * len(n), [None] * len(n))

        for b in batches:
            ids, hashes, rows = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for row, tokens in shingle_sets(b.column(1), shingle):
                rows.append((row, len(tokens), *digests(tokens, bits), parity_sketch(tokens)))
                counter.add(tokens)
                if counter.size >= BUFFERED:
                    yield counted()
            without = set(range(b.num_rows)).difference(r[0] for r in rows)
            rows += [(r, 0, None, None, None) for r in without]
            yield batch(_DESCRIBED, [0] * len(rows), [ids[r[0]] for r in rows], [hashes[r[0]] for r in rows], *([r[i] for r in rows] for i in (1, 2, 3, 4)))
        yield counted()

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text")), run, DESCRIBED)


def keyless(n: int, percent: int) -> bool:
    """Whether a set of ``n`` links with none but its equals, which are its class."""
    return prefix_size(n, percent) == 1 and needed(n, percent) == n and 100 * n // percent == n


def choose_boundary(sizes: dict[int, int], entries: float, percent: int = PERCENT, most: int = LIGHT_MOST) -> int:
    """The set size up to which enumerating 2-subsets costs less than scanning lists.

    ``sizes`` counts the classes of each size (those over ``most`` cost the same
    either way); ``entries`` is the expected length of an inverted list, each of whose members
    a posted token may meet.  Two shared tokens are taken to be a link, which is verified either way."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if keyless(n, percent):
                continue
            p2 = prefix_size(n, percent, 2)
            if n <= boundary:
                total += count * p2 * (p2 - 1) / 2
            if n > boundary or 100 * n // percent > boundary:
                total += count * prefix_size(n, percent) * (1 + entries)
        return total

    return min(range(most + 1), key=lambda b: (cost(b), b))


#: ``info`` holds a set's size (24 bits and more), a key's place (24), a rank (10) and the heavy flag (1).
KEYS = "key long, c long, info long"
_KEYS = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("info", pa.int64())])
_PLACE_MOST = (1 << 24) - 1


def packed(n: int, places: np.ndarray, heavy: np.ndarray, rank: int) -> np.ndarray:
    """Places beyond the field count as 0, which only widens the room that a pair has."""
    places = np.where(places > _PLACE_MOST, 0, places).astype(np.int64)
    return np.int64(n) << 35 | places << 11 | np.int64(rank << 1) | heavy.astype(np.int64)


def info_fields() -> dict:
    info = F.col("info")
    return {"n": F.shiftright(info, 35).cast("int"), "at": F.shiftright(info, 11).bitwiseAND(_PLACE_MOST).cast("int"), "rank": F.shiftright(info, 1).bitwiseAND(1023).cast("int"), "heavy": info.bitwiseAND(1) == 1}


class KeyMaker:
    """The keys of a set in the order of rare tokens first."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, boundary: int, percent: int):
        order = np.argsort(heavy)
        self.heavy, self.counts, self.boundary, self.percent = heavy[order], counts[order], boundary, percent

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Keys, the place of each key's first token, whether its list may be long, and the share of
        tokens that aren't heavy in thousandths."""
        n, percent = len(tokens), self.percent
        if keyless(n, percent):
            return tokens[:0], np.zeros(0, np.int64), np.zeros(0, bool), 0
        size = prefix_size(n, percent, 2)
        hit = np.zeros(n, bool)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, tokens), len(self.heavy) - 1)
            hit = self.heavy[at] == tokens
        if hit.any():
            rare, often = tokens[~hit], tokens[hit]
            often = often[np.lexsort((often, self.counts[at[hit]]))]
            first = np.concatenate([rare, often])[:size]
            is_heavy = np.arange(len(first)) >= len(rare)
        else:
            first, is_heavy = tokens[:size], np.zeros(min(n, size), bool)
        keys, places, flags = [], [], []
        if n <= self.boundary:
            a, b = np.triu_indices(len(first), 1)
            keys.append(pair_hashes(np.minimum(first[a], first[b]), np.maximum(first[a], first[b])))
            places.append(a)
            flags.append(is_heavy[a] & is_heavy[b])
        if n > self.boundary or 100 * n // percent > self.boundary:
            single = prefix_size(n, percent)
            keys.append(first[:single])
            places.append(np.arange(single))
            flags.append(is_heavy[:single])
        return np.concatenate(keys), np.concatenate(places), np.concatenate(flags), 1000 - 1000 * int(hit.sum()) // n


def post_keys(spark: SparkSession, docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, boundary: int, percent: int = PERCENT, shingle: int = SHINGLE, name: Naming = Naming()) -> DataFrame:
    """``key, c, heavy``: every class's keys, once a task."""
    shared = spark.sparkContext.broadcast((heavy, counts))

    def run(batches):
        make, seen = KeyMaker(*shared.value, boundary, percent), set()
        for b in batches:
            keys, classes, infos, held = [], [], [], 0
            for _, tokens in shingle_sets(b.column(1), shingle):
                c = name(tokens)
                if c in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                found, places, heavy_, rank = make(tokens)
                keys.append(found)
                classes.append(np.full(len(found), c, np.int64))
                infos.append(packed(len(tokens), places, heavy_, rank))
                held += len(found)
                if held > 100_000:
                    yield batch(_KEYS, np.concatenate(keys).view(np.int64), np.concatenate(classes), np.concatenate(infos))
                    keys, classes, infos, held = [], [], [], 0
            if held:
                yield batch(_KEYS, np.concatenate(keys).view(np.int64), np.concatenate(classes), np.concatenate(infos))

    return map_batches(docs, run, KEYS)


def lists(keys: DataFrame, salts: int = 1) -> DataFrame:
    """``key, c, pivot`` of every list that holds two classes.

    One shuffle, by ``(key, salt)``: a rare token's list is whole in one task; a heavy
    one's is in up to ``salts`` parts, whose pivots then meet in an aggregation."""
    fields = info_fields()
    salt = F.when(fields["heavy"], F.pmod(F.hash("c"), F.lit(salts))).otherwise(0)
    dealt = keys.withColumn("salt", salt).repartition("key", "salt")
    pivot = F.pmod("key", F.lit(PIVOTS))
    order = F.struct(F.when(pivot < PIVOTS // 2, fields["rank"]).otherwise(0).alias("r"), F.xxhash64("c", pivot).alias("o"), F.col("c").alias("c"))
    own = Window.partitionBy("key", "salt")
    dealt = dealt.withColumn("first", F.min(order).over(own)).withColumn("last", F.max(order).over(own))
    kept = dealt.withColumns({k: fields[k] for k in ("n", "at", "heavy")}).filter("heavy OR first <> last")
    return kept.select("key", "c", "n", "at", "heavy", "first", "last")


def heavy_pivots(members: DataFrame) -> DataFrame:
    """``key, pivot`` of the heavy lists that hold two classes: one pivot from those of a list's parts."""
    return members.filter("heavy").groupBy("key").agg(F.min("first").alias("f"), F.max("last").alias("l")).filter("f <> l").select("key", F.col("f.c").alias("pivot"))


def with_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """``key, c, n, at, pivot`` of every member of a list that holds two classes."""
    heavy = members.filter("heavy").select("key", "c", "n", "at").join(pivots, "key")
    return members.filter("NOT heavy").select("key", "c", "n", "at", F.col("first.c").alias("pivot")).unionByName(heavy).distinct()


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def possible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that sizes and sketches allow to link, with their sizes (``na``, ``nb``)."""

    def side(x):
        return classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            apart = np.fromiter((sketch_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())), np.int64, b.num_rows)
            yield b.select([0, 1, 2, 3]).filter(pa.array((100 + percent) * apart <= (100 - percent) * (na + nb)))

    return map_batches(near.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long, na long, nb long")


SETS = "c long, tokens array<bigint>"
_SETS = pa.schema([("c", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE, name: Naming = Naming()) -> DataFrame:
    """``c, tokens`` of (at least) the wanted classes, read from the texts again."""
    bitmap = IdBitmap.of(wanted, "c", hashed=True)

    def run(batches):
        seen = set()
        for b in batches:
            out, sets = [], []
            for _, tokens in shingle_sets(b.column(1), shingle):
                c = name(tokens)
                if c in seen or not bitmap.has(c):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                out.append(c)
                sets.append(tokens.view(np.int64))
                if len(out) == 256:
                    yield _set_batch(out, sets)
                    out, sets = [], []
            if out:
                yield _set_batch(out, sets)

    return map_batches(docs, run, SETS).join(wanted, "c", "left_semi")


def _set_batch(classes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
    return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), tokens], schema=_SETS)


def verified(scratch: Scratch, name: str, docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, naming: Naming = Naming()) -> DataFrame:
    """The pairs (``a, b``) that link, on their whole sets."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    sets = scratch.keep(sets_of(docs, wanted, shingle, naming).dropDuplicates(["c"]), f"{name}-sets")
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b")
    found = both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")
    found = scratch.keep(found, f"{name}-links")
    scratch.drop(f"{name}-sets")
    return found


def size_bucket(n):
    """Grows with the size, by one for each factor of 1.25."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int")


def across(rest: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``ca, cb`` of every two members (``key, most, c, g, n, at``) of a list, of different components not both of
    which are ``most``, whose sizes and places allow a link."""
    room = F.col("n") - F.col("at")
    # of a pair, the smaller side has room for an overlap with a set as large as itself
    small = rest.filter((100 + percent) * room >= 2 * percent * F.col("n"))
    largest = F.floor(100 * F.col("n") / percent).cast("int")
    small = small.withColumn("bucket", F.explode(F.sequence(size_bucket(F.col("n")), size_bucket(largest))))
    large = rest.withColumn("bucket", size_bucket(F.col("n")))
    a, b = (x.select("key", "bucket", *([] if y == "b" else ["most"]), *(F.col(k).alias(k + y) for k in ("c", "g", "n", "at"))) for x, y in ((small, "a"), (large, "b")))
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    fits = (F.col("na") <= F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na")) & (F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= least)
    return a.join(b, ["key", "bucket"]).filter((F.col("ga") != F.col("gb")) & ((F.col("ga") != F.col("most")) | (F.col("gb") != F.col("most"))) & fits)


def join_components(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, class_bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "ngramjoin")
    described = scratch.keep(describe(docs, shingle, class_bits), "described")
    sets = described.filter("kind = 0 AND n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("c2").alias("lo"), F.max("c2").alias("hi"))
    classes = scratch.keep(sets, "classes")
    collided = [r["c"] for r in classes.filter("lo <> hi").select("c").limit(COLLIDED_MOST + 1).collect()]
    if len(collided) > COLLIDED_MOST:
        raise ValueError(f"more than {COLLIDED_MOST} collisions of digests")
    named, rows = Naming(frozenset(collided), class_bits), described.filter("kind = 0")
    if collided:
        apart = F.broadcast(classes.filter("lo <> hi").select(F.col("c").alias("_c"), F.lit(True).alias("_apart")))
        rows = rows.join(apart, rows["c"] == F.col("_c"), "left").withColumn("c", F.when(F.col("_apart"), F.col("c2")).otherwise(F.col("c")))
        classes = scratch.keep(rows.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes-apart")
    rows = rows.select(F.col("id").alias("doc_id"), "t", "n", "c")

    # at most HEAVY_MOST tokens and LIGHT_MOST + 1 sizes reach the driver
    tokens = scratch.keep(described.filter("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_DOCS), "tokens")
    top = tokens.filter(F.col("n") >= frequent(tokens, "n", HEAVY_MOST)).toArrow()
    heavy, counts = top.column("c").to_numpy().view(_U), top.column("n").to_numpy()
    sizes = {r["s"]: r["k"] for r in classes.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("s")).agg(F.count("*").alias("k")).collect()}
    total = described.filter("kind = 0").agg(F.sum("n").alias("t")).first()["t"] or 1
    boundary = choose_boundary(sizes, float((counts.astype(float) ** 2).sum()) / total, percent)
    salts = 1 + int(counts.max(initial=0)) // PART

    members = scratch.keep(lists(post_keys(spark, docs, heavy, counts, boundary, percent, shingle, named), salts), "members")
    # aggregates are written before they are joined back: an exchange on both sides lets Spark split a hot list
    pivots = scratch.keep(heavy_pivots(members), "pivots")
    members = scratch.keep(with_pivots(members, pivots), "lists")
    scratch.drop("members")
    stars = possible(ordered_pairs(members, "c", "pivot"), classes, percent)
    links = verified(scratch, "stars", docs, stars, percent, shingle, named)
    label = components(links, scratch, "star-components").withColumnRenamed("component", "g")

    # lists that still hold two components: those outside the largest one meet all others
    labelled = members.join(label.withColumnRenamed("id", "c"), "c", "left").select("key", "c", "n", "at", F.coalesce("g", "c").alias("g"))
    held = labelled.groupBy("key", "g").agg(F.count("*").alias("k"))
    split = held.groupBy("key").agg(F.max(F.struct("k", "g")).alias("m"), F.count("*").alias("gs")).filter("gs > 1").select("key", F.col("m.g").alias("most"))
    split = scratch.keep(split, "split")
    rest = scratch.keep(labelled.join(split, "key"), "rest")
    cross = across(rest, percent)
    pairs = possible(ordered_pairs(cross, "ca", "cb"), classes, percent).join(scratch.spark.read.parquet(scratch.path("stars-pairs")).select("a", "b"), ["a", "b"], "left_anti")
    more = verified(scratch, "rest", docs, pairs, percent, shingle, named)
    label = components(links.unionByName(more), scratch, "components").withColumnRenamed("component", "g")

    grouped = rows.join(label, rows["c"] == label["id"], "left").select("doc_id", "t", "n", F.coalesce("g", "c").alias("g"))
    grouped = scratch.keep(grouped, "grouped")
    # written, so that the join below has an exchange on both sides and Spark can split a large component
    first = scratch.keep(grouped.filter("g IS NOT NULL").groupBy("g").agg(F.min("doc_id").alias("component_id")), "first")
    return grouped.join(first, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("t").alias("text_hash"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, once each.

    Only rows whose id a bitmap of the removed (and the repeated) ids may hold are
    shuffled; all others stay where they are."""
    scratch = Scratch(spark, "representatives")
    rows = scratch.keep(join_components(spark, docs, percent, shingle).select("doc_id", "text_hash", "component_id"), "rows")
    key = [F.col("doc_id").alias("_k"), F.col("text_hash").alias("_t")]
    gone = rows.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_k"))
    bitmap = IdBitmap.of(gone.select("_k").unionByName(twice).distinct(), "_k")
    hashed = F.xxhash64(F.col("text").cast("string"))
    doubtful = bitmap.filter(docs, "doc_id").withColumn("_h", hashed)
    doubtful = doubtful.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_k")) & F.col("_h").eqNullSafe(F.col("_t")), "left_anti").dropDuplicates(["doc_id", "_h"])
    return bitmap.filter(docs, "doc_id", inside=False).unionByName(doubtful.drop("_h"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark, table(spark, sf_dir, "documents")).drop("text_hash")


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
                                 WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) AS sh
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.to_id
)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
