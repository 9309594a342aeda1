"""Embedding near-duplicates over an inverted multi-index.

Vectors are compared only within a label, by cosine in double precision.  Equal vectors
are one class first.  The two halves of the normalised vectors have a codebook each
(k-means on a bounded sample, with a number of centroids that grows with the vectors); a vector lies in the
cell of the product grid that its nearest pair of centroids names.  A query traverses the cells by the multi-sequence
algorithm, nearest first, by a lower bound of its squared distance to them (the sum of the halves' distances to the Voronoi
borders), until the bound exceeds a stop that ``calibrate`` sets for a target recall; every vector in a visited cell
is then verified.

Rows are keyed by label and cell.  Each vector lies once in its own cell and travels once to each visited cell that
comes after it, so a pair meets at most once.  Cells are runs of rows sorted within a partition, a stream of batches; a cell of more
than ``BLOCK`` rows is cut into blocks on either side, so a hot cell is many tasks' work.  A block returns, for each vector,
how many vectors it links to there, and a spanning forest of its links rather than the links.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing.  Vectors of different lengths don't link.  A null vec_id takes part;
repeated rows are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, map_batches, table
from .components import components

COSINE = 0.98
#: Vectors of a length that the codebooks and the stop are fitted on, at most.
SAMPLE = 32_768
RECALL = 0.9999
BLOCK = 2048
#: Vectors of a label that a cell holds on average, so long as a centroid has this many of the sample.
OCCUPANCY, SAMPLE_EACH = 64, 8
#: Hot cells that are sent to every task (their number is checked); more are joined by a shuffle.
HOT_MOST = 100_000
#: Lengths of vectors that one run takes, each with an index of its own.
LENGTHS_MOST = 1000


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids).argmin(1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(0)
    return centroids


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class MultiIndex:
    """Two codebooks and the stop, for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float = COSINE, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(h, k) for h in self.halves(sample)]
        self.gaps = []
        for book in self.books:
            gap = np.sqrt(np.maximum(0, nearest(book, book)))
            gap[gap < 1e-9] = np.inf
            self.gaps.append(gap)
        self.cosine = cosine
        self.stop = self.calibrate(sample, recall)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [nearest(h, book).argmin(1) for h, book in zip(self.halves(x), self.books, strict=True)]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Lower bounds of the squared distance of each half to each centroid's Voronoi cell."""
        out = []
        for h, book, gap in zip(self.halves(x), self.books, self.gaps, strict=True):
            d = nearest(h, book)
            own = d.argmin(1)
            out.append((np.maximum(0, d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])) ** 2)
        return out

    def calibrate(self, sample: np.ndarray, recall: float) -> float:
        """The bound to stop at: the quantile, over sampled vectors moved in a random direction to the
        very threshold, of the bound of the cell they land in; never more than the threshold's own distance,
        at which the traversal is exact."""
        rng, most = np.random.default_rng(11), 2 - 2 * self.cosine
        found = []
        for _ in range(4):
            away = rng.standard_normal(sample.shape)
            away -= (away * sample).sum(1)[:, None] * sample
            size = np.sqrt((away * away).sum(1))[:, None]
            moved = self.cosine * sample + np.sqrt(1 - self.cosine**2) * np.where(size > 0, away / np.where(size > 0, size, 1), 0)
            (a, b), (l1, l2), at = self.cells(moved), self.bounds(sample), np.arange(len(sample))
            found.append(l1[at, a] + l2[at, b])
        return float(min(most, np.quantile(np.concatenate(found), recall) * 1.2)) + 1e-12

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(row, cell)`` of every cell that a row visits."""
        size = len(self.books[1])
        for row, (a, b) in enumerate(zip(*self.bounds(x))):
            for i, j in multi_sequence(a, b, self.stop):
                yield row, i * size + j

    def own(self, x: np.ndarray) -> np.ndarray:
        first, second = self.cells(x)
        return first * len(self.books[1]) + second


def multi_sequence(a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """The pairs ``(i, j)`` with ``a[i] + b[j] <= stop``, smallest sums first, each once."""
    first, second = (h[np.argsort(x[h], kind="stable")] for x, h in ((a, np.flatnonzero(a <= stop)), (b, np.flatnonzero(b <= stop))))
    x, y, first, second = a[first].tolist(), b[second].tolist(), first.tolist(), second.tolist()
    ahead = [(x[0] + y[0], 0, 0)] if x and y else []
    while ahead and ahead[0][0] <= stop:
        _, i, j = heappop(ahead)
        yield first[i], second[j]
        if j + 1 < len(y):
            heappush(ahead, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heappush(ahead, (x[i + 1] + y[0], i + 1, 0))


def link_block(queries: np.ndarray, q_ids: np.ndarray, q_copies: np.ndarray, foreign: np.ndarray, data: np.ndarray, d_ids: np.ndarray, d_copies: np.ndarray, cosine: float = COSINE):
    """``(ids, links of each, spanning forest of the links as pairs of ids)``.

    Links count for the queries, and also for the data where the query is ``foreign`` (it meets them only here)."""
    q_norm, d_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((data * data).sum(1))
    linked = (queries @ data.T / np.outer(q_norm, d_norm) >= cosine) & (q_ids[:, None] != d_ids[None])
    ids, n = np.concatenate([q_ids, d_ids]), np.concatenate([linked @ d_copies, q_copies[foreign] @ linked[foreign]])
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return ids[:0], n[:0], np.zeros((0, 2), np.int64)
    linked = linked[np.ix_(rows, columns)]
    a, b = q_ids[rows].copy(), d_ids[columns].copy()
    most = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(linked, b[None], most).min(1))
        b2 = np.minimum(b, np.where(linked, a2[:, None], most).min(0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    pairs = np.concatenate([np.stack([q_ids[rows], a], 1), np.stack([d_ids[columns], b], 1)])
    return ids[n > 0], n[n > 0], np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def classes(vectors: DataFrame) -> DataFrame:
    """``label, embedding, id, copies``: distinct usable vectors of a label, the smallest vec_id and how many rows."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.coalesce(usable, F.lit(False)) & F.col("label").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))


#: ``foreign``: a query from another cell.
PLACED = "dim int, label string, cell long, foreign boolean, id long, copies long, embedding array<{}>"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def placed(spark: SparkSession, found: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """Every vector in its own cell, and as a foreign query in each cell it visits that comes after that."""
    shared = spark.sparkContext.broadcast(indexes)

    def run(batches):
        for b in batches:
            dims = b.column(3).value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                index = shared.value[dim]
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x = normalised(matrix(some.column(3), dim))
                    own = index.own(x)
                    visits = np.array([(r, c) for r, c in index.visits(x) if c > own[r]], np.int64).reshape(-1, 2)
                    for pick, cells, foreign in ((np.arange(len(x)), own, False), (visits[:, 0], visits[:, 1], True)):
                        for lo in range(0, len(pick), 4096):
                            take = some.take(pa.array(pick[lo : lo + 4096]))
                            n = take.num_rows
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), take.column(0), pa.array(cells[lo : lo + n].astype(np.int64)), pa.array(np.full(n, foreign)), *take.columns[1:]], names=["dim", "label", "cell", "foreign", "id", "copies", "embedding"])

    kind = found.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    return map_batches(found.select(F.col("label").cast("string"), "id", "copies", F.col("embedding").cast(f"array<{kind}>")), run, PLACED.format(kind))


LINKED = "a long, b long, n long"
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
DATA, OWN, FOREIGN, BOTH = range(4)


def linked(rows: DataFrame, scratch: Scratch, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(a, null, n)``: a vector's links in a block; ``(a, b, null)``: a link, or a step of a spanning forest."""
    key = ["dim", "label", "cell"]
    sizes = rows.groupBy(*key).agg(F.sum((~F.col("foreign")).cast("long")).alias("own"), F.count("*").alias("all")).filter((F.col("own") > 0) & (F.col("all") > block))
    hot = scratch.keep(sizes.select(*key, F.ceil(F.col("all") / block).cast("int").alias("q_blocks"), F.ceil(F.col("own") / block).cast("int").alias("d_blocks")), "hot")
    rows = rows.join(F.broadcast(hot) if hot.count() <= HOT_MOST else hot, key, "left")

    def every(blocks: str, role: int, q, d):
        return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda i: F.struct(F.lit(role).alias("role"), q(i).alias("q"), d(i).alias("d")))

    q, d = (F.pmod(F.hash("id", F.lit(x)), F.col(f"{x}_blocks")) for x in "qd")
    alone = F.array(F.struct(F.when(F.col("foreign"), FOREIGN).otherwise(BOTH).alias("role"), F.lit(0).alias("q"), F.lit(0).alias("d")))
    own = F.concat(every("q_blocks", DATA, lambda i: i, lambda i: d), every("d_blocks", OWN, lambda i: q, lambda i: i))
    dealt = rows.withColumn("_at", F.explode(F.when(F.col("q_blocks").isNull(), alone).when(F.col("foreign"), every("d_blocks", FOREIGN, lambda i: q, lambda i: i)).otherwise(own)))
    columns = [*key, "q", "d"]
    dealt = dealt.select(*key, F.col("_at.q").alias("q"), F.col("_at.d").alias("d"), F.col("_at.role").alias("role"), "id", "copies", "embedding")
    dealt = dealt.repartition(*columns).sortWithinPartitions(*columns)

    def met(parts: list[pa.RecordBatch]):
        group = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        role = group.column(5).to_numpy()
        as_data, as_query = (role == DATA) | (role == BOTH), role != DATA
        if len(role) < 2 or not as_data.any() or not as_query.any():
            return None
        ids, copies, x = group.column(6).to_numpy(), group.column(7).to_numpy(), matrix(group.column(8), group.column(0)[0].as_py())
        return link_block(x[as_query], ids[as_query], copies[as_query], role[as_query] == FOREIGN, x[as_data], ids[as_data], copies[as_data], cosine)

    def run(batches):
        open_, out, held = [], [], 0

        def flush():
            n = [len(i) for i, _, _ in out]
            steps = np.concatenate([f for _, _, f in out])
            a = np.concatenate([*(i for i, _, _ in out), steps[:, 0]])
            none, some = pa.nulls(sum(n), pa.int64()), pa.nulls(len(steps), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.concat_arrays([none, pa.array(steps[:, 1])]), pa.concat_arrays([pa.array(np.concatenate([k for _, k, _ in out])), some])], schema=_LINKED)

        def close(parts):
            nonlocal held
            found = met(parts) if parts else None
            if found is not None and len(found[0]):
                out.append(found)
                held += len(found[0]) + len(found[2])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            values = [np.array(b.column(i).to_pylist(), object) if i == 1 else b.column(i).to_numpy() for i in range(5)]
            new = np.zeros(b.num_rows, bool)
            for v in values:
                new[1:] |= v[1:] != v[:-1]
            first = tuple(v[0] for v in values)
            new[0] = first != last
            last = tuple(v[-1] for v in values)
            cuts = [0, *(c for c in np.flatnonzero(new).tolist() if c), b.num_rows]
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if k or new[0]:
                    close(open_)
                    open_ = []
                open_.append(b.slice(lo, hi - lo))
                if held > 50_000:
                    yield flush()
                    out, held = [], 0
        close(open_)
        if out:
            yield flush()

    return map_batches(dealt, run, LINKED)


def centroids(n: int, labels: int, sample: int) -> int:
    """Of each codebook, so that a cell of a label holds OCCUPANCY vectors, if the sample has SAMPLE_EACH for each."""
    return int(max(2, min((n / max(1, labels) / OCCUPANCY) ** 0.5, sample / SAMPLE_EACH)))


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding, label``)."""
    scratch = Scratch(spark, "vectordedup")
    vectors = vectors.select("vec_id", "embedding", "label")
    # a class's own number: its place among equal vectors doesn't matter, only that it is one
    found = classes(vectors).withColumn("id", F.coalesce("first", F.xxhash64("label", "embedding")))
    found = scratch.keep(found, "classes")
    indexes = {}
    lengths = found.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).limit(LENGTHS_MOST + 1).collect()
    if len(lengths) > LENGTHS_MOST:
        raise ValueError(f"more than {LENGTHS_MOST} lengths of vectors")
    for r in lengths:
        rows = found.filter(F.size("embedding") == r["dim"]).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).toArrow()
        x = normalised(matrix(rows.column("e").combine_chunks(), r["dim"]))
        indexes[r["dim"]] = MultiIndex(x, centroids(r["n"], r["labels"], len(x)), cosine, recall)
    rows = scratch.keep(linked(scratch.keep(placed(spark, found, indexes), "placed"), scratch, cosine), "linked")
    scratch.drop("placed")
    label = components(rows.filter("b IS NOT NULL").select("a", "b"), scratch, "components")
    counts = rows.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    known = found.join(counts, found["id"] == counts["a"], "left").join(label.withColumnRenamed("id", "_id"), found["id"] == F.col("_id"), "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("g"), F.col("first"))
    known = scratch.keep(known, "known")
    # written, so that the join has an exchange on both sides and Spark can split a large component
    smallest = scratch.keep(known.groupBy("g").agg(F.min("first").alias("component_id")), "smallest")
    known = known.join(smallest, "g").select("label", "embedding", "n_links", "component_id")
    out = vectors.join(known, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
),
u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
),
reach(vec_id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.to_id
)
SELECT e.vec_id AS vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(to_id) AS c FROM reach GROUP BY vec_id) r USING (vec_id)
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = e.vec_id
"""
