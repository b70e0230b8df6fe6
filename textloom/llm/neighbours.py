"""Approximate nearest neighbours by collision counting.

Each vector, scaled to length one, has PROJECTIONS random projections; a block of vectors keeps one sorted array for each, and the rank of
each vector in it. A query opens a window around its own projection in every array and widens all windows together (virtual
rehashing): by FIRST_WIDTHS and GROWTH, and once k vectors are verified no further than RATIO times the distance of the k-th, where the
search of the block ends. A vector whose ranks lie in at least COLLISIONS of the windows is a candidate and verified by its cosine in
double precision. At that last width a vector as near as the k-th is expected in 73 % of the windows, so few are lost, and most
vectors that are farther don't reach the threshold. Where there are few vectors the windows grow to hold them all. Counting stops
early for vectors in fewer than FEW_COLLISIONS of the first FEW windows: one that is as near as the k-th is expected in 23 of these, with a
standard deviation of 2.5, so about one in 30,000 such vectors is lost by it.

Vectors lie in blocks of about BLOCK rows, on any cluster alike; each is indexed once, by the task that holds it, and the queries stream past
it in Arrow batches. The best k of each block are merged for each query. Every row is indexed, and every query reads every block: in
high dimensions windows of this width meet all blocks, so that none could be left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, table

PROJECTIONS = 128
COLLISIONS = 87
FEW = 32  # projections that are counted first
FEW_COLLISIONS = 13  # of these, without which a vector isn't counted further
RATIO = 1.1
FIRST_WIDTHS = (0.3, 0.9)  # up to the second, few vectors that are unlike the query reach the threshold
GROWTH = 1.12
BLOCK = 8_192


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q, in double precision; equal rows have equal values, wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class Block:
    """The sorted projections of some vectors, and how many vectors have been verified in `searches` searches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.ids, self.vectors, self.unit = ids, vectors, unit(vectors)
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        places = (self.unit @ self.axes).T
        order = places.argsort(axis=1, kind="stable")
        self.gap = 4 * (float(np.abs(self.axes).sum(axis=0).max()) + 1)  # keeps the arrays apart in one
        self.sorted = (np.take_along_axis(places, order, 1) + np.arange(PROJECTIONS)[:, None] * self.gap).ravel()
        self.ranks = np.empty(places.shape, np.uint32 if len(ids) > 65_535 else np.uint16)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=self.ranks.dtype)[None], 1)
        self.widest = float(np.abs(self.axes).sum(axis=0).max()) * 2 + 1
        self.verified = self.searches = 0

    def _counts(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that lie in many of the windows, and in how many."""
        first = np.arange(PROJECTIONS) * len(self.ids)
        middle = centre + np.arange(PROJECTIONS) * self.gap
        low, high = np.searchsorted(self.sorted, middle - half, "left") - first, np.searchsorted(self.sorted, middle + half, "right") - first
        if (low == 0).all() and (high == len(self.ids)).all():
            return np.arange(len(self.ids)), np.full(len(self.ids), PROJECTIONS)
        low, width = low.astype(self.ranks.dtype)[:, None], (high - low).astype(self.ranks.dtype)[:, None]
        few = ((self.ranks[:FEW] - low[:FEW]) < width[:FEW]).sum(axis=0, dtype=np.uint8)  # ranks under the window wrap around
        rest = np.flatnonzero(few >= FEW_COLLISIONS)
        more = self.ranks[FEW:] if 2 * len(rest) > len(self.ids) else self.ranks[FEW:, rest]
        counts = ((more - low[FEW:]) < width[FEW:]).sum(axis=0, dtype=np.uint8)
        return rest, few[rest].astype(np.int32) + (counts if len(counts) == len(rest) else counts[rest])

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, nearest first, ties to the smaller id; rows with the id `own` stay out."""
        fresh = self.ids != own
        wanted = min(k, int(fresh.sum()))
        self.searches += 1
        if not wanted:
            return self.ids[:0], np.zeros(0)
        q = query / np.sqrt((query * query).sum())
        centre, score = q @ self.axes, np.full(len(self.ids), -np.inf)
        half, best, later = FIRST_WIDTHS[0], -np.inf, iter(FIRST_WIDTHS[1:])
        while True:
            which, count = self._counts(centre, half)
            new = which[count >= COLLISIONS]
            new = new[fresh[new]]
            if len(new):
                score[new] = self.unit[new] @ q
                fresh[new] = False
                self.verified += len(new)
                found = score[score > -np.inf]
                if len(found) >= wanted:
                    best = np.partition(found, len(found) - wanted)[len(found) - wanted]
            enough = RATIO * np.sqrt(max(2 - 2 * best, 0)) if best > -np.inf else np.inf
            if half >= min(enough, self.widest):
                break
            half = min(next(later, half * GROWTH), max(enough, half), self.widest)
        near = np.flatnonzero(score >= best - 1e-9)
        exact = cosines(self.vectors[near], query)
        first = np.lexsort((self.ids[near], -exact))[:k]
        return self.ids[near][first], exact[first]


@lean
def _search(batches, k: int):
    """Rows (dims, b, is_query, vec_id, v) sorted by these: a block's vectors, which are gathered and indexed, then its queries."""
    key, ids, vectors, block = None, [], [], None
    for batch in batches:
        dims, b, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ends = np.flatnonzero(np.r_[(dims[1:] != dims[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]), True]) + 1
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            here = (int(dims[lo]), int(b[lo]))
            if here != key:
                key, ids, vectors, block = here, [], [], None
            part = batch.slice(lo, hi - lo)
            own = part.column(3).to_numpy()
            values = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, key[0])
            if not kind[lo]:
                ids.append(own), vectors.append(values)
                continue
            if block is None and ids:
                block = Block(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors = [], []
            if block is None:
                continue
            found = [block.search(i, q, k) for i, q in zip(own.tolist(), values, strict=True)]
            query = np.repeat(own, [len(n) for n, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([n for n, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each query row, by cosine.

    Vectors that are null, empty or zero, or hold a null or a non-finite component, take no part, nor do rows without an id.
    Vectors of another length than the query's aren't its candidates. Equal rows count once; vec_id is taken for a key, so a
    query's own id stays out of its result.
    """
    v = F.col(f"`{embedding}`")
    good = v.isNotNull() & (F.size(v) > 0) & F.col(f"`{vec_id}`").isNotNull()
    doubles = F.transform(v, lambda x: x.cast("double"))
    clean = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    square = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform(doubles, F.abs))
    usable = rows.where(good & clean).where(largest > 0)
    scaled = F.when((square > 0) & (square < float("inf")), doubles).otherwise(F.transform(doubles, lambda x: x / largest))  # else squares overflow or vanish
    usable = usable.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), scaled.alias("v"), F.size(v).alias("dims"), is_query.alias("q")).dropDuplicates(["vec_id", "v"])
    usable = materialize(usable, "vectors")
    total = usable.count()
    blocks = max(1, -(-total // BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    vectors = usable.select("dims", block.alias("b"), F.lit(False).alias("is_query"), "vec_id", "v")
    queries = usable.where("q").select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("is_query"), "vec_id", "v")
    dealt = vectors.unionByName(queries).repartitionByRange(blocks, "dims", "b").sortWithinPartitions("dims", "b", "is_query")
    local = dealt.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
