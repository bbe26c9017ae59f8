"""Exact top-k search by MaxScore over vectors taken as weighted terms.

A component is a term, its value floor(scale * x) the weight, the score of a query and a row their integer inner product.
Each task lays its rows out in shards of SHARD rows whose largest weights fall on the same terms; a shard keeps a posting
list for each term (the weights of its rows) and the list's least and greatest weight. For a query, a term's bound is the
range of what it can add in the shard. Terms are ordered by bound; the smallest ones whose bounds together cannot lift a
row from the best score without them to the k-th best score known so far are non-essential. The postings of the essential
terms are traversed for all rows of the shard, then the non-essential terms are probed STEP at a time for the rows that
still can reach that score. A shard whose terms together cannot reach it is passed over.

The k-th best score is known from the start: before a block of queries goes out, each is scored against the same SEEDS
rows (the first by hash), and what the k-th of them has is a floor that the result cannot lie under. The seeds bound
nothing but that floor; all rows are searched. A task carries its best k of each query from shard to shard, and the
tasks' lists are merged by rank.

Queries go to the tasks in blocks of at most `block` rows, one block after the other, so what is sent has a fixed bound;
each block reads the rows once.

Vectors that are null or hold null or non-finite components, or rows with a null vec_id, take no part. Vectors of other
lengths than a query's score nothing against it. Rows with a query's own vec_id are not its candidates; where rows repeat
a vec_id that is a query, it is asked once, with the first of its vectors in order of value; as candidates each row
counts. Ties go to the smaller vec_id. Scores beyond 64 bits are clipped to them. An empty table gives an empty result, a
vector may be as long as a row can be. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score long"
STEP, SHARD, SEEDS = 8, 256, 2048
EXACT = float(1 << 52)


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def long_scores(query: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores whose sums doubles cannot hold exactly."""
    q, top = [int(x) for x in query], (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * b for a, b in zip(w, q, strict=True)))) for w in weights.tolist()], object)


class Queries:
    """Queries of one length: ids, weights, and each one's best k (scores, ids) so far with a floor under its k-th."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.weights, self.floor, self.k = ids, weights, floor.copy(), k
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def take(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.best[at] = merge(self.best[at], scores, ids, self.ids[at], self.k)
        if len(self.best[at][0]) == self.k:
            self.floor[at] = max(self.floor[at], float(self.best[at][0][-1]))


class Shard:
    """Postings of rows of one length: by term the rows' weights, the least and the greatest of them."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(weights[order].T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def search(self, queries: Queries) -> int:
        """Takes this shard's rows into the queries' best; how many weights were read."""
        read, terms = 0, len(self.postings)
        large = np.abs(queries.weights).max(axis=1, initial=0) * np.abs(self.postings).max(initial=0) * max(1, terms) >= EXACT
        ends = queries.weights * self.low, queries.weights * self.high
        least, span = np.minimum(*ends), np.abs(ends[1] - ends[0])
        order = np.argsort(-span, axis=1, kind="stable")
        sorted_ = np.take_along_axis(span, order, axis=1)
        behind = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
        rest = np.hstack([behind(np.take_along_axis(least, order, axis=1) + sorted_), np.zeros((len(order), 1))])  # the most that terms from here on add
        # a row with the least of all essential terms gains at most what the others span
        essential = (least.sum(axis=1)[:, None] + behind(sorted_) >= queries.floor[:, None]).sum(axis=1)
        for at in np.flatnonzero(large | (rest[:, 0] >= queries.floor)):
            query, need = queries.weights[at], queries.floor[at]
            if large[at]:
                queries.take(at, long_scores(query, self.postings.T), self.ids)
                read += self.postings.size
                continue
            here, first = order[at], essential[at]
            score = query[here[:first]] @ self.postings[here[:first]]
            rows, read = np.arange(len(self.ids)), read + first * len(self.ids)
            while first < terms:
                alive = score + rest[at, first] >= need
                rows, score = rows[alive], score[alive]
                if not len(rows):
                    break
                probe = here[first : first + STEP]
                score = score + query[probe] @ self.postings[np.ix_(probe, rows)]
                first, read = first + STEP, read + len(probe) * len(rows)
            good = score >= need
            if good.any():
                queries.take(at, score[good], self.ids[rows[good]])
        return read


def shards(ids: np.ndarray, weights: np.ndarray) -> Iterator[Shard]:
    """Rows whose largest weight is on the same term lie together, so that bounds are close."""
    order = np.lexsort((-np.abs(weights).max(axis=1), np.abs(weights).argmax(axis=1))) if weights.shape[1] else np.arange(len(ids))
    for begin in range(0, len(order), SHARD):
        some = order[begin : begin + SHARD]
        yield Shard(ids[some], weights[some])


def floors(ids: np.ndarray, weights: np.ndarray, seeds: list[tuple[int, np.ndarray]], k: int) -> np.ndarray:
    """For each query the k-th best score among the seeds, of which none is its own row."""
    out = np.full(len(ids), -np.inf)
    seeds = [s for s in seeds if len(s[1]) == weights.shape[1]]
    if len(seeds) < k or not weights.shape[1]:
        return out
    rows = np.array([w for _, w in seeds])
    if np.abs(weights).max() * np.abs(rows).max() * weights.shape[1] >= EXACT:
        return out
    score = weights @ rows.T
    score[ids[:, None] == np.array([i for i, _ in seeds])[None]] = -np.inf
    return np.partition(score, len(seeds) - k, axis=1)[:, len(seeds) - k]


def merge(best, score: np.ndarray, ids: np.ndarray, query_id: int, k: int):
    other = ids != query_id
    score, ids = np.concatenate([best[0], score[other]]), np.concatenate([best[1], ids[other]])
    if len(score) > 4 * k and score.dtype != object:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[keep], ids[keep]
    order = sorted(range(len(score)), key=lambda i: (-score[i], ids[i])) if score.dtype == object else np.lexsort((ids, -score))
    return score[order[:k]], ids[order[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 4096) -> DataFrame:
    """Both (vec_id, embedding array of numbers, ...) -> (query_id, rank, vec_id, score): for each query its k best rows
    (all, if there are fewer)."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() * 9 // (block * 8)))
    weigh = lambda r: (r.vec_id, np.floor(scale * np.array(r.embedding, np.float64)))
    seeds = [weigh(r) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()]
    parts = []
    for turn in range(blocks):
        mine = [weigh(r) for r in (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == turn) if blocks > 1 else asked).collect()]
        groups = {}
        for size in {len(w) for _, w in mine}:
            ids = np.array([i for i, w in mine if len(w) == size], np.int64)
            weights = np.array([w for _, w in mine if len(w) == size], np.float64).reshape(len(ids), size)
            groups[size] = (ids, weights, floors(ids, weights, seeds, k))
        sent = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            open_ = {size: Queries(*group, k) for size, group in sent.value.items()}
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                begin = np.cumsum(sizes) - sizes
                for size in set(sizes.tolist()) & open_.keys():
                    own = np.flatnonzero(sizes == size)
                    for shard in shards(ids[own], flat[begin[own][:, None] + np.arange(size)].reshape(len(own), size)):
                        shard.search(open_[size])
            out = [(int(q), int(i), int(s)) for group in open_.values() for q, best in zip(group.ids, group.best, strict=True) for s, i in zip(*best, strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

        parts.append(rows.mapInArrow(run, HITS))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
