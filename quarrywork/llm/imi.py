"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of centroids from k-means
on a bounded sample. The table's size gives the number of centroids: the power
of two next to a quarter of the square root of the number of vectors, CENTROIDS
at least and MOST_CENTROIDS at the most; the sample has SAMPLE_EACH vectors for each, and
SAMPLE at least, those with the least hashes of id and row.
A vector belongs to the cell (i, j) of the nearest centroids of its
halves. A query takes cells in falling order of the sum of its halves' inner
products with their centroids, by the multi-sequence algorithm with a heap,
until they hold its budget of entries; these are reranked by the exact inner
product of the original vectors in double precision.

The budget is measured, not set: on the sample, for PROBES of its vectors as
queries, how far down their lists of cells the true neighbours lie; the share of
entries that reaches RECALL of them is the budget, at least LEAST entries. The
neighbours taken there are as many as the sample holds of the k of all
vectors, so they are as near as those of a real search. On vectors without
clusters that share is large, which is a property of such data.

Entries are grouped by the first half's centroid and in blocks of BLOCK entries,
so a cell that holds a third of all vectors is many blocks. A query goes once
to each block it looks at, with the set of second centroids it wants there. A
task holds one block and streams the queries past it; what leaves it is the best k
of each query in the block. Only codebooks and the cells' counts, both of
a fixed size, reach the driver.

Defined results: vectors that are null, zero, of another length than most in
the sample, or hold a null, infinite or NaN component take no part, nor do rows
without an id; a query isn't its own neighbour, nor are other rows with its id;
rows that share an id and its vector are one query, rows that share an id but
not the vector are queries of their own, each with its list from rank 1 and
query_row telling them apart; as candidates, rows that share an id are entries each; ties go to the smaller id;
fewer candidates than k give fewer rows; an empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, saved

K, CENTROIDS, MOST_CENTROIDS, SAMPLE, SAMPLE_EACH, PROBES, RECALL, LEAST, BLOCK = 20, 64, 1024, 16_384, 64, 512, 0.97, 4096, 16_384


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, at, points)
        full = counts > 0
        centroids[full] = total[full] / counts[full, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in falling order of first[i] + second[j], until those given hold the budget of entries.

    A heap has the next candidate pairs: (a, b) of ranks is pushed once (a - 1, b) and (a, b - 1) are out.
    """
    i_of, j_of = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    one, two = first[i_of].tolist(), second[j_of].tolist()
    heap, out_to, held = [(-(one[0] + two[0]), 0, 0)], [0] * len(i_of), 0  # out_to[a]: ranks b that are out for a
    number = counts.tolist()
    while heap and held < budget:
        _, a, b = heapq.heappop(heap)
        i, j = i_of[a], j_of[b]
        if number[i][j]:
            held += number[i][j]
            yield i, j
        out_to[a] = b + 1
        if a + 1 < len(one) and out_to[a + 1] == b:
            heapq.heappush(heap, (-(one[a + 1] + two[b]), a + 1, b))
        if b + 1 < len(two) and (a == 0 or out_to[a - 1] > b + 1):
            heapq.heappush(heap, (-(one[a] + two[b + 1]), a, b + 1))


class Index:
    """Codebooks, the cells' counts and the budget."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :], centroids)]
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        self.budget = 0.0

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(vectors[:, : self.half], self.books[0]), nearest(vectors[:, self.half :], self.books[1])

    def route(self, vector: np.ndarray) -> dict[int, bytes]:
        """Of each first centroid that the query looks at, the second ones as a set of bits."""
        wanted = np.zeros(self.counts.shape, bool)
        for i, j in traverse(self.books[0] @ vector[: self.half], self.books[1] @ vector[self.half :], self.counts, self.budget):
            wanted[i, j] = True
        packed = np.packbits(wanted, axis=1)
        return {i: packed[i].tobytes() for i in np.flatnonzero(wanted.any(axis=1)).tolist()}

    def calibrate(self, sample: np.ndarray, k: int, probes: int, recall: float, least: int) -> None:
        """Sets the budget from the sample and the counts."""
        total = int(self.counts.sum())
        near = max(1, round(k * len(sample) / max(1, total)))
        chosen = np.arange(min(probes, len(sample)))
        scores = sample[chosen] @ sample.T
        scores[chosen, chosen] = -np.inf
        near = min(near, len(sample) - 1)
        if near < 1:
            self.budget = float(total)
            return
        true = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        i, j = self.cells(sample)
        cell, flat = i * self.counts.shape[1] + j, self.counts.ravel()
        shares = []
        for row, at in enumerate(chosen):
            q = sample[at]
            order = np.argsort(-((self.books[0] @ q[: self.half])[:, None] + (self.books[1] @ q[self.half :])[None, :]).ravel(), kind="stable")
            reach = np.empty(len(flat))
            reach[order] = np.cumsum(flat[order])
            shares.append(reach[cell[true[row]]])
        self.budget = max(float(np.quantile(np.concatenate(shares), recall)), float(least))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def best_in_block(queries: np.ndarray, own: np.ndarray, wanted: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, score) of each query's k best entries; wanted[q, e]: whether q looks at e."""
    scores = queries @ entries.T
    scores[~wanted | (own[:, None] == ids[None, :])] = -np.inf
    if scores.shape[1] > k:
        # products of one vector may differ in the last bits with its place in the matrix: keep what could tie
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        slack = 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(edge), edge, 0.0))) * entries.shape[1]
        q, e = np.nonzero((scores >= (edge - slack)[:, None]) & np.isfinite(scores))
    else:
        q, e = np.nonzero(np.isfinite(scores))
    exact = np.empty(len(q))
    for at in range(0, len(q), 65_536):
        part = slice(at, at + 65_536)
        exact[part] = (queries[q[part]] * entries[e[part]]).sum(axis=1)
    order = np.lexsort((ids[e], -exact, q))
    q, e, exact = q[order], e[order], exact[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], e[keep], exact[keep]


def centroids_for(n: int) -> int:
    return int(np.clip(1 << max(0, round(np.log2(max(1, n)) / 2) - 2), CENTROIDS, MOST_CENTROIDS))


def search(embeddings: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int | None = None, sample_size: int | None = None, probes: int = PROBES, recall: float = RECALL, least: int = LEAST, block: int = BLOCK, scope: str = "session") -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k nearest of each row for which is_query (a column expression of the id) holds."""
    spark = embeddings.sparkSession
    result = "query_id long, rank int, vec_id long, score double, query_row long"
    vector = F.col("v")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = vector.isNotNull() & F.col("id").isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    n = rows.count()
    centroids = centroids or centroids_for(n)
    sample_size = sample_size or max(SAMPLE, SAMPLE_EACH * centroids)
    # a threshold lets little more than the sample through to the task that puts it in order
    share = min(1.0, (1.2 * sample_size + 1000) / max(1, n))
    ranked = rows.withColumn("at", F.xxhash64("id", F.monotonically_increasing_id()))
    picked = ranked.filter(F.col("at") <= F.lit(hash_share(share))).orderBy("at", "id").limit(sample_size).drop("at").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], result)
    held = picked.column("v").combine_chunks()
    lengths = held.value_lengths().to_numpy()
    size = int(np.bincount(lengths).argmax())
    sample = _matrix(held.filter(pa.array(lengths == size)), size)
    index = Index(sample, centroids)
    rows = rows.filter(F.size("v") == size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = index.cells(_matrix(batch.column(1), size))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["id", "v", "i", "j"])

    coded = saved(rows.mapInArrow(assign, "id long, v array<double>, i int, j int"), scope)
    cells = coded.groupBy("i", "j").count().toArrow()  # centroids^2 rows at the most
    index.counts[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("count").to_numpy()
    index.calibrate(sample, k, probes, recall, least)
    blocks = np.maximum(1, -(-index.counts.sum(axis=1) // block))
    per_first = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("i") + 1)
    entries = coded.select(F.col("i"), F.pmod(F.xxhash64("id", F.lit(3)), per_first).cast("int").alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("q"), "v", "j", F.lit(None).cast("binary").alias("seconds"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple[int, int, int, bytes]] = []
                for row, q in enumerate(_matrix(part.column(2), size)):
                    for i, bits in index.route(q).items():
                        out += [(row, i, b, bits) for b in range(blocks[i])]
                row, i, b, bits = zip(*out)
                take = pa.array(row)
                zero = pa.array(np.zeros(len(out), np.int32))
                yield pa.record_batch([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array([1] * len(out), pa.int32()), *(part.column(c).take(take) for c in range(3)), zero, pa.array(bits, pa.binary())], ["i", "block", "kind", "id", "q", "v", "j", "seconds"])

    queries = coded.filter(is_query(F.col("id"))).select("id", F.xxhash64("id", "v").alias("q"), "v").distinct()
    routed = queries.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(route, "i int, block int, kind int, id long, q long, v array<double>, j int, seconds binary")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, seconds = None, [], [], []
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kinds = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != at:
                    at, vectors, ids, seconds = keys[lo], [], [], []
                if kinds[lo] == 0:
                    vectors.append(_matrix(part.column(5), size))
                    ids.append(part.column(3).to_numpy())
                    seconds.append(part.column(6).to_numpy())
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    vectors, ids, seconds = [np.concatenate(vectors)], [np.concatenate(ids)], [np.concatenate(seconds)]
                rows = max(1, (1 << 21) // len(ids[0]))  # a matrix of 16 MB
                for start in range(0, part.num_rows, rows):
                    few = part.slice(start, rows)
                    own = few.column(3).to_numpy()
                    sets = np.frombuffer(b"".join(few.column(7).to_pylist()), np.uint8).reshape(few.num_rows, -1)
                    wanted = np.unpackbits(sets, axis=1)[:, seconds[0]].astype(bool)
                    q, e, score = best_in_block(_matrix(few.column(5), size), own, wanted, vectors[0], ids[0], k)
                    if len(q):
                        yield pa.record_batch([pa.array(own[q]), few.column(4).take(pa.array(q)), pa.array(ids[0][e]), pa.array(score)], ["query_id", "query_row", "vec_id", "score"])

    dealt = entries.union(routed).repartition("i", "block").sortWithinPartitions("i", "block", "kind")
    found = dealt.mapInArrow(rerank, "query_id long, query_row long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
