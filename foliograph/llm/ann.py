"""Approximate nearest neighbours by largest cosine: the inverted multi-index.

Method: unit vectors are cut in two halves, and each half is quantised by its own k-means
centroids, fitted on at most ``sample`` vectors of least hash (a documented bound). Every vector
is entered in the cell of its two nearest centroids. A query visits cells in order of the summed
distance of both halves, taken from a heap over the two sorted centroid lists, until the cells
visited hold ``entries`` distinct vectors, or the ``share`` of the index if that is more; all
entries of these cells are reranked by the exact cosine in double precision.

Equal vectors are one entry of the index with its ``k + 1`` smallest ids: no others can be among
k nearest when ties go to smaller ids. So a vector that a third of all rows share costs one
entry, and is searched once for all queries that have it. The index is dealt into blocks by a
hash of the entry, so a crowded cell is spread over tasks, and queries into groups of about
``queries_at_once``; a task holds one block and one group, whatever the size of the table. A query
goes to each block once, with the cells it visits, and a block returns the query's k + 1 best only.

Vectors that are null, empty, zero, or hold a null or non-finite component, or whose length
differs from the most frequent one, take no part: they are neither queries nor candidates. With
fewer candidates than k all are returned. Repeated rows with one id count as that one id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def usable(vec):
    """Whether a vector column takes part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of Lloyd's iteration, started from k rows."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def visit(left: np.ndarray, right: np.ndarray, counts: np.ndarray, entries: int) -> list[int]:
    """Cells in order of summed distance, until they hold ``entries``; ``counts`` by cell."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, cells, held = [(left[a[0]] + right[b[0]], 0, 0)], [], 0
    width = len(right)
    while heap and held < entries:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return cells


def search(vectors: DataFrame, id_col: str, vec_col: str, queries, k: int = 5, centroids: int = 32, sample: int = 8_192, entries: int = 4_000, share: float = 0.5, block: int = 4_096, queries_at_once: int = 2_048) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest other rows. ``queries``: a condition on the id column.

    ``entries`` that exceed the table, or a ``share`` of 1, make the search exact. The default share
    is for vectors without clusters, where smaller ones miss the recall of 0.9.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), queries.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = usual["n"]
    half = dim // 2
    # One entry a distinct vector, with its k + 1 smallest ids; partial aggregation keeps as many a task.
    keyed = rows.where(F.size("vec") == dim).withColumn("key", F.xxhash64("vec"))
    some = keyed.groupBy("key").agg(F.first("vec").alias("vec")).orderBy("key").limit(sample).select("vec").toPandas()
    x = np.stack(some["vec"].to_numpy())
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)) if half else (np.zeros((1, 0)), kmeans(x, centroids))
    width = len(books[1])

    def enter(batches):
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), float).reshape(-1, dim)
            u = v / np.linalg.norm(v, axis=1)[:, None]
            cell = nearest(u[:, :half], books[0]) * width + nearest(u[:, half:], books[1])
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32))], names=["key", "vec", "ids", "cell"])

    ids = _smallest_ids(keyed, k + 1)
    firsts = keyed.groupBy("key").agg(F.min(F.struct("vec")).getField("vec").alias("vec"))
    entered = materialise(firsts.join(ids, "key").select("key", "vec", "ids").mapInArrow(enter, "key long, vec array<double>, ids array<long>, cell int"), "index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in entered.groupBy("cell").count().collect():  # a row a cell at most
        counts[r["cell"]] = r["count"]

    total = int(counts.sum())
    enough = max(entries, int(np.ceil(share * total)))
    blocks = -(-total // block)

    def ask(batches):
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), float).reshape(-1, dim)
            u = v / np.linalg.norm(v, axis=1)[:, None]
            left, right = distances(u[:, :half], books[0]), distances(u[:, half:], books[1])
            cells = [visit(left[i], right[i], counts, enough) for i in range(len(u))]
            yield pa.record_batch([*batch.columns[:2], pa.array(cells, pa.list_(pa.int32()))], names=["qkey", "qvec", "cells"])

    asked = keyed.where("asks").groupBy("key").agg(F.min(F.struct("vec")).getField("vec").alias("vec"))
    visits = materialise(asked.mapInArrow(ask, "qkey long, qvec array<double>, cells array<int>"), "visits")
    groups = max(1, -(-visits.count() // queries_at_once))
    spread = visits.withColumn("part", F.pmod("qkey", F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = entered.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = spread.groupBy("block", "part").cogroup(dealt.groupBy("block", "part"))

    def rerank(asks: pa.Table, index: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asks.num_rows and index.num_rows:
            v = np.asarray(index["vec"].combine_chunks().flatten(), float).reshape(-1, dim)
            norms, cell, id_lists = np.sqrt((v * v).sum(1)), np.asarray(index["cell"], np.int64), index["ids"].to_pylist()
            seen = np.zeros(len(counts), bool)
            for own, vec, cells in zip(asks["qkey"].to_pylist(), asks["qvec"], asks["cells"]):
                q, cells = np.asarray(vec.values, float), np.asarray(cells.values)
                seen[cells] = True
                at = np.flatnonzero(seen[cell])
                seen[cells] = False
                score = (v[at] * q).sum(1) / (norms[at] * np.sqrt((q * q).sum()))
                top = range(len(at)) if len(at) <= k + 1 else np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1])
                for j in top:
                    for one in id_lists[at[j]]:
                        out[0].append(own)
                        out[1].append(one)
                        out[2].append(float(score[j]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qkey", "id", "score"])

    found = both.applyInArrow(rerank, "qkey long, id long, score double")
    # The k + 1 best of each distinct query vector, then each of its ids without itself.
    best = _best(found, k + 1)
    askers = keyed.where("asks").select(F.col("key").alias("qkey"), F.col("id").alias("query_id")).distinct()
    pairs = askers.join(best, "qkey").select("query_id", F.explode("best").alias("b")).where("b.id <> query_id")
    listed = pairs.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("b.score")).alias("s"), F.col("b.id").alias("id")))), 1, k).alias("b"))
    return listed.select("query_id", F.posexplode("b").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def _smallest_ids(keyed: DataFrame, n: int) -> DataFrame:
    """(key, ids): the n smallest distinct ids of each key, salted so that no key's ids meet in one place before they are few."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= n).drop("nth")

    few = least(keyed.select("key", "id", salt.alias("salt")).distinct(), "key", "salt")
    return least(few, "key").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _best(found: DataFrame, n: int) -> DataFrame:
    """(qkey, best): the n best of each query, by score, then smaller id."""
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    kept = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return kept.groupBy("qkey").agg(F.collect_list(F.struct("id", "score")).alias("best"))
