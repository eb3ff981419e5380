"""Vector aggregates, exact neighbours in blocks and principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .order import top_per_key


def centroids(df: DataFrame, group: str, vector: str, unit: bool = False) -> DataFrame:
    """(group, n, dim, value): mean of each component, of unit vectors if asked."""
    v = vec.unit(F.col(vector)) if unit else vec.double(F.col(vector))
    return df.select(group, F.posexplode(v).alias("dim", "x")).groupBy(group, "dim").agg(F.count("*").alias("n"), F.avg("x").alias("value"))


def assemble(components: DataFrame, group: str) -> DataFrame:
    """(group, vector) from one row a component."""
    return components.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vector"))


def exact_neighbours(df: DataFrame, id_col: str, vector: str, queries, k: int, blocks: int = 16) -> DataFrame:
    """(query, rank, id, score): the k largest cosines of each query row among all other rows.

    Rows are dealt into blocks; the queries go to every block once, and a block returns k a query.
    """
    rows = df.select(F.col(id_col).alias("id"), vec.double(F.col(vector)).alias("v"), queries.alias("asks"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = rows.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if ask.num_rows and have.num_rows:
            mats = [np.array(t["v"].to_pylist(), float) for t in (ask, have)]
            q, h = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] for m in mats)
            own, ids = np.array(ask["id"]), np.array(have["id"])
            for start in range(0, len(q), 256):
                score = q[start : start + 256] @ h.T
                for i, row in enumerate(score):
                    row[ids == own[start + i]] = -np.inf
                    some = np.lexsort((ids, -np.round(row, 9)))[:k]
                    out[0] += [own[start + i].item()] * len(some)
                    out[1] += ids[some].tolist()
                    out[2] += row[some].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query", "id", "score"])

    found = asked.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(best, "query long, id long, score double").where("score > -2")
    return top_per_key(found, ["query"], k, F.round("score", 9).desc(), F.col("id").asc())


def covariance(df: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count; each task sends its sums, dim * dim numbers."""

    def sums(batches):
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, dim)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        all_ = np.concatenate([[n], s, ss.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(all_))), pa.array(all_)], names=["at", "x"])

    parts = df.select(vec.double(F.col(vector)).alias("v")).mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    all_ = np.array([r["x"] for r in parts])
    n, mean = int(all_[0]), all_[1 : dim + 1] / max(all_[0], 1)
    return mean, (all_[dim + 1 :].reshape(dim, dim) - n * np.outer(mean, mean)) / max(n - 1, 1), n


def principal_components(df: DataFrame, id_col: str, vector: str, k: int = 3) -> DataFrame:
    """(id, pc1 .. pck): centred vectors on the top eigenvectors; each has its largest component positive."""
    first = df.select(F.size(vector).alias("n")).first()
    if first is None:
        return df.select(F.col(id_col), *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])
    mean, cov, _ = covariance(df, vector, first["n"])
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    v = vec.double(F.col(vector))
    cols = [(vec.dot(v, F.array(*[F.lit(float(x)) for x in axes[:, i]])) - float(mean @ axes[:, i])).alias(f"pc{i + 1}") for i in range(k)]
    return df.select(id_col, *cols)
