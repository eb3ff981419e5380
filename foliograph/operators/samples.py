"""Reproducible samples and partitions: order is by hash, never by a random state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, group: str, id_col: str, size: int) -> DataFrame:
    """Rows by stratum in proportion, one at least, exactly ``size`` where the shares allow: largest remainders are rounded up.

    In a stratum rows of least md5 of the id come first. Quotas are one row a stratum and are broadcast.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    counts = counts.withColumn("total", F.sum("n").over(every)).withColumn("exact", F.lit(float(size)) * F.col("n") / F.col("total"))
    counts = counts.withColumn("floor", F.least(F.col("n"), F.greatest(F.lit(1), F.floor("exact"))))
    counts = counts.withColumn("left", F.lit(size) - F.sum("floor").over(every))
    order = Window.orderBy(F.round(F.col("exact") - F.floor("exact"), 9).desc(), F.col(group))
    quota = F.col("floor") + F.when((F.row_number().over(order) <= F.col("left")) & (F.col("floor") < F.col("n")), 1).otherwise(0)
    quotas = counts.select(F.col(group).alias("__g"), quota.alias("quota"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(id_col).cast("string")), id_col)))
    return ranked.join(F.broadcast(quotas), F.col(group) == F.col("__g")).where("rank <= quota").drop("__g", "quota")


def bottom_k(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of least seeded hash: a reservoir sample that any rerun repeats."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(k)


def greedy_quota(df: DataFrame, order: list, per_a: str, cap_a: int, per_b: str, cap_b: int) -> DataFrame:
    """Rows taken best first while neither of their two groups is full; ``per_b`` groups are independent of each other.

    While a ``per_b`` group has room, its rows of one ``per_a`` are taken until there are ``cap_a``, and no later one is. So
    the rows taken are the first ``cap_b`` of those among the first ``cap_a`` of both groups, and both ranks prune before
    their shuffle. Nulls come last in the order and form a group of their own.
    """
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    for keys, cap in (([per_b, per_a], cap_a), ([per_b], cap_b)):
        df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__rank") <= cap).drop("__rank")
    return df
