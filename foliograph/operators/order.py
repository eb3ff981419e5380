"""Global order without a single task: positions come from sorted partitions and their sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session within one process may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foliograph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/foliograph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, *keys, name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``keys``, which must tell rows apart.

    Rows are sorted by range partitioning and written; positions are a partition's offset, from one
    count a partition, plus the place in it. So no task sees all rows.
    """
    placed = df.orderBy(*keys).select("*", F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("__at"))
    placed = written(placed, "ordered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order, name: str = "rank") -> DataFrame:
    """The first k rows of each key in an order, with their rank; Spark prunes to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
