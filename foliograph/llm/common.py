"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import written

#: A word is a run of bytes outside these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; dealt over all cores where its files give fewer tasks than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)


def measured(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows, else as it is: joins then shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether any id stands in two rows; reads only the id column."""
    return bool(docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def keyed(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: the id, or where ids repeat a key written with the rows."""
    if not repeats_ids(docs, id_col):
        return docs, id_col
    return materialise(docs.withColumn("__key", F.monotonically_increasing_id()), name), "__key"


def numbered(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a whole-number column that tells its rows apart: the id where that does, else a key written with the rows."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not docs.where(F.col(id_col).isNull()).limit(1).count() and not repeats_ids(docs, id_col):
        return docs, id_col
    return materialise(docs.withColumn("__key", F.monotonically_increasing_id()), name), "__key"


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing will read again."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def text_slices(batch, column: int, rows: int = 256, size: int = 4 << 20):
    """(start, texts) for slices of an Arrow batch, bounded by rows and by bytes, so that few Python strings live at once."""
    import numpy as np
    import pyarrow.compute as pc

    col = batch.column(column)
    lens = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)) if len(col) else np.zeros(0, np.int64)
    start, n = 0, len(col)
    while start < n:
        base = lens[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(lens, base + size, "right"))))
        yield start, col.slice(start, end - start).to_pylist()
        start = end


def connected_components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star contraction.

    ``edges`` has long columns u and v. Returns (u, v): every vertex that has an edge to a
    smaller vertex of its component, with the smallest one; the smallest vertices themselves
    have no row. Every round is written to the shared folder, so lineage stays short. Minima
    are aggregated before the join, so a vertex with many links doesn't meet in one task.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, now = now, materialise(small.distinct(), name)
        this = mark(now)
        discard(last)
        if this == was:
            return now
        was = this
    raise RuntimeError(f"components did not settle in {rounds} rounds")
