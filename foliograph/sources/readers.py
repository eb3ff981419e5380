"""Sources: parquet buckets with differing schemas, tolerant and strict JSON lines, text lines with numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores if its files give fewer tasks than that; for work that is heavy by row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def union_buckets(buckets: dict[str, DataFrame]) -> DataFrame:
    """Rows of all buckets with their name in ``bucket``; columns that a bucket lacks are null."""
    out = None
    for name, df in buckets.items():
        df = df.withColumn("bucket", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def parquet_union(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("mergeSchema", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(*paths)


def jsonl(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """JSON lines; malformed lines are dropped, or with ``strict`` fail the query. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_with_rejects(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with the text of malformed ones in ``_corrupt_record``."""
    from pyspark.sql.types import StructType

    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def files(spark: SparkSession, path: str, glob: str, max_bytes: int = 1_000_000) -> DataFrame:
    """(path, length, text) of files that are neither empty nor too large, decoded as UTF-8."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.where((F.col("length") > 0) & (F.col("length") <= max_bytes)).select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
