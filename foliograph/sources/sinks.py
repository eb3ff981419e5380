"""Sinks: parquet and JSON shards of bounded size, written through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, rows_per_file: int = 0, dedup: str | None = None) -> None:
    """JSON lines; ``dedup`` names a text column of which equal values are written once."""
    if dedup:
        df = df.dropDuplicates([dedup])
    writer = df.write
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).json(path)


def write_splits(splits: dict[str, DataFrame], path: str) -> dict[str, int]:
    """One parquet folder a split; returns the row counts, read from the footers."""
    out = {}
    for name, df in splits.items():
        write_parquet(df, f"{path}/{name}", mode="overwrite")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def compact_json(column):
    """A map column as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
