"""Choosing, merging and comparing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import version_number
from .order import first_per_key

#: Text sources, the best first.
SOURCE_RANK = ("raw_pdf_preextracted", "raw_pdf_preferred", "raw_pdf_fallback", "combined_structured_tokens")


def source_priority(source: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(SOURCE_RANK):
        out = F.when(source == name, len(SOURCE_RANK) - k).otherwise(out)
    return out


def winners(rows: DataFrame) -> DataFrame:
    """The best row of each canonical id; rows without one are left out.

    Whole texts beat partial ones, then the better source, the later version, more characters, more
    pages, the larger paper id; the bucket decides what is left, base first.
    """
    rows = rows.where(F.coalesce("canonical_id", F.lit("")) != "")
    return first_per_key(
        rows, ["canonical_id"],
        F.coalesce("partial", F.lit(False)).asc(), source_priority(F.col("text_source")).desc(), version_number(F.col("version")).desc(),
        F.coalesce("n_chars", F.lit(0)).desc(), F.coalesce("n_pages", F.lit(0)).desc(), F.col("paper_id").desc(), F.col("bucket").asc(),
    )


def overlay(row: Column, metadata: Column) -> Column:
    """Metadata where it isn't blank, else the row's own value."""
    return F.coalesce(F.nullif(F.trim(metadata), F.lit("")), row)


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status): base rows kept, updated or dropped, and changes that are appended.

    ``changes`` has one row a key with a boolean ``deleted``; deleting what isn't there does nothing.
    """
    b, c = base.select(F.col(key).alias("bk"), F.col(value).alias("bv")), changes.select(F.col(key).alias("ck"), F.col(value).alias("cv"), "deleted")
    status = F.when(F.col("ck").isNull(), "kept").when(F.col("deleted") & F.col("bk").isNotNull(), "dropped").when(F.col("deleted"), "ignored").when(F.col("bk").isNull(), "appended").otherwise("updated")
    both = b.join(c, F.col("bk") == F.col("ck"), "full_outer")
    return both.select(F.coalesce("bk", "ck").alias(key), F.when(F.col("ck").isNull(), F.col("bv")).when(~F.col("deleted"), F.col("cv")).alias(value), status.alias("status")).where("status <> 'ignored'")


def last_write(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Each key's values at its largest ``order``; aggregated before the shuffle."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, *[F.col("v")[v].alias(v) for v in values])


def changes(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, change): added, removed or changed between two states."""
    o, n = old.select(F.col(key).alias("ok"), F.col(signature).alias("os")), new.select(F.col(key).alias("nk"), F.col(signature).alias("ns"))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when(~F.col("os").eqNullSafe(F.col("ns")), "changed")
    return o.join(n, F.col("ok") == F.col("nk"), "full_outer").select(F.coalesce("ok", "nk").alias(key), change.alias("change")).where("change is not null")


def missing_references(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """(relation, missing_key, n_rows): keys that no parent has."""
    lost = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("missing_key")).agg(F.count("*").alias("n_rows"))
    known = parents.select(F.col(parent_key).cast("long").alias("missing_key"))
    return lost.join(known, "missing_key", "left_anti").select(F.lit(relation).alias("relation"), "missing_key", "n_rows")
