"""The corpus pipeline: quality rules, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last return the columns of docs; the last returns the pieces of
packed sequences. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import mixing, packing, quality, simhash, suffixes
from foliograph.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go, each judged by its own text, also where ids repeat or are null."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies share 0.8 or more of their five-word shingles. Rows are judged by their own text: rows of one id,
    or without an id, stay side by side if their texts are no near copies.
    """
    return simhash.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 200 that also start elsewhere go; characters that were cut through go whole.

    Every document stays, if need be with an empty text; n_chars follows the text, a null text stays null.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = suffixes.cut_repeats(docs.select(F.struct(*rest, F.col("text").isNull().alias("__null")).alias("doc"), "text"), "doc", as_text=True)
    whole = cut.select("id", F.when(~F.col("id.__null"), F.col("kept")).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in rest else {"text": F.col("text")}
    return whole.select(*[made[c].alias(c) if c in made else F.col("id")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, copies side by side; wordless ones and null texts once.

    A null source is a source of its own, rows that repeat are documents of their own.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed. A null or empty text is a piece of its end id alone; rows that repeat are packed each."""
    out = packing.pack(docs)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
