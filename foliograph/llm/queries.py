"""The op* queries: thin digests of the operators over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmltext, langid, licenses, lmscore, mixing, packing, quality, simhash, suffixes
from .common import table


def op1_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    out = lmscore.score_documents(table(spark, sf_dir, "documents"), good)
    return out.withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    langs, profiles = langid.prototypes(docs.where(~held & F.col("doc_id").isNotNull()))
    out = langid.predict(docs.select(F.struct("doc_id", held.alias("held")).alias("doc"), "text"), langs, profiles, "doc")
    return out.select("id.doc_id", F.col("id.held").alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_hits(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("hits", lambda h: h["probability"]))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_paragraphs", F.size("hits").cast("long").alias("n_hits"), families.alias("families"), best.alias("probability"))


def op7_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {
    "op1_lmscore": op1_lmscore,
    "op2_quality": op2_quality,
    "op3_ann": op3_ann,
    "op4_langid": op4_langid,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_htmltext": op7_htmltext,
    "op8_simhash": op8_simhash,
    "op9_suffixes": op9_suffixes,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {}
