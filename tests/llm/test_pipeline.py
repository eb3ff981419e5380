"""The pipeline's stages keep their columns, survive odd rows and empty tables, and their decisions take effect."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .data import documents, nothing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    documents(spark).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "pack_sequences":
            assert docs.columns == columns
    ids = {k: {r[0] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["near_duplicates"] <= ids["quality_rules"] and ids["repeated_passages"] == ids["near_duplicates"]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert seen["quality_rules"].where(words < 50).count() == 0
    assert seen["pack_sequences"].count() >= seen["mix_sources"].count()


def test_empty_tables(spark, folder, tmp_path):
    nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_text_stays_null(spark, folder):
    docs = documents(spark)
    out = corpus_pipeline.repeated_passages(spark, docs, folder)
    assert out.where("text is null").count() == docs.where("text is null").count()


def brute_near(rows):
    from .test_operators import shingle_classes

    group = shingle_classes([r["text"] for r in rows])
    best = {}
    for r, g in zip(rows, group):
        if g not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (best[g]["doc_id"] is None, best[g]["doc_id"] or 0):
            best[g] = r
    return Counter((r["doc_id"], r["text"]) for r in best.values())


def test_near_duplicates_judge_rows_with_repeated_and_null_ids(spark, folder):
    def prose(k, n=70):
        return " ".join(f"w{k}x{i}" for i in range(n))

    some = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (1, prose(4)), (1, prose(5)), (2, prose(6))]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.near_duplicates(spark, df, folder).collect())) == Counter(some)
    more = some + [(3, prose(6)), (None, prose(5)), (4, prose(4) + " z"), (9, None), (8, " ")]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, folder).collect())
    assert got == brute_near(df.collect())
    docs = documents(spark)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).where("doc_id is not null").collect()}
    assert got == {k for k in brute_near(docs.collect()) if k[0] is not None}


def test_repeated_passages_keep_all_other_characters(spark, folder):
    passage = "é" * 150 + "."
    rows = [(1, "A\ufffdB " + passage + " end\ufffd"), (2, "x" + passage + "ü"), (3, "A\ufffdB"), (None, None)]
    out = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "A\ufffdB  end\ufffd", 2: "xü", 3: "A\ufffdB", None: None}
