"""Small hand-made inputs: ties, nulls, empty texts and the like."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions import vec
from foliograph.operators import bags, graph, order, records, samples, vectors
from foliograph.sources import readers, sinks
from foliograph.streaming import incremental


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_terms_split_case_and_drop_short_ones(spark):
    assert values(spark, T.terms(F.col("t")), "readParquet foo_bar the 12345 a/bc/def", None, "") == [["read", "parquet", "foo", "bar", "def"], [], []]


def test_whitespace(spark):
    assert values(spark, T.collapse(F.col("t")), " a\t b\n\nc ", "") == ["a b c", ""]
    assert values(spark, T.collapse_unicode(F.col("t")), "a b") == ["a b"]


def test_chunks_cover_and_overlap(spark):
    got = values(spark, T.chunks(F.col("t"), 4, 1), "abcdefgh", "", None, "ab")
    assert [[(c["offset"], c["chunk"]) for c in x] for x in got] == [[(0, "abcd"), (3, "defg"), (6, "gh")], [], [], [(0, "ab")]]


def test_sentences_and_pii(spark):
    assert values(spark, T.sentences(F.col("t")), "One. Two!  Three? four", None) == [["One.", "Two!", "Three?", "four"], []]
    assert values(spark, T.scrub_pii(F.col("t")), "a@b.org 1234-5678-9012-3456 10.0.0.1") == ["<EMAIL> <CARD> <IP>"]


def test_heading(spark):
    assert values(spark, T.heading(F.col("t")), "Abstract", "1.2 Results", "LOUD WORDS HERE", "a plain line of text", "x = 3 abc", None, "METHODS -- X") == [True, True, True, False, False, False, False]


def test_versions_and_slugs(spark):
    assert values(spark, T.canonical_id(F.col("t")), "2401.00001v2") == ["2401.00001"]
    assert values(spark, T.version_number(F.col("t")), "v12", "", None) == [12, 0, 0]
    assert values(spark, T.slug(F.col("t")), "Bellman-Ford's (fast)") == ["bellman_fords_fast"]


def test_domains_and_unit_interval(spark):
    assert values(spark, T.domains(F.col("t")), "an LLM compiler", "nothing", None) == [["deep-learning", "compilers"], [], []]
    import hashlib

    assert values(spark, T.unit_interval(F.col("t")), "x") == [int(hashlib.sha256(b"x").hexdigest()[:12], 16) / (16**12 - 1)]


def test_winner_prefers_whole_texts_then_base_on_ties(spark):
    cols = "canonical_id string, paper_id string, partial boolean, text_source string, version string, n_chars long, n_pages long, bucket string"
    data = [
        ("a", "a1", True, "raw_pdf_preextracted", "v9", 10, 1, "base"),
        ("a", "a2", None, "combined_structured_tokens", "", 10, 1, "base"),
        ("b", "b1", False, "raw_pdf_preferred", "v1", 5, 1, "base"),
        ("b", "b1", False, "raw_pdf_preferred", "v1", 5, 1, "backfill"),
        ("", "c1", False, None, None, None, None, "base"),
        (None, "d1", False, None, None, None, None, "base"),
    ]
    got = records.winners(spark.createDataFrame(data, cols)).select("canonical_id", "paper_id", "bucket").collect()
    assert sorted(map(tuple, got)) == [("a", "a2", "base"), ("b", "b1", "backfill")]


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, "A", False), (2, None, True), (4, "d", False), (5, None, True)], "id long, v string, deleted boolean")
    assert sorted(map(tuple, records.upsert(base, changes, "id", "v").collect())) == [(1, "A", "updated"), (2, None, "dropped"), (3, "c", "kept"), (4, "d", "appended")]


def test_changes_see_nulls(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, s string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "id long, s string")
    assert sorted(map(tuple, records.changes(old, new, "id", "s").collect())) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["position"] for r in order.with_position(df, "k").orderBy("k").collect()] == list(range(1000))


def test_idf_and_overlap(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, None)], "id long, t string")
    bag = bags.bags(docs, "id", "t")
    weights = bags.idf(bag, 3)
    by = {r["term"]: r["idf"] for r in weights.collect()}
    assert math.isclose(by["alpha"], math.log(4 / 3) + 1)
    ask = bags.bags(spark.createDataFrame([(9, "beta delta")], "id long, t string"), "id", "t")
    (hit,) = bags.overlap_scores(ask, bag, weights).collect()
    want = 0.65 * by["beta"] / (by["beta"] + 1) + 0.25 * by["beta"] / (by["alpha"] + 2 * by["beta"]) + 0.02
    assert hit["id"] == 1 and math.isclose(hit["score"], want)


def test_hops_and_induced_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("x", "y")], "src string, dst string")
    got = graph.hops(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert sorted((r["node"], r["hop"], r["path"]) for r in got.collect()) == [("a", 0, ["a"]), ("b", 1, ["a", "b"]), ("c", 2, ["a", "b", "c"])]
    assert graph.induced(edges, got).count() == 3


def test_neighbours_match_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in vectors.exact_neighbours(df, "id", "v", F.lit(True), 3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert all([got[(i, r)] for r in (1, 2, 3)] == np.argsort(-s[i])[:3].tolist() for i in range(60))


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vec.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_stratified_sample_has_its_size(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 998, "b").otherwise("c").alias("g"))
    got = samples.stratified(df, "g", "id", 100)
    assert got.count() == 100 and got.select("g").distinct().count() == 3
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in samples.stratified(df, "g", "id", 100).collect())


def test_jsonl_tolerant_and_strict(spark, tmp_path):
    import pytest

    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n\n{"id": 2}\n')
    assert sorted(r["id"] for r in readers.jsonl(spark, str(tmp_path), "id long").collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path), "id long", strict=True).collect()


def test_shards_and_splits(spark, tmp_path):
    counts = sinks.write_splits({"a": spark.range(10), "b": spark.range(3)}, str(tmp_path / "out"))
    assert counts == {"a": 10, "b": 3}
    sinks.write_parquet(spark.range(10).coalesce(1), str(tmp_path / "shards"), 4)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 3


def test_stream_equals_batch(spark, tmp_path):
    events = readers.table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.event_stream(spark, str(tmp_path / "in"), events.schema)
    out = str(tmp_path / "out")

    def each(frame, batch_id):
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    incremental.run_available(stream, str(tmp_path / "state"), each)
    incremental.run_available(stream, str(tmp_path / "state"), each)  # nothing new: nothing twice
    a, b = (incremental.windowed(x).count() for x in (events, spark.read.parquet(out)))
    assert a == b


def test_chunks_of_long_texts_keep_their_document(spark, tmp_path):
    from foliograph.plans import catalogue

    ask = "zebra quagga okapi gazelle impala kudu eland oryx"
    filler = "filler words of no weight " * 4100
    spark.createDataFrame([(1, filler[:101_000] + " " + ask), (2, "another text of some words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ask)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = catalogue.QUERIES["span_alignment"](spark, str(tmp_path)).where("label = 1").collect()
    assert [(r["doc_id"], r["start"]) for r in best] == [(1, 101_000)]


def test_greedy_quota_by_a_loop(spark):
    rng = random.Random(11)
    data = [(i, rng.choice(["a", "b", None]), rng.choice("uvwxyz"), rng.choice([1, 2, 3, 50, None])) for i in range(400)]
    for cap_a, cap_b in ((3, 8), (1, 4), (50, 7), (2, 100)):
        want, used, total = set(), Counter(), Counter()
        for i, b, a, n in sorted(data, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])):
            if used[b, a] < cap_a and total[b] < cap_b:
                used[b, a] += 1
                total[b] += 1
                want.add(i)
        df = spark.createDataFrame(data, "id long, b string, a string, n long")
        assert {r["id"] for r in samples.greedy_quota(df, [("n", False), ("id", True)], "a", cap_a, "b", cap_b).collect()} == want
    assert samples.greedy_quota(df.limit(0), [("n", False)], "a", 1, "b", 1).count() == 0
