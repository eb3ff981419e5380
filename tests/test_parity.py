"""Every query with SQL agrees with it on the smallest tables; the others return rows."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foliograph.plans import catalogue

from .parity import connect, rows

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["span_alignment", "three_lane_fusion"])
def test_parts_of_very_long_texts(spark, tmp_path, name):
    """A text of over 100,000 characters and lines keeps its parts apart from the next document's."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    passage = [" ".join(rng.sample(words, 30)) for _ in range(3)]
    filler = "x\n" * 110_000
    texts = [filler + passage[0] + "\n" + passage[1], passage[2] + "\n" + "y\n" * 300 + passage[0][:90], " ".join(rng.sample(words, 60)), "", None]
    pq.write_table(pa.table({"doc_id": [0, 1, 2, 3, 4], "text": texts, "lang": ["en"] * 5, "source": ["s"] * 5, "n_chars": [len(t or "") for t in texts]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1, 2], "text": passage}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"conv_id": [0, 0, 1], "turn": [0, 1, 0], "role": ["user"] * 3, "text": [passage[1], "and so on", passage[2]]}), tmp_path / "conversations.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(connect(str(tmp_path)).sql(catalogue.ORACLES[name]).df())
    assert len(got)
    if name == "span_alignment":
        assert ((got["doc_id"] == 0) & (got["start"] > 100_000)).any()


def test_character_ranking_compares_classes(spark, tmp_path):
    """Repeated and null keys, null and empty types, and large classes: results as by SQL, from fewer pairs than all pairs of parts."""
    rng = random.Random(4)
    types = ["LARGE", "large", "SMALL", "Economy", "", None, "é😀a", "STANDARD"]
    parts = [(k, rng.choice(["A", "B", None]), rng.choice([1, 2, None]), rng.choice(types)) for k in [*range(90), *range(0, 90, 7), 3, 3, 3, None, None]]
    parts += [(1000 + k, "C", 1, "LARGE" if k % 2 else "SMALL") for k in range(600)]
    pq.write_table(pa.table({n: list(v) for n, v in zip(("p_partkey", "p_brand", "p_size", "p_type"), zip(*parts))}), tmp_path / "part.parquet")
    df = catalogue.QUERIES["character_ranking"](spark, str(tmp_path))
    got = df.toPandas()
    assert rows(got) == rows(connect(str(tmp_path)).sql(catalogue.ORACLES["character_ranking"]).df())
    joined = plan_rows(df._jdf.queryExecution().executedPlan())
    assert joined and max(joined) < 100_000


def plan_rows(plan) -> list[int]:
    """Rows out of every join of an executed plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return plan_rows(plan.executedPlan())
    if hasattr(plan, "plan") and "QueryStage" in plan.nodeName():
        return plan_rows(plan.plan())
    out = [int(plan.metrics().apply("numOutputRows").value())] if "Join" in plan.nodeName() else []
    children = plan.children()
    return out + [n for i in range(children.size()) for n in plan_rows(children.apply(i))]
