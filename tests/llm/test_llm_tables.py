"""Neighbours, preference pairs, the entry point and the pipeline."""

import math

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from dailycast.llm import catalog, preference_chat, projection_forest

ROOT = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, x in ok:
        if asked(q):
            near = sorted({(-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q})[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(near))


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, -float(i % 2)], "x") for i in range(12)]
    rows += [(20, None, "x"), (21, [0.0, 0.0, 0.0], "x"), (22, [1.0, None, 2.0], "x"), (23, [math.nan, 1.0, 1.0], "x"),
             (24, [math.inf, 1.0, 1.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (25, [], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = projection_forest.nearest(frame, F.col("id") % 4 == 0, k=5).collect()
    want = list(brute([(i, v) for i, v, _ in rows], lambda q: q % 4 == 0, 5))
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(w[:3] for w in want)
    assert len(projection_forest.nearest(frame, F.col("id") == 0, k=50).collect()) == 11
    assert projection_forest.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_recall_with_a_crowd_of_copies_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "LEAF", 40)
    monkeypatch.setattr(projection_forest, "GROUP", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[300]  # a third of all rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in projection_forest.nearest(frame, F.col("id") % 20 == 0, k=10, visits=100).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(900), -np.round(s, 9)))[:10].tolist()) & set(got[q]))
    assert hits / (45 * 10) >= 0.9
    assert got[300] == [i for i in range(301, 311)]  # ties go to smaller ids


def test_recall_on_the_table(spark):
    rows = catalog.QUERIES["op4_nearest_neighbours"](spark, ROOT).collect()
    table = spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()
    want = {w[:1] + w[2:3] for w in brute([(r["vec_id"], r["embedding"]) for r in table], lambda q: q % 20 == 0, 20)}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in rows}) >= 0.9 * len(want)


def test_preference_pairs_equal_sql(spark):
    name = "op8_preference_chat"
    assert compare(spark, connect(ROOT), ROOT, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_preference_pairs_share_a_prompt(spark):
    turns = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, True, 2, "user", "more"),
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"),
        (2, True, 0, None, None), (2, True, 0, None, None),
        (3, True, 0, "user", "é"), (3, False, 0, "user", "é"), (3, False, 1, "assistant", ""),
        (None, False, None, "assistant", "x"), (4, None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame(turns, "p long, c boolean, turn int, role string, text string").withColumn("__n", F.lit(1))
    got = {r["p"]: r for r in preference_chat.preference_pairs(frame, "p", "c").collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1]["prompt"] == show("user", "hi") and got[1]["n_common"] == 1
    assert got[1]["chosen"] == show("assistant", "good") + show("user", "more")
    for side in ("chosen", "rejected"):
        (a, z), *more = got[1][f"{side}_mask"]
        assert not more and got[1][side][a:z] == {"chosen": "good", "rejected": "bad"}[side] + "<|im_end|>"
    assert (got[2]["prompt"], got[2]["rejected"], got[2]["rejected_mask"]) == ("", None, None)
    assert got[2]["chosen"] == 2 * show("", "")
    assert got[3]["prompt"] == show("user", "é") and got[3]["chosen"] == "" and got[3]["chosen_mask"] == []
    assert got[None]["chosen"] is None and got[4]["prompt"] == ""
    assert preference_chat.preference_pairs(frame.limit(0), "p", "c").count() == 0


def test_preference_plan_is_native(spark):
    plan = catalog.QUERIES["op8_preference_chat"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entry_point_has_all_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(catalog.QUERIES) <= names and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, ROOT)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.count()
        assert after == before if name == "line_dedup" else after < before if name == "near_dedup" else after <= before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT)
    assert packed.select("doc_id").distinct().count() == before
    assert docs.filter("n_chars != length(text)").count() == 0
    whole = corpus_pipeline.run(spark, ROOT)
    assert whole.exceptAll(packed).count() == 0 and packed.exceptAll(whole).count() == 0


@pytest.mark.parametrize("step", range(4))
def test_pipeline_stages_take_an_empty_table(spark, tmp_path, step):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert corpus_pipeline.STAGES[step][1](spark, spark.read.parquet(str(tmp_path / "none")), ROOT).count() == 0
