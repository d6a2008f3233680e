"""Findings of round 3: whole results whose cost doesn't multiply."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import similarity as S
from lexweave.functions import text as T
from lexweave.operators import candidates as C
from lexweave.operators import judgment as J
from lexweave.plans import queries as Q


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vector_id long, type string, vector array<double>")


def test_self_nearest_looks_at_all_types(spark, tmp_path):
    rows = [(5, [1.0, 2.0], 0), (3, [1.0, 2.0], 1), (9, [4.0, 0.0], 1), (7, [9e5, -9e5], 2), (8, [9e5, -9e5 + 1e-4], 2), (4, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in Q.QUERIES["self_nearest"](spark, str(tmp_path)).collect()}
    assert got == {(5, 3, True), (3, 3, True), (9, 9, True), (7, 7, True), (8, 7, True)}
    assert "CROSS JOIN" in Q.ORACLE_SQL["self_nearest"] and "true AS" not in Q.ORACLE_SQL["self_nearest"]


def test_nearest_of_all_in_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (90, 3)).astype(float)
    monkeypatch.setattr(C, "ALL_BLOCK", 13)
    monkeypatch.setattr(C, "PAIR_ROWS", 4)
    got = {r[0]: (r[1], r[2]) for r in C.nearest_of_all(vectors(spark, [(i, "t", v[i].tolist()) for i in range(90)])).collect()}
    d = ((v[:, None] - v) ** 2).sum(axis=2)
    assert got == {i: (int(d[i].argmin()), 0.0) for i in range(90)}


def test_pair_distances_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], r.standard_normal(4).tolist()) for i in range(60)] + [(60, "a", None), (61, "a", [0.0] * 4), (62, None, [1.0] * 4)]
    table = vectors(spark, rows)
    a = table.select(F.col("vector_id").alias("a"), "type", F.col("vector").alias("x"))
    b = table.select(F.col("vector_id").alias("b"), "type", F.col("vector").alias("y"))
    want = a.join(b, "type").where("a < b").select("a", "b", F.round(S.cosine_distance(F.col("x"), F.col("y")), 6) + 0.0)
    monkeypatch.setattr(C, "PAIR_BLOCK", 7)
    monkeypatch.setattr(C, "PAIR_ROWS", 3)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, C.pair_distances(table).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    plan = C.pair_distances(table)._jdf.queryExecution().toString()
    assert "zip_with" not in plan.split("MapInArrow")[0]


def test_nearest_compares_equal_queries_once_and_pools_an_id(spark):
    table = vectors(spark, [(i, "t", [1.0, float(i)]) for i in range(6)])
    asked = spark.createDataFrame([(1, "t", [1.0, 0.0]), (1, "t", [1.0, 5.0]), (2, "t", [1.0, 0.0]), (None, "t", [1.0, 3.0])], "query_id long, type string, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["vector_id"] for r in C.nearest(asked, table, 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 5, (2, 1): 0, (2, 2): 1, (None, 1): 3, (None, 2): 4 if got[(None, 2)] == 4 else 2}


def test_search_bounds_arrow_batches(spark):
    table = vectors(spark, [(1, "t", [1.0])])
    C.nearest(table.withColumnRenamed("vector_id", "query_id"), table)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(2**31 - 1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_native_hands_large_tables_to_blocks(spark, monkeypatch):
    table = vectors(spark, [(i, "t", [1.0, float(i)]) for i in range(20)])
    asked = table.withColumnRenamed("vector_id", "query_id")
    native = sorted(map(tuple, C.nearest_native(asked, table, 3).select("query_id", "vector_id", F.col("distance") + 0.0, "rank").collect()))
    monkeypatch.setattr(C, "NATIVE_PAIRS", 10)
    large = C.nearest_native(asked, table, 3)
    assert "MapInArrow" in large._jdf.queryExecution().toString()
    assert sorted(map(tuple, large.select("query_id", "vector_id", "distance", "rank").collect())) == native


def test_candidates_are_ranked_once_per_name(spark):
    n = 400
    m = spark.createDataFrame([(i, "t", "Anna Stone") for i in range(n)] + [(0, "t", "Anna Stones"), (None, "t", "Anna Stone")], "mention_id long, type string, name string")
    e = spark.createDataFrame([(f"e{i:04}", "t", "Anna Stone" if i % 2 else "Anna Stones", f"{i:04}") for i in range(n)], "entity_id string, type string, name string, founded string")
    got = C.name_candidates(m, e, k=3)
    found = {}
    for r in got.collect():
        found.setdefault(r["mention_id"], []).append((r["pos"], r["entity_id"]))
    assert len(found) == n + 1
    assert all(sorted(v) == [(1, "e0000"), (2, "e0001"), (3, "e0002")] for k, v in found.items() if k != 0)
    assert sorted(found[0]) == [(1, "e0000"), (2, "e0000"), (3, "e0001")]  # two rows of one mention share its places
    # without copies of an id no window orders mentions any more
    plan = C.name_candidates(m.where("mention_id > 0"), e, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(mention_id" not in plan


def test_name_rules_equal_the_rules(spark):
    names = ["City of Bar", "C.O.B.", "cb", "", None, "of the", "Ännä Bar", "BAR-foo", "f", "Foo Bar Baz", "fbb"]
    one = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = one.crossJoin(one.withColumnRenamed("a", "b"))
    a, b = F.col("a"), F.col("b")
    ra, rb = T.name_rules(a), T.name_rules(b)
    rows = pairs.select("a", "b", T.shares_token(a, b), T.rules_share_token(ra, rb), T.acronym_related(a, b), T.rules_acronym(ra, rb), T.looks_related(a, b), T.rules_related(ra, rb)).collect()
    assert len(rows) == len(names) ** 2
    assert all(r[2] == r[3] and r[4] == r[5] and r[6] == r[7] for r in rows)


@pytest.mark.parametrize("name", ["shares_token", "acronym_related", "looks_related"])
def test_no_pattern_is_matched_per_pair(spark, sf, name):
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    head = plan.split("Join Inner")[0]
    assert "split(" not in head and "regexp_replace(" not in head


def test_guard_sends_only_names_at_stake(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("Anna Stone", "Bob Miller", "embedding", "same", "r"), ("Anna Stone", "Bob Miller", "jaro_winkler", "same", "r"), ("Anna Stone", "Bob Miller", "embedding", "different", "r"), ("the judge", "Bob Miller", "embedding", "same", "r")],
        "mention_name string, name string, source string, verdict string, reason string",
    )
    monkeypatch.setattr(S, "jaro_winkler", lambda variant: lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.lit(0.1)))
    got = [tuple(r) for r in J.guard_rows(rows).select("verdict", F.col("reason") == "r").collect()]
    assert got == [("unsure", False), ("same", True), ("different", True), ("same", True)]


def test_equal_pairs_of_a_batch_are_compared_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(S, "jaro_winkler_arrays", lambda a, b, v: asked.extend(a) or np.ones(len(a)))
    import pandas as pd

    out = S.jaro_winkler().func(pd.Series(["a", "a", None, "b"]), pd.Series(["x", "x", "x", "x"]))
    assert asked == ["a", "b"] and out.isna().tolist() == [False, False, True, False]


def test_union_sorts_bounded_tasks(spark, tmp_path, monkeypatch):
    from lexweave import durable

    monkeypatch.setattr(durable, "TASK_ROWS", 10)
    assert durable.partitions(spark, 1000) == 100
    li = spark.range(1000).selectExpr("id div 4 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 4 + 1 as int) as l_linenumber", "1.0D as l_quantity", "1.0D as l_extendedprice")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = Q.QUERIES["union_candidates"](spark, str(tmp_path))
    assert "hashpartitioning(mention_id" in found._jdf.queryExecution().executedPlan().toString() and found.rdd.getNumPartitions() == 200
    assert found.count() == 1000


def test_a_batch_leaves_only_its_results(spark, tmp_path):
    from test_resolution import mentions

    from lexweave import durable
    from lexweave.models import RuleJudge
    from lexweave.operators import resolution as R

    before = len(durable._written)
    out = R.resolve_batch(mentions(spark), R.Graph(spark, str(tmp_path)), 0, RuleJudge())
    left = [path.rsplit("/", 1)[1].split("-")[1] for _, path in durable._written[before:]]
    assert not {"batch", "candidates", "judgments"} & set(left)
    assert out.where("error is null").count() == 8
