"""Jaro-Winkler against a plain implementation, the lossless bound, vectors, and both nearest-neighbour joins."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import similarity as S
from lexweave.operators import candidates as C


def plain(a, b, v=S.PUBLISHED):
    x, y = (a, b) if v.unit == "character" else (a.encode(), b.encode())
    if not x and not y:
        return 1.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    used, left = [False] * len(y), []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not used[j] and y[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(y, used) if u]
    t = sum(p != q for p, q in zip(left, right))
    t = t / 2 if v.halve == "exact" else t // 2
    jaro = (m / len(x) + m / len(y) + (m - t) / m) / 3
    n = next((k for k in range(min(4, len(x), len(y))) if x[k] != y[k]), min(4, len(x), len(y)))
    return jaro + n * 0.1 * (1 - jaro) if jaro > v.boost_above else jaro


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133), ("Acme Alicia", "Alice Roberta", 0.6059), ("", "", 1.0), ("a", "", 0.0)])
def test_published(a, b, want):
    assert S.jaro_winkler_arrays([a], [b])[0] == pytest.approx(want, abs=5e-5)
    assert S.jaro_winkler_arrays(["Acme Alicia"], ["Alice Roberta"], S.BYTES)[0] == pytest.approx(0.6297, abs=5e-5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12)), min_size=1, max_size=6), st.sampled_from([S.PUBLISHED, S.BYTES]))
def test_arrays(pairs, variant):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    got = S.jaro_winkler_arrays(a, b, variant)
    assert got == pytest.approx([plain(x, y, variant) for x, y in pairs])
    assert got == pytest.approx(S.jaro_winkler_arrays(b, a, variant), abs=0.2)


def test_bound_loses_nothing(spark):
    r = random.Random(3)
    names = {"".join(r.choice("abcde f") for _ in range(r.randint(1, 14))) for _ in range(150)}
    names |= {n[:-1] + r.choice("xyz") for n in list(names) if len(n) > 4} | {n + "son" for n in list(names)[:60]}
    df = spark.createDataFrame([(n, "t") for n in names], "name string, type string")
    for threshold in (0.6, 0.85):
        got = {(r[1], r[2]) for r in C.similar_names(df, df, threshold).collect()}
        assert got == {(a, b) for a, b in itertools.product(names, names) if plain(a, b) >= threshold}


def test_nearest_agree(spark):
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (60, 4)).astype(float)
    table = spark.createDataFrame([(i, "ab"[i % 2], v[i].tolist()) for i in range(60)] + [(98, "a", None), (99, "a", [0.0] * 4), (100, None, [1.0] * 4)], "vector_id long, type string, vector array<float>")
    asked = table.where("vector_id % 3 = 0").withColumnRenamed("vector_id", "query_id")
    a = sorted(map(tuple, C.nearest(asked, table, 4).select("query_id", "rank", "vector_id", "distance").collect()))
    assert a == sorted(map(tuple, C.nearest_native(asked, table, 4).select("query_id", "rank", "vector_id", F.col("distance") + 0.0).collect()))
    assert {q for q, *_ in a} <= set(range(60))
    assert C.nearest(asked.limit(0), table, 4).count() == 0


def test_nearest_in_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.standard_normal((90, 5))
    table = spark.createDataFrame([(f"v{i}", "t", v[i].tolist()) for i in range(90)], "vector_id string, type string, vector array<double>")
    asked = table.withColumnRenamed("vector_id", "query_id")
    want = sorted(map(tuple, C.nearest(asked, table, 3).collect()))
    monkeypatch.setattr(C, "VECTOR_BLOCK", 11)
    monkeypatch.setattr(C, "QUERY_BLOCK", 17)
    assert sorted(map(tuple, C.nearest(asked, table, 3).collect())) == want
    first = {q: x for q, x, d, k in want if k == 1}
    assert all(q == x for q, x in first.items())


def test_name_candidates_orders(spark):
    m = spark.createDataFrame([("m", "t", "Anna Stone")], "mention_id string, type string, name string")
    e = spark.createDataFrame([(f"e{i}", "t", n, f"{i:03}") for i, n in enumerate(["Anna Stones", "Anna Ston", "Bob", "Anna Stone"])], "entity_id string, type string, name string, founded string")
    assert [r["entity_id"] for r in C.name_candidates(m, e, k=2).orderBy("pos").collect()] == ["e0", "e1"]
    assert C.name_candidates(m, e, k=1, rank="score").first()["entity_id"] == "e3"
