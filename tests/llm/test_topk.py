"""Exact top-k against brute force, in one block and in many, with ties, nulls and odd vectors."""

import math

import numpy as np
import pytest

from lexweave.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block int"


def plain(rows, k=10, every=100):
    """Every row against every other row, in Python's integers."""
    cells = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        cells.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, x) in enumerate(cells):
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(cells) if m != n and len(y) == len(x)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "r", 7) for i, v in rows], SCHEMA)
    return sorted(map(tuple, K.top_k(df, **options).drop("n_resolved").collect()))


def vectors(n, dim, seed, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(dim) * scale).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("lists", [1, 2, 5])
@pytest.mark.parametrize("rows,queries", [(8192, 512), (37, 5)])
def test_brute_force(spark, monkeypatch, lists, rows, queries):
    monkeypatch.setattr(K, "ROWS", rows)
    monkeypatch.setattr(K, "QUERY_ROWS", queries)
    table = vectors(300, 6, 1)
    table += [(i, table[i - 290][1]) for i in range(300, 340)]  # ties
    assert run(spark, table, every=20, lists=lists) == plain(table, every=20)


def test_odd_rows(spark):
    table = vectors(30, 3, 2) + [(100, None), (200, [1.0, None, 0.0]), (300, [float("nan"), 0.0, 0.0]), (400, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (500, [0.5, 0.5]), (501, [0.1, -0.1]), (600, []), (601, []), (7, [9.0, 9.0, 9.0]), (3, table_row := [0.1, 0.2, 0.3]), (3, table_row)]
    assert run(spark, table, every=10) == plain(table, every=10)


def test_repeated_ids_are_rows_of_their_own(spark):
    table = vectors(25, 3, 5) + [(20, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (7, [0.5, 0.5, 0.5])]
    got = run(spark, table, every=10)
    assert got == plain(table, every=10)
    assert sum(q == 20 for q, *_ in got) == 30 and any(q == i == 20 for q, _, i, _ in got)


def test_few_entries_are_resolved(spark):
    table = vectors(4000, 16, 6)
    df = spark.createDataFrame([(i, v, 0, "r", 7) for i, v in table], SCHEMA)
    got = K.top_k(df, every=400).groupBy("query_id").agg({"n_resolved": "max"}).collect()
    assert len(got) == 10
    # how many depends on how a query's length is spread over the two lists
    assert all(10 <= r[1] < 0.25 * len(table) for r in got)


def test_what_fits_no_long_is_an_error(spark):
    for v in ([1e30, 1.0], [2.0**40, 1.0]):
        with pytest.raises(Exception, match="fit"):
            run(spark, [(0, v), (1, v)])


def test_large_components_are_exact(spark):
    table = [(i, v) for i, v in vectors(40, 4, 3, scale=2.0**18)]
    assert run(spark, table, every=10) == plain(table, every=10)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, vectors(4, 2, 4)) == plain(vectors(4, 2, 4))
    assert run(spark, []) == []
