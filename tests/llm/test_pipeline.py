"""The pipeline stage by stage, each against a plain version on its own input; the registry; the removal guard."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_near_dup import plain as plain_groups

import corpus_pipeline as P

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert len(P.STAGES) == 5


def test_language(stages):
    assert ids(stages[1]) <= ids(stages[0]) and len(ids(stages[1])) >= 0.98 * len(ids(stages[0]))
    assert not [r for r in stages[1].collect() if not re.search(r"[^\W\d_]", r["text"])]


def test_lines(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[1].collect()]
    want = {d: t for d, t, _ in plain_lines(rows, 10)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[2].collect()}
    assert {d: t for d, (t, _) in got.items()} == want
    assert any(t != o for (_, t, _), o in zip(sorted(rows), (want[k] for k in sorted(want))))
    assert all(n == len(t) for t, n in got.values() if t != dict((d, x) for d, x, _ in rows)[next(k for k, v in got.items() if v[0] == t)])


def test_groups(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == {i for i, _, _, kept in plain_groups(rows, 80) if kept}


def test_benchmark(spark, stages):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("b"))
    held = ids(stages[3].join(F.broadcast(items), F.contains("text", "b")))
    assert ids(stages[4]) == ids(stages[3]) - held


def test_packed(stages):
    assert ids(stages[5]) == ids(stages[4])
    fill = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m"))
    assert fill.where("n > 1024 or k <> m").count() == 0


def test_run(spark, stages):
    same = ["doc_id", "piece", "length", "ids_crc32"]
    got = P.run(spark, SF)
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, stages[5].select(*same).collect()))


def test_odd_rows(spark):
    """Columns with the operators' own names keep their values through every stage."""
    own = "score string, rejected int, lang_pred string, n_removed string, _h string, _id string, _gone string, root string, h string, rep string, _text string, _copy string, _bad string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + own
    mine = [f.split()[0] for f in own.split(", ")]
    values = ["mine" if f.endswith("string") else 1 for f in own.split(", ")]
    rows = [(None, None, None, None, None, *values), (1, "", "en", "s", 0, *values), (2, "the of and is it", None, None, None, *values), (2, "the of and is it", None, None, None, *values)]
    rows += [(10 + i, f"a line that all sites share\nthe words of number {i} and of none other in this house", "en", f"site{i}", 0, *values) for i in range(12)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = not df.isEmpty()
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, df, SF).cache()
            assert out.count() > 0 or not some
            if k < 4:
                assert out.dtypes == df.dtypes
                assert {tuple(r) for r in out.select(*mine).collect()} <= {tuple(values)}
                df = out
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sum(r["doc_id"] == 2 for r in kept) == 1  # a repeated row is an exact copy


def test_registry():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_rest_works_without_this_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r"), "HOME": str(tmp_path)})
