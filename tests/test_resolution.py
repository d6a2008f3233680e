"""The fold, micro-batches, the bulk forest and the clean-up."""

import pytest

from lexweave.models import HashingEmbedder, RuleJudge
from lexweave.operators import candidates as C
from lexweave.operators import resolution as R

COLUMNS = "source_file string, chunk_index int, entity_index int, name string, type string, chunk_id string, role string, textual_evidence string, confidence string, mention_text string, snippet string"
NAMES = ["Anna Stone", "Bob Miller", "Anna Stone", "Anna Stones", "defense counsel", "Robert Miller", "Anna Stonee", "Bob Miller"]


def mentions(spark, names=NAMES):
    rows = [(f"f{i // 4}", i % 4, 0, n, "person" if i % 8 != 5 else "court", f"f{i // 4}_{i % 4}", "none", n, "explicit", n, f"they saw {n} there" if i != 6 else None) for i, n in enumerate(names)]
    return R.mention_rows(C.embed(spark.createDataFrame(rows, COLUMNS), HashingEmbedder()))


class Counting(RuleJudge):
    def judge(self, mention, candidates):
        assert candidates, "the judge is never asked without candidates"
        return super().judge(mention, candidates)


def test_fold(spark):
    got = {r["mention_id"]: r for r in R.fold(mentions(spark), Counting()).collect()}
    assert len(got) == len(NAMES)
    ids = [got[f"f{i // 4}_{i % 4}#0"]["entity_id"] for i in range(len(NAMES))]
    assert ids[0] == ids[2] == ids[3] == ids[6] and ids[1] == ids[7]
    assert len({ids[0], ids[1], ids[4], ids[5]}) == 4
    with pytest.raises(ValueError):
        R.fold(mentions(spark), Counting(), rows=3)


def test_batches_of_one_equal_the_fold(spark, tmp_path):
    rows = mentions(spark, NAMES[:6])
    want = {r["mention_id"]: r["entity_id"] for r in R.fold(rows, RuleJudge()).collect()}
    graph = R.Graph(spark, str(tmp_path))
    R.resolve_batches(rows, graph, Counting(), 1)
    edges = graph.read("mentioned_in").collect()
    assert {f"{r['chunk_id']}#{r['entity_index']}": r["entity_id"] for r in edges} == want
    assert {r["entity_id"] for r in graph.read("entities").collect()} == set(want.values())


def test_retry_adds_nothing_and_clean_up_repairs_the_race(spark, tmp_path):
    rows = mentions(spark)
    graph = R.Graph(spark, str(tmp_path))
    for _ in range(2):
        R.resolve_batch(rows, graph, 0, Counting())
    assert graph.read("mentioned_in").count() == len(NAMES)
    entities = graph.read("entities")
    assert entities.count() == len(NAMES)  # one batch sees only what was there before it
    assert graph.read("entity_mentions").count() == len(NAMES) - 1  # a mention without a place has no vector
    roots = R.clean_up(entities, RuleJudge())
    fixed = R.repoint(graph.read("mentioned_in").select("chunk_id", "entity_id"), roots, "entity_id")
    got = {r["chunk_id"]: r["entity_id"] for r in fixed.collect()}
    want = {r["mention_id"][:-2]: r["entity_id"] for r in R.fold(rows, RuleJudge()).collect()}
    assert got == want
    flags = spark.createDataFrame([(r["entity_id"], r["root"]) for r in roots.collect()], "a string, b string")
    assert R.repoint(flags, roots, "a", "b").count() == 0


class Wrong(RuleJudge):
    def judge(self, mention, candidates):
        return super().judge(mention, candidates) * 2


def test_wrong_answers_write_nothing(spark, tmp_path):
    rows = mentions(spark)
    graph = R.Graph(spark, str(tmp_path))
    R.resolve_batch(rows.where("mention_id = 'f0_0#0'"), graph, 0, RuleJudge())
    out = R.resolve_batch(rows.where("mention_id in ('f0_1#0', 'f0_2#0')"), graph, 1, Wrong())
    errors = {r["mention_id"]: r["error"] for r in out.collect()}
    assert errors["f0_1#0"] is None and "2 judgments for 1" in errors["f0_2#0"]
    assert graph.read("mentioned_in").count() == 2


def test_bulk_forest_never_merges_roots(spark):
    got = {r["mention_id"]: r["entity_id"] for r in R.resolve_bulk(mentions(spark)).collect()}
    ids = [got[f"f{i // 4}_{i % 4}#0"] for i in range(len(NAMES))]
    assert ids[0] == ids[2] == ids[3] and ids[1] == ids[7] and ids[0] != ids[1] and ids[5] not in ids[:5]


def test_components(spark):
    from lexweave.durable import components

    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (7, 7), (200, 102)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in (100, 101, 102, 200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class CountedEmbedder(HashingEmbedder):
    """Notes every text that it is asked for, in a file, as workers are other processes."""

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return super().embed(texts)


def test_each_vector_is_computed_once(spark, tmp_path):
    embedder = CountedEmbedder()
    object.__setattr__(embedder, "log", str(tmp_path / "log"))
    rows = [(f"f{i}", i, 0, n, "person", f"f{i}_{i}", "none", n, "explicit", n, f"text {i}") for i, n in enumerate(NAMES)]
    lazy = C.embed(spark.createDataFrame(rows, COLUMNS), embedder)
    R.resolve_batches(lazy, R.Graph(spark, str(tmp_path / "graph")), RuleJudge(), 4)
    asked = (tmp_path / "log").read_text().split("\n")[:-1]
    assert sorted(asked) == sorted(f"text {i}" for i in range(len(NAMES)))


def test_clean_up_of_a_hot_name_is_linear(spark, tmp_path):
    n = 3000
    rows = [(f"e{i:05d}", "Anna Stone", "person", f"{i:05d}") for i in range(n)] + [("x", "Anna Stones", "person", "99999"), ("y", "Carl Brook", "person", "99998")]
    got = {r["entity_id"]: r["root"] for r in R.clean_up(spark.createDataFrame(rows, "entity_id string, name string, type string, founded string"), RuleJudge()).collect()}
    assert len(got) == n + 2 and got["y"] == "y"
    assert {root for e, root in got.items() if e != "y"} == {"e00000"}
