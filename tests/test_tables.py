"""Table maintenance, extraction, judgment and retrieval on small fixtures."""

import json

from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.config import Settings
from lexweave.models import HashingEmbedder, RuleExtractor
from lexweave.operators import candidates as C
from lexweave.operators import extraction as X
from lexweave.operators import judgment as J
from lexweave.operators import retrieval as R
from lexweave.operators import tables as B


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_unprocessed_and_mark(spark):
    df = spark.createDataFrame([("a", None), ("b", False), ("c", True)], "chunk_id string, dedup_processed boolean")
    assert values(B.unprocessed(df).select("chunk_id")) == [("a",), ("b",)]
    done = spark.createDataFrame([("a",), ("a",), ("z",)], "chunk_id string")
    assert values(B.mark_processed(df, done)) == [("a", True), ("b", False), ("c", True)]


def test_replace_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("f", 0), ("f", 1), ("g", 0)], "source_file string, i int")
    new = spark.createDataFrame([("f", 0)], "source_file string, i int")
    once = B.replace_by_source(old, new)
    assert values(once) == values(B.replace_by_source(once, new)) == [("f", 0), ("g", 0)]
    path = str(tmp_path / "t")
    for rows in (old, new, new):
        B.write_replacing(rows, path)
    assert values(spark.read.parquet(path).select("source_file", "i")) == [("f", 0), ("g", 0)]


def test_a_source_without_rows_is_replaced(spark, tmp_path):
    old = spark.createDataFrame([("x.pdf", 0), ("y.pdf", 0), ("z.pdf", 0)], "source_file string, i int")
    none, done = old.where("false"), spark.createDataFrame([("x.pdf",)], "source_file string")
    assert values(B.replace_by_source(old, none, sources=done)) == [("y.pdf", 0), ("z.pdf", 0)]
    path = str(tmp_path / "t")
    B.write_replacing(old, path)
    for _ in range(2):
        B.write_replacing(none, path, sources=done)
        assert values(spark.read.parquet(path).select("source_file", "i")) == [("y.pdf", 0), ("z.pdf", 0)]
    B.write_replacing(old, path, buckets=64)
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("bucket=")]) <= 3


def test_pending_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("b", 3)], "chunk_id string, n int")
    done = spark.createDataFrame([(None,), ("b",), ("b",)], "chunk_id string")
    assert values(B.pending(rows, done, "chunk_id")) == [("a", 2), ("a", 2)]
    assert values(B.present(rows, done, "chunk_id")) == sorted([(None, 1), ("b", 3)], key=repr)
    assert B.pending(rows, done.where("false"), "chunk_id").count() == 4


class Budgets:
    """Answers that get better with the larger budget; what was asked is kept in a file, as workers are other processes."""

    def __init__(self, answers, log):
        self.answers, self.log = answers, log

    def extract(self, text, budget):
        with open(self.log, "a") as f:
            f.write(f"{text} {budget}\n")
        return self.answers[text][budget > 1500]


def test_second_budget(spark, tmp_path):
    good = json.dumps({"entities": []})
    answers = {"whole": (good, "x"), "cut": ('{"entities": [', good), "without": ('{"other": 1}', good), "nulls": ('{"entities": [null]}', good), "never": ("{}", "{}")}
    rows = spark.createDataFrame([(t, "f", 0, t) for t in answers], "chunk_id string, source_file string, chunk_index int, text string")
    got = X.parse_entities(X.run_model(rows.coalesce(1), Budgets(answers, str(tmp_path / "log")))).select("chunk_id", "error").collect()
    assert {r["chunk_id"] for r in got if r["error"]} == {"never"}
    asked = (tmp_path / "log").read_text().split("\n")[:-1]
    assert sorted(asked) == sorted(["whole 1500", *(f"{t} {b}" for t in ("cut", "without", "nulls", "never") for b in (1500, 3000))])


def test_chunks_of_long_texts_in_linear_time(spark):
    import time

    from lexweave.operators import chunking

    took = []
    for n in (50_000, 400_000):
        df = spark.range(1).select(F.lit("a.pdf").alias("source_file"), F.repeat(F.lit("word "), n).alias("text"))
        began = time.perf_counter()
        assert chunking.chunk_texts(df).agg(F.sum("word_count")).first()[0] >= n
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 2


def test_sections_are_never_mixed(spark):
    from lexweave.operators import chunking

    rows = [("a.pdf", 2, "x " * 400, "secret"), ("a.pdf", 1, "y " * 10, "public"), ("a.pdf", 3, None, None), ("a.pdf", 4, "z", None), ("b.pdf", 1, "", "public")]
    got = chunking.chunk_sections(spark.createDataFrame(rows, "source_file string, section int, text string, classification string")).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["section"], r["word_count"], r["classification"], set(r["text"].split())) for r in got] == [
        ("a_0", 1, 10, "public", {"y"}), ("a_1", 2, 350, "secret", {"x"}), ("a_2", 2, 100, "secret", {"x"}), ("a_3", 4, 1, None, {"z"}),
    ]


def test_upsert_with_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(None, "x"), (3, "y")], "k int, v string")
    assert values(B.upsert(old, new, "k")) == sorted([(1, "a"), (2, "c"), (None, "x"), (3, "y")], key=repr)


def test_limit_before_and_after_resume(spark):
    rows = spark.createDataFrame([(f"c{i}",) for i in range(6)], "chunk_id string")
    done = rows.where("chunk_id in ('c0', 'c2')")
    assert values(B.limited(rows, done, 3, "chunk_id")) == [("c1",), ("c3",), ("c4",)]
    assert values(B.limited(rows, done, 3, "chunk_id", count_done=True)) == [("c1",)]


def test_ddl_and_keys(spark):
    B.drop(spark, "lexweave_t")
    B.create(spark, "lexweave_t", schemas.ENTITIES, "type")
    B.create(spark, "lexweave_t", schemas.ENTITIES, "type")
    assert spark.table("lexweave_t").count() == 0
    B.drop(spark, "lexweave_t")
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert values(B.key_difference(a, a, "k")) == []
    assert values(B.key_difference(a, a.where("k = 'x'"), "k")) == [("y", "left")]


class Failing:
    def extract(self, text, budget):
        if "crash" in text:
            raise OSError("server gone")
        if "late" in text and budget < 2000:
            return '{"entities": ['
        if "broken" in text:
            return "no json"
        return RuleExtractor().extract(text, budget)


def test_extraction_and_failures(spark):
    texts = ["Anna Stone met Bob Miller on 01/05/24", "crash", "late Anna Stone", "broken", "nothing", None]
    chunks = spark.createDataFrame([(f"f_{i}", "f", i, t) for i, t in enumerate(texts)], "chunk_id string, source_file string, chunk_index int, text string")
    good, bad = X.extract(chunks, Failing())
    got = {r["chunk_id"]: ([e["name"] for e in r["entities"]], r["dates"]) for r in good.collect()}
    assert got == {"f_0": (["Anna Stone", "Bob Miller"], ["01/05/24"]), "f_2": (["Anna Stone"], []), "f_4": ([], []), "f_5": ([], [])}
    failed = {r["chunk_id"]: r["error"] for r in bad.collect()}
    assert set(failed) == {"f_1", "f_3"} and "server gone" in failed["f_1"]
    found = X.mentions(good, chunks.where("chunk_id <> 'f_2'"))
    by_id = {(r["chunk_id"], r["name"]): (r["snippet"], r["error"]) for r in found.collect()}
    assert by_id[("f_0", "Anna Stone")] == ("Anna Stone met Bob Miller on 01/05/24", None)
    assert by_id[("f_2", "Anna Stone")][1] is not None


def test_review_flag(spark):
    e = lambda c: ("n", "person", "none", "n", c)
    df = spark.createDataFrame([("a", [e("explicit"), e("resolved_from_context")]), ("b", [e("explicit")]), ("c", []), ("d", None)], f"id string, entities array<{schemas.ENTITY}>")
    from lexweave.functions.text import needs_review

    assert values(df.select("id", needs_review(F.col("entities")))) == [("a", True), ("b", False), ("c", False), ("d", False)]


def judged(spark, *verdicts):
    return spark.createDataFrame([("m", i + 1, f"e{i}", v, "r") for i, v in enumerate(verdicts)], "mention_id string, pos int, entity_id string, verdict string, reason string")


def test_outcomes(spark):
    r = J.outcome(judged(spark, "unsure", "same", "same")).first()
    assert r["merged_into"] == "e1" and r["flags"] == []
    r = J.outcome(judged(spark, "unsure", "different", "unsure")).first()
    assert r["merged_into"] is None and [f["entity_id"] for f in r["flags"]] == ["e0", "e2"]


def test_guard(spark):
    cases = [("Alice Stone", "Bob Miller", "embedding", "same", "unsure"), ("Alice Stone", "Bob Miller", "jaro_winkler", "same", "same"), ("defense counsel", "Bob Miller", "embedding", "same", "same"), ("Alice Stone", None, "embedding", "same", "same"), ("Alice Stone", "Bob Miller", "embedding", "different", "different"), ("Alice Stone", "Alice Stones", "embedding", "same", "same")]
    df = spark.createDataFrame([(i, *c[:4], "r", c[4]) for i, c in enumerate(cases)], "i int, mention_name string, name string, source string, verdict string, reason string, want string")
    assert all(r["verdict"] == r["want"] for r in J.guard_rows(df).collect())
    changed = J.guard_rows(df).where("i = 0").first()
    assert "Alice Stone" in changed["reason"] and "Bob Miller" in changed["reason"]


def test_mismatch_is_an_error(spark):
    df = spark.createDataFrame([(["a"], ["x", "y"]), (["a"], ["x"])], "c array<string>, j array<string>")
    got = df.select(J.zip_judgments(F.col("c"), F.col("j")).alias("z"), J.count_mismatch(F.col("c"), F.col("j")).alias("e")).collect()
    assert got[0]["z"] is None and got[0]["e"] == "2 judgments for 1 candidates"
    assert len(got[1]["z"]) == 1 and got[1]["e"] is None


def test_completion(spark):
    jobs = spark.createDataFrame([("none", None), ("all", 0), ("all", 1), ("some", 0), ("some", 1), ("missing", 0)], "chunk_id string, entity_index int")
    results = spark.createDataFrame([("all", 0, True), ("all", 1, True), ("some", 0, True), ("some", 1, False)], "chunk_id string, entity_index int, ok boolean")
    assert values(J.completion(jobs, results)) == [("all", True), ("missing", False), ("none", True), ("some", False)]


def test_union_keeps_what_the_name_channel_knows(spark):
    a = spark.createDataFrame([("m", "e1", "N", 1)], "mention_id string, entity_id string, name string, pos int")
    b = spark.createDataFrame([("m", "e1", "N", "c1", "s1", 1), ("m", "e2", None, "c2", "s2", 2)], "mention_id string, entity_id string, name string, chunk_id string, snippet string, pos int")
    got = C.union_candidates(a, b).first()["candidates"]
    assert [(c["entity_id"], c["source"], c["chunk_id"]) for c in got] == [("e1", "jaro_winkler", None), ("e2", "embedding", "c2")]
    assert len(C.union_candidates(a, b, 1).first()["candidates"]) == 1


def test_embedder(spark):
    df = spark.createDataFrame([("a", "some text"), ("b", None), ("c", "")], "id string, snippet string")
    got = {r["id"]: r["vector"] for r in C.embed(df, HashingEmbedder(16)).collect()}
    assert got["b"] is None and len(got["a"]) == 16 and abs(sum(x * x for x in got["a"]) - 1) < 1e-6


def test_rights(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["y", "x"]), ("c", []), ("d", None)], "id string, acl_groups array<string>")
    assert values(R.visible(df, ["y"]).select("id")) == [("b",)]
    assert R.visible(df, []).count() == 0
    edges = spark.createDataFrame([(1, 2, ["x"]), (2, 3, ["y"]), (3, 4, ["x"])], "src long, dst long, acl_groups array<string>")
    start = spark.createDataFrame([(1,)], "node long")
    assert values(R.hops(start, edges, ["x"], 3)) == [(1, 0), (2, 1)]
    assert values(R.hops(start, edges, ["x", "y"], 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_settings(spark, monkeypatch):
    assert Settings.load().chunk_words == 350
    monkeypatch.setenv("LEXWEAVE_CHUNK_WORDS", "100")
    assert Settings.load().chunk_words == 100
    spark.conf.set("spark.lexweave.name_threshold", "0.9")
    try:
        loaded = Settings.load(spark)
        assert loaded.name_threshold == 0.9 and loaded.chunk_words == 100
    finally:
        spark.conf.unset("spark.lexweave.name_threshold")


def test_shapes():
    from lexweave.operators import prompts

    shape = prompts.judgment_shape(3)["properties"]["judgments"]
    assert shape["minItems"] == shape["maxItems"] == 3
    assert json.dumps(prompts.extraction_shape()).count("enum") == 3
