"""The jobs end to end on a folder: ingest, extraction with failures and a retry, resolution with a failing judge and a retry."""

from lexweave import jobs
from lexweave.models import HashingEmbedder, RuleExtractor, RuleJudge


class Flaky(RuleExtractor):
    def extract(self, text, budget):
        if "crash" in text:
            raise OSError("gone")
        return super().extract(text, budget)


class Refusing(RuleJudge):
    def judge(self, mention, candidates):
        raise TimeoutError("no answer")


def test_folder(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "landing" / "u1").mkdir(parents=True)
    (tmp_path / "landing" / "u1" / "a.txt").write_text("they saw Anna Stone there\f" + "and Bob Miller too")
    (tmp_path / "landing" / "u1" / "b.txt").write_text("crash of Carl Weber")
    (tmp_path / "landing" / "u1" / "c.txt").write_text("no one here")
    (tmp_path / "landing" / "u1" / "d.txt").write_text("then Anna Stone again")
    jobs.main(["ingest", root, "--text"])
    assert jobs.read(spark, root, "chunks").count() == 4

    counts = lambda r: tuple(r.first()[c] for c in ("processed", "skipped", "failed"))
    assert counts(jobs.run_extraction(spark, root, Flaky(), limit=1)) == (1, 0, 0)
    assert counts(jobs.run_extraction(spark, root, Flaky())) == (2, 1, 1)
    assert [r["chunk_id"] for r in spark.read.json(f"{root}/failures_extraction").collect()] == ["b_0"]

    edges = lambda: sorted((r["chunk_id"], r["entity_index"]) for r in jobs.resolution.Graph(spark, f"{root}/graph").read("mentioned_in").collect())
    state = lambda df: {r["chunk_id"]: r["complete"] for r in df.collect()}
    assert state(jobs.run_resolution(spark, root, HashingEmbedder(), Refusing(), size=1)) == {"a_0": True, "c_0": True, "d_0": False}
    assert edges() == [("a_0", 0), ("a_0", 1)]
    assert spark.read.json(f"{root}/failures_resolution").first()["entity_name"] == "Anna Stone"

    assert counts(jobs.run_extraction(spark, root, RuleExtractor())) == (1, 3, 0)
    assert state(jobs.run_resolution(spark, root, HashingEmbedder(), RuleJudge())) == {"b_0": True, "d_0": True}
    assert edges() == [("a_0", 0), ("a_0", 1), ("b_0", 0), ("d_0", 0)]
    names = sorted(r["name"] for r in jobs.resolution.Graph(spark, f"{root}/graph").read("entities").collect())
    assert names == ["Anna Stone", "Bob Miller", "Carl Weber"]
    assert jobs.run_resolution(spark, root, HashingEmbedder(), RuleJudge()).count() == 0
