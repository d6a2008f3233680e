"""Chat formatting: exact round trips of hostile texts, merging, and the loss mask."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from lexweave.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, _turns int"
BITS = ["<|", "|>", "<|end|>\n", "<|turn|>\n", "<|role:user|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\|", "<\\\\|end|>", "[\\/INST]", "<", "[", "$1", "\n", "é𝄞", "a", " ", "|", "%20", "+"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in sorted(group, key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), digest(*(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r["conv_id"]: tuple(r)[1:5] for r in C.digest(C.format_chats(df)).collect()}


def test_hostile_round_trips(spark):
    r = random.Random(4)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randint(0, 6)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "a|>\nb", "%", "<|end|>\n"]), text()) for c in range(300) for t in range(r.randint(1, 6))]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 5, "assistant", None), (None, 1, "user", "a"), (None, 1, "user", "a"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (3, 0, "assistant", "y" * 300_000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == {}


def test_merging_and_mask(spark):
    rows = [(1, 0, "user", "q", "", 0), (1, 1, "assistant", "a<|", "", 0), (1, 2, "assistant", "b", "", 0), (1, 3, "user", "r", "", 0)]
    got = C.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["formatted"] == "<|role:user|>\nq<|end|>\n<|role:assistant|>\na<\\|<|turn|>\nb<|end|>\n<|role:user|>\nr<|end|>\n"
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["loss_spans"]] == ["a<\\|", "b"]


def test_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i // 2 % 2], f"t{i}") for i in range(1500)]
    assert run(spark, rows) == plain(rows)


def test_time_follows_the_turns(spark):
    """Conversations of twice the turns take little more than twice as long: nothing is copied per turn."""
    import time

    took = []
    for n in (4_000, 16_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é some words "), "id").alias("text"))
        rows = rows.cache()
        rows.count()
        began = time.perf_counter()
        got = C.digest(C.format_chats(rows)).first()
        took.append(time.perf_counter() - began)
        texts = [f"é some words {i}" for i in range(1, n, 2)]
        assert got["n_turns"] == n and got["loss_sha256"] == digest(*texts)
    assert took[1] < 10 * took[0] + 2


def test_ties_go_by_the_text_before_escaping(spark):
    rows = [(1, 0, "user", "<|a"), (1, 0, "user", "<]b"), (1, 0, "user", "<\\")]
    got = C.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).select(C.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in got] == sorted(r[3] for r in rows)


def test_no_python_on_the_main_path(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    df = C.digest(C.format_chats(rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert df.count() == rows.select("conv_id").distinct().count()
    assert df.where(F.col("n_turns") == 0).count() == 0
