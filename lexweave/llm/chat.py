"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into blocks by array
aggregation, and blocks are concatenated. A block is::

    <|role:user|>\\ntext<|turn|>\\ntext of the same role's next turn<|end|>\\n

Control strings inside texts are escaped: a backslash goes after their opening character, after any that are there.
Reading back takes one away again, so every text returns exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, TURN, CLOSE = "<|end|>\n", "<|turn|>\n", "|>\n"
OPEN = "<|role:"
#: The role whose texts are trained on.
ASSISTANT = "assistant"
#: What makes a control string after ``<`` or ``[``: this template's own and those of common templates.
_TAIL = r"\||/?s>|</?SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({_TAIL})"
_UNESCAPE = rf"([<\[])\\(\\*)({_TAIL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


_SPAN = "struct<start:bigint,length:bigint>"


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(CLOSE))


def _pieces(n: Column) -> Column:
    """About the square root of ``n``: arrays are gone through in so many pieces, as appending copies what is there."""
    return F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))


def _cut(items: str, step: str) -> Column:
    """The array in pieces of ``step``, none for an empty one."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.col(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at, F.col(step)))


def _before(sizes: Column, first: Column) -> Column:
    """Running totals before each element of an array, on top of ``first``."""
    start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, start, step)["out"]


def format_chats(rows: DataFrame, trained: str = ASSISTANT) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to one row per conversation: ``formatted`` and ``loss_spans``.

    Turns go by ``turn``, ties by role and text, a null turn first. Null texts and roles are empty; rows of a null
    ``conv_id`` form one conversation; repeated rows are turns of their own; other columns are ignored; an empty table
    gives no rows. A conversation is one string, so its turns are collected in one place by definition; the time grows
    little faster than their number. A span gives start (from 0) and length in code points.
    """
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default))
    turn = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    # each step is a column of its own that the next one uses twice or more, so that none is evaluated per element
    turns = turns.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("_t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i)["role"] != F.get("_t", i - 1)["role"]))
    turns = turns.withColumn("_s", starts)
    # blocks of adjacent turns of one role
    one = lambda s, k: F.slice("_t", s + 1, F.coalesce(F.get("_s", k + 1), F.size("_t")) - s)
    blocks = turns.select("conv_id", F.transform("_s", lambda s, k: F.struct(F.get("_t", s)["role"].alias("role"), F.transform(one(s, k), lambda t: t["text"]).alias("texts"))).alias("_b"))
    whole = F.transform("_b", lambda b: F.concat(_head(b["role"]), F.array_join(b["texts"], TURN), F.lit(END)))
    # sizes of all that comes before each text: its block's head, or the end of the turn before it
    sized = F.transform("_b", lambda b: F.transform(b["texts"], lambda x, k: F.struct(
        (b["role"] == trained).alias("mine"), F.length(x).cast("bigint").alias("n"),
        F.when(k == 0, F.length(_head(b["role"]))).otherwise(0).cast("bigint").alias("head"),
        F.when(k == F.size(b["texts"]) - 1, len(END)).otherwise(len(TURN)).cast("bigint").alias("tail"),
    )))
    out = blocks.select("conv_id", F.array_join(whole, "").alias("formatted"), F.flatten(sized).alias("_z"))
    out = out.withColumn("_step", _pieces(F.size("_z")))
    out = out.withColumn("_p", _cut("_z", "_step"))
    total = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda s, z: s + z["head"] + z["n"] + z["tail"])
    out = out.withColumn("_at", _before(F.transform("_p", total), F.lit(0).cast("bigint")))
    placed = F.transform("_p", lambda p, k: F.struct(p.alias("z"), _before(F.transform(p, lambda z: z["head"] + z["n"] + z["tail"]), F.get("_at", k)).alias("at")))
    out = out.withColumn("_p", placed)
    spans = F.flatten(F.transform("_p", lambda p: F.zip_with(p["z"], p["at"], lambda z, at: F.struct(z["mine"].alias("mine"), (at + z["head"]).alias("start"), z["n"].alias("length")))))
    mine = F.transform(F.filter(spans, lambda x: x["mine"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return out.select("conv_id", "formatted", mine.cast(f"array<{_SPAN}>").alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    # splitting takes a regular expression; the closing empty part goes
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    blocks = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, CLOSE, 1)
        role = F.url_decode(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)))
        body = F.substring(block, F.length(head) + len(CLOSE) + 1, F.length(block))
        return F.transform(F.split(body, r"<\|turn\|>\n", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(chats: DataFrame, to: str) -> DataFrame:
    """``chats`` with the unescaped texts under the loss mask, one after the other, in column ``to``.

    A place in a string is found by counting from its start, so the string is cut into stretches first.
    """
    rows = chats.withColumn("_step", _pieces(F.size("loss_spans")))
    rows = rows.withColumn("_g", _cut("loss_spans", "_step"))
    last = lambda g: F.element_at(g, -1)["start"] + F.element_at(g, -1)["length"]
    piece = lambda g: F.substring("formatted", (g[0]["start"] + 1).cast("int"), (last(g) - g[0]["start"]).cast("int"))
    rows = rows.withColumn("_g", F.transform("_g", lambda g: F.struct(g.alias("s"), g[0]["start"].alias("at"), piece(g).alias("text"))))
    text = lambda p, s: unescape(F.substring(p["text"], (s["start"] - p["at"] + 1).cast("int"), s["length"].cast("int")))
    texts = F.transform("_g", lambda p: F.array_join(F.transform(p["s"], lambda s: text(p, s)), ""))
    return rows.withColumn(to, F.array_join(texts, "")).drop("_step", "_g")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what reading back the output gives."""
    back = read_loss(chats, "_loss").select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"), "_loss")
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation that holds control strings of its own.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '{_ESCAPE}', '\1\\\2\3', 'g'))
    + CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN {len(TURN)} ELSE {len(OPEN) + len(CLOSE)} + length(role) END
    + CASE WHEN lead(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE {len(END)} END AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
