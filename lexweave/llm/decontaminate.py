"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: names, numbers and units turn into typed placeholders, everything else into lower-case words
without punctuation. Windows of ``WINDOW`` template tokens of the benchmark are hash-joined with those of the
documents. For the few documents with a hit, the windows are aligned again with the words behind them: a question that
was re-parameterised fills its slots consistently, one value of the document for one of the item, and one name of the
item for one of the document. Of an alignment where slots clash, the largest consistent part counts. A document is
contaminated by an item if consistent windows cover enough of the item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import broadcast_if_small, materialize

#: Template tokens of a window; items with fewer are matched as one window of their own length.
WINDOW = 8
#: Item tokens that consistent windows must cover; all of a shorter item.
COVERED = 13
#: Item windows that are broadcast at most, as hashes and with their words; beyond it joins shuffle, salted by document.
BROADCAST_HASHES, BROADCAST_WINDOWS = 500_000, 100_000
SALTS = 16

UNITS = (
    "km", "kilomet(?:er|re)s?", "cm", "mm", "met(?:er|re)s?", "miles?", "feet", "inch(?:es)?", "kg", "kilograms?", "grams?", "mg", "pounds?", "lbs?", "ton(?:ne)?s?",
    "lit(?:er|re)s?", "ml", "gallons?", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?", "dollars?", "cents?", "euros?", "percent", "degrees?", "mph",
    "watts?", "kw", "kwh", "volts?", "hz", "mhz", "ghz", "mb", "gb", "tb",
)

#: Private characters that mark a slot's type (name, number, unit), and one for a point or comma inside a number.
NAME, NUMBER, UNIT, POINT = "", "", "", ""
_MARKS = NAME + NUMBER + UNIT + POINT
_SLOT = f"^[{NAME}{NUMBER}{UNIT}]"


# Each step is a column of its own: an expression that is used more than once would be evaluated as often.


def marked(rows: DataFrame) -> DataFrame:
    """``rows(text, ...)`` with ``m``: the words with single spaces between them, each slot beginning with its mark.

    Empty for null or no word. A name is a capitalised word of two letters or more after a lower-case word, a name or a
    comma; a number has digits with points or commas inside; a unit follows a number, perhaps without a space.
    """
    m = F.col("m")
    rows = rows.withColumn("m", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("m", F.when(m.rlike(f"[{_MARKS}]"), F.translate(m, _MARKS, " " * len(_MARKS))).otherwise(m))
    rows = rows.withColumn("m", F.lower(F.regexp_replace(m, r"([\p{Ll},]) (?=\p{Lu}\p{Ll})", f"$1 {NAME}")))
    n = F.regexp_replace(m, r"(?<![\p{L}0-9])([0-9]+(?:[.,][0-9]+)*)", f"{NUMBER}$1")
    n = F.regexp_replace(n, rf"({NUMBER}[0-9.,]*[0-9]) ?({'|'.join(UNITS)})(?![\p{{L}}0-9])", f"$1 {UNIT}$2")
    n = F.regexp_replace(n, r"(?<=[0-9])[.,](?=[0-9])", POINT)
    rows = rows.withColumn("m", F.when(m.rlike("[0-9]"), n).otherwise(m))
    return rows.withColumn("m", F.trim(F.regexp_replace(m, rf"[^\p{{L}}\p{{N}}{_MARKS}]+", " ")))


def _split(words: Column) -> Column:
    return F.when(words != "", F.split(words, " ", -1)).otherwise(F.array().cast("array<string>"))


def template(words: Column) -> Column:
    """A marked text with its slots reduced to their marks."""
    return F.regexp_replace(words, f"([{NAME}{NUMBER}{UNIT}])[^ ]*", "$1")


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows(m, ...)`` with ``h``: a hash per template token."""
    slots = F.col("m").rlike(f"[{NAME}{NUMBER}{UNIT}]")
    rows = rows.withColumn("h", F.when(slots, template(F.col("m"))).otherwise(F.col("m")))
    return rows.withColumn("h", F.transform(_split(F.col("h")), lambda w: F.xxhash64(w)))


def _windowed(rows: DataFrame, n: int, to: str) -> DataFrame:
    """``rows(h, ...)`` with the hashes of all windows of ``n`` in column ``to``; none if there are fewer tokens.

    Spans double: a hash of two neighbouring spans is one of twice the length, and two spans that overlap make any
    other length. So a window costs a logarithmic number of hashes.
    """
    rows, span = rows.withColumn(to, F.col("h")), 1
    while span < n:
        apart = span if span * 2 <= n else n - span
        rest = F.greatest(F.size(to) - apart, F.lit(0))
        rows = rows.withColumn(to, F.zip_with(F.slice(to, F.lit(1), rest), F.slice(to, F.lit(1 + apart), rest), lambda x, y: F.xxhash64(x, y)))
        span += apart
    return rows


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(g, n, item_id, at, words, size): every window of every item. Items without words give none.

    An item counts as written, as written within a sentence (where its first word may be a name), and in lower case.
    """
    given = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    inside = marked(given.withColumn("text", F.concat(F.lit("a "), "text"))).withColumn("m", F.regexp_replace("m", "^a ?", ""))
    both = marked(given.union(given.withColumn("text", F.lower("text")))).select("item_id", "m")
    rows = materialize(both.union(inside.select("item_id", "m")).distinct(), "items")
    rows = materialize(_hashed(rows).select("item_id", "h", _split(F.col("m")).alias("w"), F.least(F.size("h"), F.lit(window)).alias("n")), "items")
    lengths = sorted(r[0] for r in rows.select("n").distinct().collect() if r[0])  # at most ``window`` values
    out = _placed(rows.where("n = 0"), window, "item_id", "w")
    for n in lengths:
        out = out.union(_placed(rows.where(F.col("n") == n), n, "item_id", "w"))
    return out.select("g", "n", "item_id", "at", F.slice("w", F.col("at") + 1, F.col("n")).alias("words"), F.size("w").alias("size"))


def _placed(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """A row per window of ``n``: the given columns, its place, hash and length."""
    return _windowed(rows, n, "g").select(*columns, F.posexplode("g").alias("at", "g"), F.lit(n).alias("n"))


def _join_windows(left: DataFrame, right: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Join the document side with the item side: broadcast below the bound, else with hot windows salted by document."""
    right, small = broadcast_if_small(right, bound)
    if small:
        return left.join(right, keys)
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "_salt"]).drop("_salt")


def _clash(x: Column, y: Column) -> Column:
    """Two filled slots don't fit: an item value with two document values, or two item names with one."""
    return ((x["b"] == y["b"]) & (x["d"] != y["d"])) | ((x["d"] == y["d"]) & (x["b"] != y["b"]) & x["d"].startswith(NAME))


def _consistent(rows: DataFrame, window: int) -> DataFrame:
    """``rows(ats, slots(place, b, d), size, ...)``, one per alignment, with ``places`` and ``pairs`` of its largest consistent part.

    Windows without a clashing slot always stay. The others stay within a stretch that has no clash in it, if its slots
    tell more than a shared template does: three distinct ones, or two that are unchanged.
    """
    n = F.least("size", F.lit(window))
    has = lambda at, place: (place >= at) & (place < at + n)
    distinct = lambda slots: F.array_distinct(F.transform(slots, lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))))
    within = lambda ats: distinct(F.filter("slots", lambda x: F.exists(ats, lambda at: has(at, x["place"]))))
    rows = rows.withColumn("_clash", F.filter("slots", lambda x: F.exists("slots", lambda y: _clash(x, y))))
    # the next clash of each slot; a stretch begins behind such a slot, and ends before the first clash of those in it
    later = lambda x: F.array_min(F.transform(F.filter("_clash", lambda y: (y["place"] > x["place"]) & _clash(x, y)), lambda y: y["place"]))
    rows = rows.withColumn("_next", F.filter(F.transform("_clash", lambda x: F.struct(x["place"].alias("i"), later(x).alias("j"))), lambda c: c["j"].isNotNull()))
    starts = F.array_union(F.array(F.lit(0)), F.transform("_next", lambda c: c["i"] + 1))
    end = lambda s: F.coalesce(F.array_min(F.transform(F.filter("_next", lambda c: c["i"] >= s), lambda c: c["j"])), F.col("size"))
    rows = rows.withColumn("_clear", F.filter("ats", lambda at: ~F.exists("_clash", lambda x: has(at, x["place"]))))
    rows = rows.withColumn("_parts", F.transform(starts, lambda s: F.filter("ats", lambda at: (at >= s) & (at + n <= end(s)))))
    tells = lambda p: (F.size(p) >= 3) | (F.size(F.filter(p, lambda x: x["b"] == x["d"])) >= 2)
    rows = rows.withColumn("_parts", F.transform("_parts", lambda ats: F.when(tells(within(ats)), F.array_union(ats, F.col("_clear"))).otherwise(F.col("_clear"))))
    places = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda at: F.sequence(at, at + n - 1))))
    sized = F.transform("_parts", lambda ats: F.struct(F.size(places(ats)).alias("n"), ats.alias("ats")))
    rows = rows.withColumn("_best", F.array_max(sized)["ats"])
    return rows.withColumn("places", places(F.col("_best"))).withColumn("pairs", within(F.col("_best"))).drop("_clash", "_next", "_clear", "_parts", "_best")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: int = COVERED) -> DataFrame:
    """(doc_id, item_id, n_covered, n_slots, n_changed) of every document and item that contaminates it.

    ``n_covered``: item tokens in consistent windows; ``n_slots``: distinct slots among them; ``n_changed``: slots that
    the document fills with another value, so above 0 a re-parameterised copy. Windows that are slots for the most part
    count only unchanged. Rows with a null id or text, or without words, match nothing; repeated rows count once; rows
    of one id with different texts are matched separately; other columns are ignored; empty tables give no rows.
    """
    items = materialize(item_windows(benchmark, window), "item-windows")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most ``window`` values
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")
    # first only hashes, to find the few documents that hold any window
    hashed = _hashed(marked(texts)).select("doc_id", "t", "h")
    for n in lengths:
        hashed = _windowed(hashed, n, f"g{n}")
    every = F.concat(*(F.col(f"g{n}") for n in lengths)) if lengths else F.array().cast("array<bigint>")
    hits = _join_windows(hashed.select("doc_id", "t", F.explode(every).alias("g")), items.select("g").distinct(), ["g"], BROADCAST_HASHES)
    held = materialize(hits.select("doc_id", "t").distinct(), "held")
    # then the places and words behind the hits, in these documents only
    found = marked(texts.join(held, ["doc_id", "t"], "left_semi")).select("doc_id", "t", "m").distinct()
    found = materialize(_hashed(found).select("doc_id", "t", _split(F.col("m")).alias("w"), "h"), "held-words")
    places = reduce(DataFrame.union, [_placed(found, n, "doc_id", "t", "w").withColumnRenamed("at", "d_at") for n in lengths or [window]])
    wanted = items.select("g", "n").distinct()
    places = _join_windows(places, wanted, ["g", "n"], BROADCAST_HASHES).select(
        "doc_id", "t", "g", "n", "d_at", F.slice("w", F.col("d_at") + 1, F.col("n")).alias("d_words")
    )
    pairs = _join_windows(places, items, ["g", "n"], BROADCAST_WINDOWS)
    slots = F.size(F.filter("words", lambda w: w.rlike(_SLOT)))
    same = template(F.array_join("d_words", " ")) == template(F.array_join("words", " "))  # a hash alone is no proof
    pairs = pairs.where(same & ((2 * slots <= F.col("n")) | (F.col("d_words") == F.col("words"))))
    # windows of one alignment overlap: each place of the item counts once
    run = ["doc_id", "t", "item_id", "size", "shift"]
    pairs = pairs.withColumn("shift", F.col("d_at") - F.col("at"))
    zipped = pairs.select(*run, "at", F.posexplode(F.arrays_zip("d_words", "words")).alias("i", "z"))
    single = zipped.select(*run, "at", (F.col("at") + F.col("i")).alias("place"), F.col("z.words").alias("b"), F.col("z.d_words").alias("d"))
    judged = single.groupBy(*run).agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.sort_array(F.collect_set(F.when(F.col("b").rlike(_SLOT), F.struct("place", "b", "d")))).alias("slots")
    )
    whole = _consistent(judged, window).groupBy("doc_id", "t", "item_id").agg(
        F.min("size").alias("size"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_covered"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("slots"),
    )
    enough = whole.where(F.col("n_covered") >= F.least(F.col("size"), F.lit(covered)))
    changed = F.size(F.filter("slots", lambda s: s["b"] != s["d"]))
    counts = enough.select("doc_id", "item_id", F.col("n_covered").cast("long"), F.size("slots").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"))
    return counts.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_covered", "n_slots", "n_changed")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item contaminates; all other rows stay, those with null ids or texts too."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
