"""Functions over texts and names, on the regression cases of the fixtures and on random input."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import names as N
from lexweave.functions import text as T
from lexweave.operators import chunking


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **values):
    """The value of a column expression over one row of string columns."""
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def plain_chunks(words, size=350, overlap=50):
    out, start = [], 0
    while start < len(words):
        out.append(words[start : start + size])
        if start + size >= len(words):
            break
        start += size - overlap
    return out


def test_chunk_counts(spark):
    sizes = [0, 1, 349, 350, 351, 649, 650, 651, 950, 951]
    docs = spark.createDataFrame([(f"d{n}.pdf", " ".join(f"w{i}" for i in range(n))) for n in sizes], "source_file string, text string")
    got = {}
    for r in chunking.chunk_texts(docs).collect():
        got.setdefault(r["source_file"], {})[r["chunk_index"]] = r["text"]
    for n in sizes:
        want = [" ".join(c) for c in plain_chunks([f"w{i}" for i in range(n)])]
        assert [t for _, t in sorted(got.get(f"d{n}.pdf", {}).items())] == want
    totals = {r[0]: (r[1], r[2]) for r in chunking.summaries(docs).collect()}
    assert totals == {f"d{n}.pdf": (n, len(plain_chunks(list(range(n))))) for n in sizes}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(3, 9), st.integers(0, 2))
def test_pages(spark, sizes, size, overlap):
    pages = [("a.pdf", k + 1, " ".join(f"p{k}w{i}" for i in range(n))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(pages, "source_file string, page int, text string")
    words = [(f"p{k}w{i}", k + 1) for k, n in enumerate(sizes) for i in range(n)]
    want = [(i, " ".join(w for w, _ in c), len(c), c[0][1], c[-1][1]) for i, c in enumerate(plain_chunks(words, size, overlap))]
    got = chunking.chunk_pages(df, size, overlap).select("chunk_index", "text", "word_count", "page_start", "page_end")
    assert sorted(rows(got)) == want


def test_null_and_unicode_space(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y z \t\n")], "source_file string, text string")
    assert rows(chunking.chunk_texts(df).select("source_file", "text")) == [("c", "x y z")]
    assert sorted(rows(chunking.summaries(df))) == [("a", 0, 0), ("b", 0, 0), ("c", 3, 1)]


@pytest.mark.parametrize("path,index,want", [("/a/b.c.pdf", 3, "b.c_3"), (".hidden", 0, ".hidden_0"), ("plain", 1, "plain_1"), ("x.PDF", 2, "x_2")])
def test_chunk_id(spark, path, index, want):
    assert one(spark, T.chunk_id(F.col("p"), F.lit(index)), p=path) == want


def test_patterns(spark):
    text = "1:15-cv-07433-LAP and CASE NO. 15-CV-07433-RWS and 1:15-cv-07433-LAP, x15-cv-07433y"
    assert one(spark, T.docket_numbers(F.col("t")), t=text) == ["1:15-cv-07433-LAP", "15-CV-07433-RWS"]
    text = "Sept. 5, 2024; Jan. 5 2024; 01/05/24; may 5, 2024; May 5, 2024; 01/05/24; December 31, 1999; Jun 1 20245"
    assert one(spark, T.dates(F.col("t")), t=text) == ["Sept. 5, 2024", "Jan. 5 2024", "01/05/24", "May 5, 2024", "December 31, 1999"]


@pytest.mark.parametrize(
    "kind,name,evidence,noise",
    [("person", "Acme v. Stone", "", True), ("reference", "Ann Stone", "", True), ("person", "Ann Stone", "see Decl. at 3", True), ("person", "Ann Stone", "counsel", False), ("court", "exhibit 4", None, True), ("person", "Exhibited", "DE38", False), (None, None, None, False)],
)
def test_noise(spark, kind, name, evidence, noise):
    assert one(spark, T.is_noise(F.col("k"), F.col("n"), F.col("e")), k=kind, n=name, e=evidence) is noise


@pytest.mark.parametrize("name,generic", [("defense counsel", True), ("the Clerk of the Court", True), ("Ann Stone", False), ("", True), (None, True), ("Judgement", False), ("Counselor", False), ("JUDGE X", True), ("écounsel", True)])
def test_generic(spark, name, generic):
    assert one(spark, T.looks_generic(F.col("n")), n=name) is generic
    assert N.looks_generic(name) is generic


@pytest.mark.parametrize(
    "a,b,related",
    [("S.D.E.F.", "Southern District of East Foo", True), ("Bank of Foo", "City of Bar", True), ("Alice Stone", "Bob Miller", False), ("AB", "Alpha Beta", True), ("A", "Alpha", False), ("José Ruiz", "Jos", True), ("", "", False)],
)
def test_related(spark, a, b, related):
    assert one(spark, T.looks_related(F.col("a"), F.col("b")), a=a, b=b) is related
    assert N.looks_related(a, b) is related


def plain_snippet(text, evidence, name, n=15):
    for needle in (evidence, name):
        if needle and needle in text:
            i = text.index(needle)
            return " ".join(text[:i].split()[-n:] + [needle] + text[i + len(needle) :].split()[:n])
    return None


@settings(max_examples=25, deadline=None)
@given(st.text("ab \n", max_size=60), st.text("ab ", max_size=4), st.text("ab", max_size=3), st.integers(1, 3))
def test_snippet(spark, text, evidence, name, n):
    column = T.snippet(F.col("t"), T.locate(F.col("t"), F.col("e"), F.col("n")), n)
    assert one(spark, column, t=text, e=evidence, n=name) == plain_snippet(text, evidence, name, n)


def test_window_count_formula(spark):
    got = spark.range(0, 3000).select(T.window_count(F.col("id").cast("int")).alias("k")).collect()
    assert [r["k"] for r in got] == [0 if n == 0 else 1 if n <= 350 else math.ceil((n - 350) / 300) + 1 for n in range(3000)]
