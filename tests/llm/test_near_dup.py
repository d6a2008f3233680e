"""Near-duplicate groups against brute force on full shingle sets, and the parts that lead there."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import near_dup as N
from lexweave.llm import shingles as S

SCHEMA = "doc_id long, text string, rep long, kept string"


def shingle_set(text):
    w = [x for x in bytes(text or "", "utf8").lower().split()]
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def plain(rows, percent):
    sets = {}
    for i, t in rows:
        s = shingle_set(t)
        if i is not None and len(s) >= len(sets.get(i, set())):
            sets[i] = s
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return sorted(((i, len(shingle_set(t)), root(i) if i is not None else None, i is None or root(i) == i) for i, t in rows), key=repr)


def run(spark, rows, percent):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, N.near_duplicates(df, percent).collect()), key=repr)


def edited(r, words, share):
    return [w if r.random() >= share else f"new{r.randrange(10**6)}" for w in words]


def family(r, n, size, share):
    base = [f"w{r.randrange(10**5)}" for _ in range(size)]
    return [" ".join(edited(r, base, r.random() * share)) for _ in range(n)]


@pytest.mark.parametrize("percent", [80, 85])
def test_families(spark, percent):
    r = random.Random(percent)
    texts = [t for size in (12, 60, 300) for t in family(r, 14, size, 0.06)]
    texts += texts[:5] + ["Some  Short\ttext", "some short text", "some short", "", " \n", None]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    assert run(spark, rows, percent) == plain(rows, percent)


def test_links_that_the_first_comparison_misses(spark):
    """A chain of gradual edits: neighbours are alike, the ends are not, so stars alone leave links out."""
    r = random.Random(9)
    words, texts = [f"w{i}" for i in range(400)], []
    for step in range(40):
        texts.append(" ".join(words))
        words = words[:]
        words[r.randrange(400)] = f"n{step}"
    rows = [(int(i), t) for i, t in zip(r.sample(range(1000), 40), texts)]
    got = run(spark, rows, 85)
    assert got == plain(rows, 85) and len({c for _, _, c, _ in got}) == 1


def test_odd_tables(spark):
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [(5, long), (3, long + " x"), (3, long + " x"), (None, long), (None, None), (9, None), (8, ""), (7, "a b c d e"), (6, "A B  C d\ve"), (1, "é é é é é"), (2, "É é é é é"), (4, "a b c d e"), (4, "other words than in the first text of four")]
    assert run(spark, rows, 85) == plain(rows, 85)
    assert run(spark, [], 85) == []
    assert run(spark, [(1, None)], 85) == [(1, 0, 1, True)]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, N.near_duplicates(docs, 85).collect()), key=repr)
    assert got == plain(rows, 85)
    kept = {r["doc_id"] for r in N.keep_one(docs, 85).collect()}
    assert kept == {i for i, _, _, k in got if k}


def test_blocks_across_components(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    r = random.Random(2)
    rows = list(enumerate(family(r, 40, 80, 0.08)))
    assert run(spark, rows, 85) == plain(rows, 85)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB \n\té\x85", max_size=30), max_size=6), st.integers(1, 6), st.sampled_from([4, 16, 1 << 20]))
def test_sets_are_those_of_the_words(texts, width, stretch):
    def words(t):
        return bytes(t, "utf8").lower().split()

    old, S.STRETCH = S.STRETCH, stretch
    try:
        flat, sizes = S.shingle_sets(pa.array(texts, pa.string()), width)
    finally:
        S.STRETCH = old
    for i, t in enumerate(texts):
        w = words(t)
        want = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        assert sizes[i] == len(want)
    names = {}
    at = 0
    for t, n in zip(texts, sizes):
        w = tuple(words(t))
        names.setdefault(tuple(sorted({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set())), set()).add(tuple(flat[at : at + n]))
        at += n
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        n, share = int(r.integers(5, 400)), r.random()
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.where(r.random(n) < share, a, r.integers(0, 1 << 62, n).astype(np.uint64))
        x, y = np.unique(a), np.unique(b)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        s = N.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    alone = N.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
    assert (alone[1] == N.signatures(y, np.array([len(y)]))[0]).all()  # a set's signature doesn't depend on its neighbours
    assert len(np.unique(alone[0])) > N.SLOTS * 0.9


def test_hot_texts_are_split(spark, monkeypatch):
    """With a text of many pairs sent to several groups, the groups are those of brute force."""
    monkeypatch.setattr(N, "PAIRS", 3)
    r = random.Random(31)
    rows = list(enumerate(family(r, 40, 60, 0.05) + family(r, 10, 40, 0.1) + ["alone in this small world of words"]))
    assert run(spark, rows, 80) == plain(rows, 80)


def test_keep_one_of_repeated_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (3, "another text of more than five words"), (3, "short"), (4, ""), (4, ""), (None, text), (None, text)]
    df = spark.createDataFrame([(*x, 3, "x") for x in rows], SCHEMA)
    got = sorted(((x["doc_id"], x["text"]) for x in N.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, text), (3, "another text of more than five words"), (3, "short"), (4, ""), (4, ""), (None, text), (None, text)], key=repr)
