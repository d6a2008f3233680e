"""Benchmark decontamination: whole and re-parameterised items, slots that don't fit, odd tables, and the planted passages."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm import decontaminate as D

ITEM = "Anna Smith of Bonn bought 12 apples and 3.5 kg of flour, then Anna gave Peter 4 apples for 20 dollars on the market"
SCHEMA = "doc_id long, text string, item_id string, g int, words string"


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], SCHEMA)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]): (r["n_covered"], r["n_changed"]) for r in D.matches(d, b).collect()}, d, b


def test_copies(spark):
    changed = ITEM.replace("Anna", "Maria").replace("12", "1,700").replace("Peter", "Karl").replace("kg", "pounds")
    mixed = "so " + ITEM.replace("Anna gave", "Zoe gave").replace("Peter 4 apples", "Peter 12 apples")
    docs = [(1, f"x {ITEM} y"), (2, f"x {changed}"), (3, ITEM.upper()), (4, "a\n\n" + ITEM.replace(" ", "  ") + "!"), (5, mixed), (6, ITEM[:80]), (7, ITEM[: len(ITEM) // 3]), (8, "nothing of the kind in this text of some more words")]
    got, d, b = run(spark, docs, [(1, ITEM)])
    assert {k for k, _ in got} == {1, 2, 3, 4, 5, 6}  # 5 keeps the words before its clash, more than enough
    assert got[(1, 1)][1] == 0 and got[(2, 1)][1] >= 4 and got[(4, 1)][1] == 0
    kept = {r["doc_id"] for r in D.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {k for k, _ in got}


PLAIN = "box river stone green table window carries under quiet paper light yellow garden before slowly winter harbour simple ladder copper".split()
PEOPLE = "Anna Bruno Carla Dario Elena Fabio Greta Hugo Irene Jonas".split()


def kinds(words):
    return ["name" if w in PEOPLE else "number" if w.isdigit() else w for w in words]


def whole(doc, item):
    """Brute force: the item's template stands somewhere in the document, and its slots are filled consistently."""
    for at in range(len(doc) - len(item) + 1):
        part = doc[at : at + len(item)]
        if kinds(part) == kinds(item):
            slots = [(b, d) for b, d in zip(item, part) if kinds([b])[0] in ("name", "number")]
            to, back = {}, {}
            if all(to.setdefault(b, d) == d and (d.isdigit() or back.setdefault(d, b) == b) for b, d in slots):
                return True
    return False


def test_reparameterised_items_by_brute_force(spark):
    r = random.Random(8)
    items, docs = {}, {}
    for i in range(12):
        words = [r.choice(PLAIN) for _ in range(r.randint(20, 40))]
        person, number = r.sample(PEOPLE, 2), [str(r.randint(2, 9)), str(r.randint(10, 99))]
        for k in range(2, len(words), 4):  # a slot in every window, so that a clash leaves no window alone
            words[k] = person[k // 4 % 2] if k // 4 % 3 else number[k // 4 % 2]
        items[i] = words
        change = dict(zip(person, r.sample([p for p in PEOPLE if p not in person], 2))) | {n: str(int(n) + 100) for n in number}
        noise = lambda: [r.choice(PLAIN) + "s" for _ in range(r.randint(0, 9))]
        docs[10 * i] = noise() + [change.get(w, w) for w in words] + noise()
        docs[10 * i + 1] = noise() + words + noise()
        fresh = iter(range(200, 300))
        docs[10 * i + 2] = noise() + [str(next(fresh)) if w.isdigit() else r.choice(PEOPLE) if w in PEOPLE else w for w in words] + noise()
        docs[10 * i + 3] = noise() + r.sample(words, len(words)) + noise()
    want = {(d, i) for d, words in docs.items() for i, item in items.items() if whole(words, item)}
    # what the slots' clashes leave is another matter: only documents that are consistent throughout, or in no part, are compared
    got, _, _ = run(spark, [(d, " ".join(w)) for d, w in docs.items()], [(i, " ".join(w)) for i, w in items.items()])
    sure = lambda pairs: {(d, i) for d, i in pairs if d % 10 != 2}
    assert sure(got) == sure(want) and {(10 * i, i) for i in items} | {(10 * i + 1, i) for i in items} == sure(want)
    assert all(got[(10 * i, i)][1] == 4 and got[(10 * i + 1, i)][1] == 0 for i in items)


def test_slots_must_fit(spark):
    item = "the first bag holds 5 stones and the second bag holds 5 stones while the third bag holds 9 stones in all"
    fits = item.replace("5", "6").replace("9", "8")
    clash = item.replace("holds 5 stones and", "holds 1 stones and").replace("9", "1")  # 5 is 1 and 5, and 1 is 5 and 9
    got, _, _ = run(spark, [(1, fits), (2, clash)], [(7, item)])
    assert set(got) == {(1, 7)} and got[(1, 7)][1] == 2


def test_a_clash_leaves_the_consistent_part(spark):
    first = "Anna Smith of Bonn bought 12 apples and 3.5 kg of flour, then "
    mixed = "so " + ITEM.replace("Anna gave", "Zoe gave").replace("Peter 4 apples", "Peter 12 apples")
    renamed = mixed.replace("Anna", "Maria").replace("Bonn", "Rome")
    assert first in mixed
    item = "a box holds 3 red stones and a bag that stands beside it holds 5 blue stones, how many are there in all"
    same = item.replace("3", "4").replace("5", "4")
    got, _, _ = run(spark, [(1, mixed), (2, renamed), (3, same)], [(1, ITEM), (2, item)])
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert got[(1, 1)][0] == 23 and got[(3, 2)] == (23, 2)


def test_mostly_slots_count_only_unchanged(spark):
    item = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    other = "21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36"
    got, _, _ = run(spark, [(1, item), (2, other)], [(1, item)])
    assert set(got) == {(1, 1)}


def test_short_items_match_whole(spark):
    got, _, _ = run(spark, [(1, "so What is the CAPITAL? they asked"), (2, "what is the"), (3, "one more text with eight or more words in it")], [(1, "What is the capital?"), (2, ""), (3, None), (4, "...")])
    assert set(got) == {(1, 1)}


def test_odd_tables(spark):
    docs = [(None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM), (3, "another text under the same id"), (4, "filler words " * 40_000 + ITEM)]
    got, d, b = run(spark, docs, [(1, ITEM), (1, ITEM), (2, ITEM), (None, ITEM)])
    assert set(got) == {(3, 1), (3, 2), (4, 1), (4, 2)}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and kept.count() == 3
    assert run(spark, [], [(1, ITEM)])[0] == {} and run(spark, docs, [])[0] == {}


@pytest.mark.parametrize("bound", [None, 0])
def test_planted_passages(spark, monkeypatch, bound):
    if bound is not None:  # the joins that shuffle, with salts
        monkeypatch.setattr(D, "BROADCAST_HASHES", bound)
        monkeypatch.setattr(D, "BROADCAST_WINDOWS", bound)
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    held = docs.select("doc_id", "text").join(F.broadcast(items.select("item_id", F.col("text").alias("b"))), F.contains("text", "b"))
    want = {(r["doc_id"], r["item_id"]) for r in held.collect()}
    found = D.matches(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert want and got == want


def test_no_python_on_the_main_path(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = D.matches(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
