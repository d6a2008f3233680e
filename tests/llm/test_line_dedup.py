"""Boilerplate removal against plain Python, and the choice between sketch and exact count."""

from collections import defaultdict

import pytest

from lexweave.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string, n_removed string, key int, extra int"


def plain(rows, least):
    sites, first = defaultdict(set), {}
    for doc, text, source in rows:
        for pos, line in enumerate((text or "").split("\n")):
            key = line.strip(L.BLANKS)
            if key and doc is not None and text is not None:
                sites[key].add(source)
                first[key] = min(first.get(key, (doc, pos)), (doc, pos))
    out = []
    for doc, text, _ in rows:
        if text is None or doc is None:
            out.append((doc, text, 0))
            continue
        lines = text.split("\n")
        gone = [bool(k := line.strip(L.BLANKS)) and len(sites[k]) >= least and (doc, pos) != first[k] for pos, line in enumerate(lines)]
        out.append((doc, "\n".join(x for x, g in zip(lines, gone) if not g), sum(gone)))
    return sorted(out, key=repr)


def run(spark, rows, least):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = L.remove_boilerplate(df, least)
    assert got.columns == ["doc_id", "text", "source", "key", "extra", "n_removed"]
    return sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("least", [1, 2, 5, 9])
def test_plain(spark, least):
    rows = [(i, f"own {i}\n  shared {i % 4}\t\n\nonce\nshared {i % 4}" + ("\n" if i % 3 else ""), f"s{i % 7}" if i % 11 else None) for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n \n", "s3"), (None, "once", "s4")]
    rows += [rows[5], rows[5]]
    assert run(spark, rows, least) == plain(rows, least)


def test_many_sites_near_and_far(spark):
    """Spreads below, at and above the threshold, some of them large enough for the sketch to be an estimate."""
    spread = {"few": 3, "under": 199, "at": 200, "over": 201, "many": 900}
    rows = [(i, "\n".join(name for name, n in spread.items() if i < n), f"site{i}") for i in range(900)]
    assert run(spark, rows, 200) == plain(rows, 200)


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(L, "broadcast_if_small", lambda df: (df, False))
    rows = [(i, f"a\nb {i % 3}\nown {i}", f"s{i % 6}") for i in range(40)]
    assert run(spark, rows, 2) == plain(rows, 2)


def test_empty(spark):
    assert L.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
