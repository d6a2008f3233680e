"""Packing: exact lengths, gapless sequences, round trips of the ids, and bin counts against brute force."""

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import packing as P

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, room):
    """The fewest bins, by trying all ways to place each item."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b >= lengths[k]}.values():
            bins[i] -= lengths[k]
            go(k + 1, bins)
            bins[i] += lengths[k]
        go(k + 1, [*bins, room - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_as_few_bins_as_brute_force(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = P.bin_completion(counts, 20)
    assert sum(t for _, t in plan) == fewest(sorted(lengths, reverse=True), 20)
    used = defaultdict(int)
    for filling, times in plan:
        assert sum(n * k for n, k in filling) <= 20
        for n, k in filling:
            used[n] += k * times
    assert dict(used) == counts
    assert P.lower_bound(counts, 20) <= fewest(sorted(lengths, reverse=True), 20) if lengths else True


def test_search_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 2: 2}  # best fit needs one bin more than three lists of 12
    room = 12
    flat = [n for n, c in counts.items() for _ in range(c)]
    assert sum(t for _, t in P.bin_completion(counts, room)) == fewest(sorted(flat, reverse=True), room)
    assert P.bin_completion({}, room) == []


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)])])
def test_cut(n, want):
    assert P.cut(n, 8) == want


def check(rows, docs, seq_len):
    """All that the contract says of a packing of ``docs`` (id -> ids)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        ids = docs[doc]
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert len(parts) == 1 or len(ids) > seq_len
        at = 0
        for k, r in enumerate(parts):
            assert r["start"] == at and r["length"] <= seq_len and (k == 0 or r["length"] == seq_len)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4"))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq_len
    return len(by_sequence)


@pytest.mark.parametrize("vocabulary", [RANKS, JSON])
def test_documents(spark, sf, vocabulary):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: [*reference(r["text"]), 2] for r in docs.collect()}
    n = check(P.pack(docs, vocabulary).collect(), want, 1024)
    counts = defaultdict(int)
    for ids in want.values():
        for _, k in P.cut(len(ids)):
            counts[k] += 1
    assert n <= P.lower_bound(counts, 1024) + 1


def reference(text):
    """The ids of the contract, by the tokenizers library itself."""
    return _model().encode(text, add_special_tokens=False).ids


@cache
def _model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_control_strings_are_ids():
    encode = P.encoder(JSON)
    assert encode("a <|endoftext|> b") == reference("a <|endoftext|> b") == [64, 220, 50256, 275]
    for t in ("<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "<|endoftext", "\n\n<|endoftext|>\n", "<|endoftext|>" + " " * 120_000 + "<|endoftext|>z"):
        assert encode(t) == reference(t)
    assert P.encoder(RANKS)("<|endoftext|>") != [50256]  # a rank file lists no control strings


def test_other_files_of_the_library_are_run_by_it():
    other = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert P.encoder(other)("Some Words <|endoftext|>") == Tokenizer.from_file(other).encode("Some Words <|endoftext|>", add_special_tokens=False).ids


def test_no_packing_is_left_out():
    """Random instances against brute force; a node limit far above what they need."""
    r = random.Random(5)
    for _ in range(4_000):
        room = r.choice((12, 20, 50, 100))
        lengths = [r.randint(1, room) if r.random() < 0.2 else r.randint(max(1, room // 6), room * 2 // 3) for _ in range(r.randint(4, 11))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        assert sum(t for _, t in P.bin_completion(counts, room)) == fewest(sorted(lengths, reverse=True), room), (lengths, room)
    assert sum(t for _, t in P.bin_completion(dict.fromkeys((10, 12, 16, 17, 19, 21, 23, 28), 1), 50)) == 3


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_best_fit_places_every_piece_once(counts):
    for plan in (P.best_fit(counts, 30), P.largest_first(counts, 30), P.bin_completion(counts, 30, nodes=50)):
        used = defaultdict(int)
        for filling, times in plan:
            assert times > 0 and sum(n * k for n, k in filling) <= 30
            for n, k in filling:
                used[n] += k * times
        assert dict(used) == counts


def test_best_fit_by_pieces():
    """The histogram form against best-fit decreasing piece by piece."""
    r = random.Random(2)
    for _ in range(500):
        room = r.choice((10, 24, 100))
        lengths = sorted((r.randint(1, room) for _ in range(r.randint(1, 60))), reverse=True)
        bins: list[int] = []
        for n in lengths:
            fit = [(b, i) for i, b in enumerate(bins) if b >= n]
            if fit:
                bins[min(fit)[1]] -= n
            else:
                bins.append(room - n)
        assert sum(t for _, t in P.best_fit({n: lengths.count(n) for n in set(lengths)}, room)) == len(bins)


def test_both_vocabularies_agree_on_all_texts(sf):
    import duckdb

    a, b = P.encoder(JSON), reference
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) < 4000 USING SAMPLE 150 ROWS (reservoir, 3)").fetchall()]
    for t in [*texts, "", " ", "a\x00b 𝄞 é́ \n\n  x", "word" * 300, "     " * 50, "a" + " " * 120_000 + "b" + "\n" * 110_000 + " c", " " * 100_001]:
        assert list(a(t)) == list(b(t))


def test_endless_space():
    ids = P.encoder(RANKS)("a" + " " * 3_000_000 + "b")
    assert len(ids) == 3_000_001


def test_odd_tables(spark):
    schema = "doc_id long, text string, length int, sequence_id string, _salt int"
    rows = [(1, None, 0, "x", 0), (2, "", 0, "x", 0), (None, "some words", 0, "x", 0), (3, "same text", 0, "x", 0), (3, "same text", 0, "x", 0), (4, "long " * 3000, 0, "x", 0)]
    got = P.pack(spark.createDataFrame(rows, schema), RANKS, seq_len=16).collect()
    assert sum(r["doc_id"] == 3 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places)
    assert P.pack(spark.createDataFrame([], schema), RANKS).count() == 0


def test_ranks_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 3)
    rows = spark.createDataFrame([(i, "a b c"[: 1 + 2 * (i % 3)]) for i in range(200)], "doc_id long, text string")
    encode = P.encoder(RANKS)
    want = {r["doc_id"]: [*encode(r["text"]), 2] for r in rows.collect()}
    for bound in (500_000, 0):  # starts broadcast, and shuffled
        monkeypatch.setattr(P, "BROADCAST_GROUPS", bound)
        n = check(P.pack(rows, RANKS, seq_len=12).collect(), want, 12)
        assert n == -(-sum(map(len, want.values())) // 12)
