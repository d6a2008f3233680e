"""PII spans against the plain regular expressions run over whole texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {"email": list(EMAIL.finditer(text))}
    found["ip"] = [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found["card"] = [m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found["phone"] = [m for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return {k: [m.span() for m in v] for k, v in found.items()}


def base(text):
    return {k: v for k, v in pii.spans(text).items() if k in pii.BASE}


@settings(max_examples=1500, deadline=None)
@given(st.text("a1@.+- ()%é\n", max_size=40))
def test_random_signs(text):
    assert base(text) == plain(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "255", "256", ".", "@", "+", "0", "1.2.3.4", "a.b@c.d", "+49 (30) 1234567", " ", "-", "x", "١"]), max_size=9))
def test_random_pieces(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


@pytest.mark.parametrize("text", [None, "", "no data", "@", "@@.", "+", "٤١١١١١١١١١١١١١١١"])
def test_none(text):
    assert not any(pii.spans(text).values())
    assert pii.redact(text) == text


def test_added_kinds():
    text = 'see https://a.example/x?y=1). IBAN: DE89 3704 0044 0532 0130 00 and account number: 12345-678, password=hunter2hunter2 token = "abcdef0123456789"'
    found = pii.spans(text)
    shown = {k: [text[s:e] for s, e in v] for k, v in found.items()}
    assert shown["url"] == ["https://a.example/x?y=1"]
    assert shown["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert shown["account"] == ["12345-678"]
    assert shown["secret"] == ["hunter2hunter2", "abcdef0123456789"]
    assert not pii.spans("IBAN: DE00 3704 0044 0532 0130 00")["iban"]
    assert "hunter2" not in pii.redact(text) and "<iban>" in pii.redact(text)


def test_every_number_after_a_cue():
    good, bad = "DE89370400440532013000", "DE00370400440532013000"
    text = f"IBAN: {bad}, {good} or GB82 WEST 1234 5698 7654 32"
    assert [text[s:e] for s, e in pii.spans(text)["iban"]] == [good, "GB82 WEST 1234 5698 7654 32"]
    long = "iban " + "x " * 28 + good  # begins near the cue and ends beyond
    assert [long[s:e] for s, e in pii.spans(long)["iban"]] == [good]


def test_counts_of_all_kinds(spark):
    rows = [(1, "see https://a.example/x and password=hunter2hunter2, a@b.cd", "u"), (2, "see https://a.example/x", "u"), (3, None, "u")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, n_spans string")).collect()}
    assert [(got[i]["n_email"], got[i]["n_url"], got[i]["n_secret"], got[i]["n_spans"], got[i]["n_personal"]) for i in (1, 2, 3)] == [(1, 1, 1, 3, 2), (0, 1, 0, 1, 0), (0, 0, 0, 0, 0)]


def test_long_text_is_linear():
    text = "word 12 a@b.cd " * 200_000
    assert len(pii.spans(text)["email"]) == 200_000
    assert base("@" * 100_000 + "1. " * 100_000) == plain("@" * 100_000 + "1. " * 100_000)
    assert not any(base("1." * 300_000 + "a" * 300_000)[k] for k in ("email", "card", "phone"))


def test_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    total = 0
    for doc, text in texts.items():
        want = plain(text)
        joined = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in want[k])
        r = got[doc]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(want[k]) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
        total += sum(map(len, want.values()))
    assert total > 5


def test_odd_tables(spark):
    schema = "doc_id long, text string, spans int, n_email string"
    rows = [(1, None, 0, ""), (None, "a@b.cd", 0, ""), (2, "", 0, ""), (2, "", 0, "")]
    got = sorted((tuple(r) for r in pii.find_pii(spark.createDataFrame(rows, schema), with_text=True).drop(*(f"n_{k}" for k in (*pii.ADDED, "spans", "personal"))).collect()), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, 0, 0, 0, 0, empty, "", None), (2, 0, 0, 0, 0, empty, "", ""), (2, 0, 0, 0, 0, empty, "", ""), (None, 1, 0, 0, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6", "<email>")], key=repr)
    assert pii.find_pii(spark.createDataFrame([], schema)).count() == 0
