"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes, plus signs, digits and identifier cues. Local
parsers expand each anchor to the largest run of characters its kind allows and settle the exact boundaries there, so
the text between anchors is never scanned by a regular expression.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches

#: The contract's kinds, and those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
KINDS = BASE + ADDED

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN, _IP = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z"), re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|nummer|numéro|numero|no\.?|nr\.?|n°|#))?[ \t]*[:=#]?[ \t]*([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])", re.I)
_SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/=.-]{12,})")

ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "ssn", "passport", "reisepass", "passeport", "pasaporte")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")
IBAN_CUE = "iban"
#: Characters after a cue, or after a number found, within which a number may begin.
IBAN_REACH = 60


def _cased(word: str) -> set[str]:
    return {word, word.upper(), word.capitalize()}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    for sign, kind in (("@", "email"), ("://", "url"), ("+", "phone")):
        found.add_word(sign, (kind, len(sign)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", (IBAN_CUE,))):
        for cue in cues:
            for form in _cased(cue):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _before(text: str, at: int, allowed: str | frozenset, floor: int) -> int:
    """Start of the run of allowed characters that ends at ``at``, not before ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


_LOCAL_SET = frozenset(_LETTERS + _DIGITS + "._%+-")
_IP_SET = frozenset(_DIGITS + ".")
_SCHEME_SET = frozenset(_LETTERS + _DIGITS + "+.-")


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind in code points, in order; none in a null or empty text."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    email_end = phone_end = url_end = ip_end = card_end = 0
    for last, (kind, width) in _automaton().iter(text):
        at, end = last - width + 1, last + 1
        if kind == "digit":
            if at >= card_end:  # a run of digits with single blanks or hyphens between them
                if m := _CARD_RUN.match(text, at):
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                else:
                    card_end = end
            if at >= ip_end:  # the whole run of digits and dots that holds the anchor
                run = _IP_RUN.match(text, _before(text, at, _IP_SET, ip_end))
                ip_end = run.end()
                for m in _IP.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
        elif kind == "email":
            start = _before(text, at, _LOCAL_SET, email_end)
            if start < at and (m := _DOMAIN.match(text, end)):
                found["email"].append((start, m.end()))
                email_end = m.end()
        elif kind == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            start = _before(text, at, _SCHEME_SET, url_end)
            while start < at and text[start] not in _LETTERS:
                start += 1
            if start < at and (m := _URL[1].match(text, end)):
                stop = end + len(m[0].rstrip(".,;:!?)*$%&#"))
                if stop > end:
                    found["url"].append((start, stop))
                    url_end = stop
        elif kind == "account":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, end)):
                _add(found["account"], m.span(1))
        elif kind == "secret":
            if m := _SECRET.match(text, end):
                _add(found["secret"], m.span(1))
        elif kind == "iban":
            at, reach = end, end + IBAN_REACH
            # every candidate that begins near the cue or near the number before it; the longest one ends the view
            while m := _IBAN.search(text, at, min(len(text), reach + 80)):
                if m.start() >= reach:
                    break
                whole = m[0]
                while whole and not iban_valid(whole):  # the boundary may lie before a following word
                    whole = whole[:-1].rstrip()
                if whole:
                    _add(found["iban"], (m.start(), m.start() + len(whole)))
                at = m.start() + max(2, len(whole))
                reach = at + IBAN_REACH if whole else reach
    return found


def _add(to: list[tuple[int, int]], span: tuple[int, int]) -> None:
    if not to or span[0] >= to[-1][1]:
        to.append(span)


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first, longest one counts."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted(((s, -e, k) for k, x in spans(text).items() for s, e in x)):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = -end
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + "".join(f"n_{k} long, " for k in ADDED) + "n_spans long, n_personal long, redacted string"


def find_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts of the base kinds, their digest, all spans, counts of
    the added kinds, of all spans, and of all but URLs, which alone are no personal data; the redacted text.

    A null text is empty: no spans, the digest of the empty string, and a null redaction. Null ids and repeated rows
    are carried along; other columns are ignored. ``redacted`` is only there ``with_text``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = spans(text)
                digest = hashlib.sha256(joined(found, BASE).encode()).hexdigest()
                total = sum(map(len, found.values()))
                counts = [len(found[k]) for k in ADDED] + [total, total - len(found["url"])]
                rows.append((doc_id, *(len(found[k]) for k in BASE), digest, joined(found, KINDS), *counts, redact(text) if with_text else None))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in SCHEMA.split(", ")]
    arrow_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
    return out if with_text else out.drop("redacted")
