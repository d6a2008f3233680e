"""Column functions over chunk texts and names. All of them stay in the JVM."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundaries that treat only ASCII as word characters; Java's own look at all of Unicode.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

DOCKET = rf"(?i){_LEFT}(?:[0-9]{{1,2}}:)?[0-9]{{2}}-(?:{'|'.join(k for k in ('cv', 'cr', 'md', 'mc'))})-[0-9]{{4,6}}(?:-[A-Z]{{2,4}})?{_RIGHT}"

_short = sorted({*calendar.month_abbr[1:], "Sept"} - {"May"}, key=lambda m: (m[:3], len(m)))
_long = [m for m in calendar.month_name[1:]]
MONTHS = "|".join([*(f"{m}\\.?" for m in _short), *_long])
NUMERIC_DATE = rf"{_LEFT}[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}{_RIGHT}"
DATE = rf"{NUMERIC_DATE}|{_LEFT}(?:{MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}{_RIGHT}"

#: Cues of citations: what stands at a word's start, and what must follow it.
_NOISE_CUES = (("v", r"\.\s"), ("WL", r"\s+[0-9]"), ("F", r"\.\s?(?:2d|3d|Supp)"), ("Dep", r"\.\s?Tr\."), ("Decl", r"\."), ("Exhibit", _RIGHT), ("DE", r"\s+[0-9]"), ("Document", r"\s+[0-9]"))
NOISE = rf"(?i){_LEFT}(?:{'|'.join(a + b for a, b in _NOISE_CUES)})"

ROLE_WORDS = tuple(sorted(("judge", "counsel", "witness", "attorney", "plaintiff", "defendant", "petitioner", "respondent", "the court", "this court")))
GENERIC = rf"(?i){_LEFT}(?:{'|'.join(ROLE_WORDS)}){_RIGHT}"
MINOR_WORDS = ("and", "for", "of", "the")


def words(text: Column) -> Column:
    """Runs between Unicode white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def window_count(n: Column, size: int = 350, overlap: int = 50) -> Column:
    """Number of windows over ``n`` words: the last is the first that reaches the end."""
    step = size - overlap
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")


def windows(items: Column, size: int = 350, overlap: int = 50) -> Column:
    """Array of overlapping slices of an array of words or of word structs; empty for an empty or null array."""
    step = size - overlap
    count = window_count(F.size(items), size, overlap)
    each = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(items, i * step + 1, F.lit(size)))
    return F.filter(each, lambda w: F.size(w) > 0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_name(path: Column, display: Column) -> Column:
    """The display name if there is one, else the last part of the path."""
    return F.coalesce(F.nullif(display, F.lit("")), base_name(path))


def chunk_id(source: Column, index: Column) -> Column:
    """Base name without its last extension, and the index; a leading dot is no extension."""
    return F.concat_ws("_", F.regexp_replace(base_name(source), r"(?<=.)\.[^.]*$", ""), index.cast("string"))


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def docket_numbers(text: Column) -> Column:
    """Distinct case numbers in order of first occurrence."""
    return _all(text, DOCKET)


def dates(text: Column) -> Column:
    """Distinct dates as written, in order of first occurrence. Month names are case-sensitive."""
    return _all(text, DATE)


def is_noise(kind: Column, name: Column, evidence: Column) -> Column:
    """Citations and exhibits: by type, or by a cue in name or evidence whatever the type."""
    hit = lambda c: F.coalesce(c.rlike(NOISE), F.lit(False))
    return F.coalesce(kind == "reference", F.lit(False)) | hit(name) | hit(evidence)


def participants(entities: Column) -> Column:
    """The entities of an array that are no noise."""
    return F.filter(entities, lambda e: ~is_noise(e["type"], e["name"], e["textual_evidence"]))


def needs_review(entities: Column) -> Column:
    """True if a confidence rests on context alone."""
    return F.coalesce(F.exists(entities, lambda e: F.coalesce(e["confidence"] == "resolved_from_context", F.lit(False))), F.lit(False))


def looks_generic(name: Column) -> Column:
    """No name, or a role phrase in it."""
    return (F.coalesce(name, F.lit("")) == "") | F.coalesce(name.rlike(GENERIC), F.lit(False))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case ASCII words; other letters part them."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""))


def shares_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def name_rules(name: Column) -> Column:
    """What the rules on pairs of names need of one, to be worked out once per name: null for a null name."""
    return F.when(name.isNotNull(), F.struct(F.length(name).alias("size"), name_tokens(name).alias("tokens"), initials(name).alias("initials"), letters(name).alias("letters")))


def rules_share_token(a: Column, b: Column) -> Column:
    """``shares_token`` of two names by their ``name_rules``."""
    return F.arrays_overlap(a["tokens"], b["tokens"])


def rules_acronym(a: Column, b: Column) -> Column:
    """``acronym_related`` of two names by their ``name_rules``."""
    first = a["size"] >= b["size"]
    short = F.when(first, b["letters"]).otherwise(a["letters"])
    return (F.length(short) > 1) & (F.when(first, a["initials"]).otherwise(b["initials"]) == short)


def rules_related(a: Column, b: Column) -> Column:
    return rules_share_token(a, b) | rules_acronym(a, b)


def initials(name: Column) -> Column:
    """First letters, lower-cased, of all words but minor ones."""
    parts = F.filter(F.split(F.regexp_replace(name, r"[^a-zA-Z\s]", ""), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*MINOR_WORDS))
    return F.array_join(F.transform(parts, lambda w: F.lower(F.substring(w, 1, 1))), "")


def letters(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z]", ""))


def acronym_related(a: Column, b: Column) -> Column:
    """The shorter name's letters are the longer one's initials; of equal lengths the first counts as longer."""
    first = F.length(a) >= F.length(b)
    short = letters(F.when(first, b).otherwise(a))
    return (F.length(short) > 1) & (initials(F.when(first, a).otherwise(b)) == short)


def looks_related(a: Column, b: Column) -> Column:
    return shares_token(a, b) | acronym_related(a, b)


def keep_context_match(mention: Column, candidate: Column) -> Column:
    """A nearest-neighbour candidate stays if its name is unknown, if either is generic, or if the names are related."""
    return candidate.isNull() | looks_generic(mention) | looks_generic(candidate) | looks_related(mention, candidate)


def locate(text: Column, evidence: Column, name: Column) -> Column:
    """``struct<position, matched>`` of the first exact occurrence of the evidence, else of the name; null if neither."""

    def hit(needle: Column) -> Column:
        return (F.coalesce(needle, F.lit("")) != "") & (F.instr(text, needle) > 0)

    def at(needle: Column) -> Column:
        return F.struct(F.instr(text, needle).alias("position"), needle.alias("matched"))

    return F.when(hit(evidence), at(evidence)).when(hit(name), at(name))


def snippet(text: Column, place: Column, around: int = 15) -> Column:
    """Up to ``around`` words before the match, the match, and as many after it. Null if there is no place."""
    before = words(F.substring(text, F.lit(1), place["position"] - 1))
    after = words(F.substring(text, place["position"] + F.length(place["matched"]), F.length(text)))
    start = F.greatest(F.size(before) - around + 1, F.lit(1))
    parts = F.concat(F.slice(before, start, around), F.array(place["matched"]), F.slice(after, 1, around))
    return F.when(place.isNotNull(), F.array_join(parts, " "))


def edge_handle(collection: str, key: Column) -> Column:
    """The name of a node in another store's edges; for export only, as edges here hold plain keys. Null for a null key."""
    return F.concat(F.lit(collection + "/"), key.cast("string"))


def preview(text: Column, n: int = 60) -> Column:
    """The first ``n`` characters, on one line."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, n)


def decimals(number: Column, digits: int = 6) -> Column:
    """A number with so many decimals and no grouping, as text."""
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, to one decimal."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 60e6, 1)
