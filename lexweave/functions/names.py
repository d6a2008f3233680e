"""The name rules of ``functions.text`` for single strings, for code that folds row by row."""

from __future__ import annotations

import re

from lexweave.functions.text import MINOR_WORDS, ROLE_WORDS

_GENERIC = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(ROLE_WORDS)})(?![A-Za-z0-9_])", re.I)


def looks_generic(name: str | None) -> bool:
    return not name or _GENERIC.search(name) is not None


def name_tokens(name: str) -> set[str]:
    return set(filter(None, re.split("[^a-z0-9]+", name.lower())))


def initials(name: str) -> str:
    parts = re.sub(r"[^a-zA-Z\s]", "", name).split()
    return "".join(p[0].lower() for p in parts if p.lower() not in MINOR_WORDS)


def looks_related(a: str, b: str) -> bool:
    if name_tokens(a) & name_tokens(b):
        return True
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    letters = re.sub("[^a-zA-Z]", "", short).lower()
    return len(letters) > 1 and initials(long) == letters


def keep_context_match(mention: str | None, candidate: str | None) -> bool:
    return not candidate or looks_generic(mention) or looks_generic(candidate) or looks_related(mention, candidate)
