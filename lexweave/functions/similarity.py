"""String and vector similarity: Jaro-Winkler as a vectorised pandas UDF behind a lossless native bound; cosine distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variant:
    """Variants of Jaro-Winkler in use. ``unit``: characters or UTF-8 bytes; ``halve``: exact half of the transposed
    characters, or rounded down; ``boost_above``: the prefix counts only above this Jaro similarity."""

    unit: str = "character"
    halve: str = "exact"
    boost_above: float = 0.7
    scale: float = 0.1
    prefix: int = 4


#: Published definition, and that of DuckDB's function.
PUBLISHED, BYTES = Variant(), Variant("byte", "floor", 0.7)


def _codes(names: list[str], unit: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(n.encode("utf-32-le"), "<u4") if unit == "character" else np.frombuffer(n.encode(), np.uint8) for n in names]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), max(1, int(sizes.max(initial=0)))), np.uint32)
    for i, r in enumerate(raw):
        out[i, : len(r)] = r
    return out, sizes


def jaro_winkler_arrays(a: list[str], b: list[str], variant: Variant = PUBLISHED) -> np.ndarray:
    """Similarities of all pairs at once: one numpy step per character position instead of one per pair."""
    if not a:
        return np.zeros(0)
    x, n = _codes(a, variant.unit)
    y, m = _codes(b, variant.unit)
    rows, place = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        open_ = (y == x[:, i : i + 1]) & ~used & (place < m[:, None]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        first = open_.argmax(axis=1)
        found = open_[rows, first]
        used[rows[found], first[found]] = True
        hit[found, i] = True
    matches = hit.sum(axis=1)
    left = np.take_along_axis(x, np.argsort(~hit, axis=1, kind="stable"), axis=1)
    right = np.take_along_axis(y, np.argsort(~used, axis=1, kind="stable"), axis=1)
    width = min(x.shape[1], y.shape[1])
    swapped = ((left[:, :width] != right[:, :width]) & (np.arange(width) < matches[:, None])).sum(axis=1)
    half = swapped / 2 if variant.halve == "exact" else swapped // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(matches > 0, (matches / n + matches / m + (matches - half) / matches) / 3, 0.0)
    jaro[(n == 0) & (m == 0)] = 1.0
    same = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
    common = np.minimum(np.cumprod(same[:, : variant.prefix], axis=1).sum(axis=1), variant.prefix)
    return np.where(jaro > variant.boost_above, jaro + common * variant.scale * (1 - jaro), jaro)


def jaro_winkler(variant: Variant = PUBLISHED, batch: int = 4096):
    """A pandas UDF of two name columns; null if either is null. Equal pairs of an Arrow batch are compared once."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        places = np.flatnonzero(known)
        pairs = list(zip(a.to_numpy()[places], b.to_numpy()[places]))
        scores = dict.fromkeys(pairs)  # a pair that comes again is compared once
        distinct = list(scores)
        for k in range(0, len(distinct), batch):
            some = distinct[k : k + batch]
            scores.update(zip(some, jaro_winkler_arrays([p[0] for p in some], [p[1] for p in some], variant)))
        out[places] = [scores[p] for p in pairs]
        return pd.Series(out).where(pd.Series(known))

    return run


def _counts(name: Column) -> Column:
    """Sorted characters with an occurrence number each, so that overlaps of multisets are overlaps of sets."""
    chars = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c)).cast("string")))


def name_profile(name: Column) -> Column:
    """What the bound needs of a name, to be computed once per distinct name."""
    return F.struct(F.length(name).alias("size"), _counts(name).alias("multiset"), (F.octet_length(name) == F.length(name)).alias("ascii"))


def may_reach(a: Column, pa: Column, b: Column, pb: Column, threshold: float, scale: float = 0.1) -> Column:
    """False only if Jaro-Winkler surely stays below the threshold, in any variant over characters.

    With the multiset overlap as the number of matches, no transposition and the prefix boost granted, the similarity
    can't be higher.
    """
    overlap = F.size(F.array_intersect(pa["multiset"], pb["multiset"]))
    prefix = sum(F.when(F.substring(a, 1, k) == F.substring(b, 1, k), 1).otherwise(0) for k in range(1, 5))
    bound = (F.lit(threshold) - scale * prefix) / (1 - scale * prefix)
    jaro = (overlap / F.greatest(pa["size"], F.lit(1)) + overlap / F.greatest(pb["size"], F.lit(1)) + 1) / 3
    return (jaro + 1e-9 >= bound) | (a == b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, in doubles; null for a zero vector. Give the norms where they are stored."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale > 0, 1 - dot(a, b) / scale)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
