"""Near-duplicate groups by SuperMinHash, banding, exact verification and connected components.

1. Every text's set of word shingles gets a SuperMinHash signature (Ertl, 2017): an element's permutation ranks over the
   slots are correlated, which lowers the variance, and ranks beyond a text's largest value are never drawn.
2. Texts with equal sets are one class, represented by its smallest id, so exact copies cost nothing further.
3. Representatives meet in buckets of equal bands. In each bucket all others are compared with the smallest id;
   links are confirmed on the full sets and joined to components.
4. Buckets that hold more than one component by then are compared block by block across components, so no link of a
   bucket is lost; within a component a further link would change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches, broadcast_if_small, components, discard, free_name, materialize
from lexweave.llm.shingles import mix, shingle_sets

WIDTH = 5
#: Bands and values in a band: two texts of similarity 0.85 share none with probability 7e-11, of 0.8 with 1e-7.
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
#: Pairs whose estimate lies so many standard errors below the threshold are not verified.
SIGMAS = 4.5
#: Members of a bucket that are compared with one another at once.
BLOCK = 512
#: Pairs of one text beyond which it is sent to several groups of so many.
PAIRS = 4096

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def signatures(flat: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, a row per set: step number in the upper byte, random fraction below. Empty sets stay at the top.

    All elements of all sets take their j-th step together; a set whose values all lie below the next step has ended.
    """
    values = np.full((len(sizes), slots), np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    element, history = flat, []
    for j in range(slots):
        if not len(element):
            break
        draw = mix(element + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
        fraction = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24)
        to = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = to.copy()
        for t in range(j - 1, -1, -1):  # where the earlier swaps of the element's permutation lead
            slot[slot == history[t]] = t
        np.minimum.at(values.reshape(-1), owner * slots + slot, j + fraction)
        open_sets = values.max(axis=1) >= j + 1
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if stay.all():
            history.append(to)
        else:
            element, owner = element[stay], owner[stay]
            history = [h[stay] for h in [*history, to]]
    # 200 steps and 24 bits of fraction fit 32 bits; an empty set's row is constant and never used
    return (np.minimum(values, slots) * (1 << 24)).astype(np.uint64).astype(np.uint32)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GAMMA
    for r in range(ROWS):
        keys = mix(keys ^ (parts[:, :, r] + np.uint64(r << 33)))
    return keys


FEATURES = "doc_id long, h long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: a hash of the text, set size, a 128-bit digest of the set, band keys and a short signature."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = shingle_sets(batch.column("text"), width)
            cum = np.r_[np.uint64(0), np.cumsum(mix(flat ^ _GAMMA))], np.r_[np.uint64(0), np.cumsum(mix(flat + _GAMMA))]
            ends = np.cumsum(sizes)
            sums = [(c[ends] - c[ends - sizes]).view(np.int64) for c in cum]
            found = signatures(flat, sizes)
            keys = band_keys(found).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            short = mix(found.astype(np.uint64)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), keys, pa.array([r.tobytes() for r in short], pa.binary())],
                [x.split()[0] for x in FEATURES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text")).mapInArrow(run, FEATURES)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, hashes) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = shingle_sets(batch.column("text"), width)
            ends = np.cumsum(sizes)
            raw = [flat[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist())]
            sums = [mix(flat[e - n : e] ^ _GAMMA).sum(dtype=np.uint64) for n, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "s1", "hashes"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc_id long, s1 long, hashes binary")


def _close(sign: np.ndarray, other: np.ndarray, cut: float) -> np.ndarray:
    return (sign == other).mean(axis=-1) >= cut


def _attach(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the columns that ``a`` and ``b`` hold of either. Texts of many pairs are sent to several groups."""
    counts = pairs.groupBy("a").count().where(F.col("count") > PAIRS).select("a", F.ceil(F.col("count") / PAIRS).cast("int").alias("parts"))
    if counts.isEmpty():
        return pairs.join(b, "b").join(a, "a")
    hot, _ = broadcast_if_small(counts)
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    left = pairs.join(hot, "a", "left").select("a", "b", part.alias("part"))
    right = a.join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(b, "b").join(right, ["a", "part"]).drop("part")


class _Search:
    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs, self.percent, self.width = docs, percent, width
        t = percent / 100
        self.cut = t - SIGMAS * math.sqrt(t * (1 - t) / SLOTS)

    def sized(self, a: str, b: str):
        """Sets this different in size can't reach the threshold."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def estimate(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` whose sizes and signatures allow a link."""
        cut, slots = self.cut, SLOTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, slots) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(_close(x, y, cut)))

        one = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("x"))
        two = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("y"))
        both = _attach(pairs, one, two).where(self.sized("n_a", "n_b"))
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def verify(self, pairs: DataFrame, reps: DataFrame, label: str) -> DataFrame:
        """Those of ``pairs(a, b)`` whose full sets reach the threshold."""
        percent = self.percent
        pairs = materialize(pairs, f"{label}-pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        # of a repeated id the text that stands for it
        own = reps.select(F.col("rep").alias("doc_id"), "s1")
        sets = _sets(self.docs, ids, self.width).join(own, ["doc_id", "s1"], "left_semi").dropDuplicates(["doc_id"])
        sets = materialize(sets, f"{label}-sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    at = np.searchsorted(x, y)
                    common = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
        links = materialize(_attach(pairs, one, two).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{label}-links")
        discard(pairs, sets)
        return links

    def across(self, members: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs that may link two components and share a bucket: ``members(key, rep, root)`` block against block."""
        cut, percent, slots = self.cut, self.percent, SLOTS
        counts = members.groupBy("key").count().select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        rows = members.join(counts, "key").join(reps.select("rep", "n", "signature"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # block i meets blocks i, i + 1, ...: each row goes once to every pair of blocks that holds its own
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        rows = rows.withColumn("p", F.explode(pairs)).select("key", "p", "block", "rep", "root", "n", "signature")

        def run(table: pa.Table) -> pa.Table:
            rep, root, n, block = (table.column(c).to_numpy() for c in ("rep", "root", "n", "block"))
            sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, slots)
            i = table.column("p")[0].as_py()
            left = np.flatnonzero(block == i["i"])
            right = left if i["i"] == i["j"] else np.flatnonzero(block == i["j"])
            a, b = [], []
            for k in left:
                other = right[(root[right] != root[k])]
                if i["i"] == i["j"]:
                    other = other[other > k]
                other = other[100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k])]
                other = other[_close(sign[other], sign[k], cut)]
                a.append(np.minimum(rep[other], rep[k]))
                b.append(np.maximum(rep[other], rep[k]))
            none = np.empty(0, np.int64)
            return pa.table({"a": np.concatenate([*a, none]), "b": np.concatenate([*b, none])})

        return rows.groupBy("key", "p").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles;
    ``component_id`` is the smallest id reachable over links, and the document with that id is kept. Documents without
    words, or with a null text, are linked with nothing. Repeated rows of one id come out as often as they came; if an
    id has several texts, the one with the largest set stands for it. Rows with a null id are linked with nothing and kept, with
    a null component. Other columns are ignored; an empty table gives no rows.
    """
    found, roots, _ = _grouped(docs, percent, width)
    joined = found.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("root", "doc_id").cast("long")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all rows, ``(_id, root)`` of all ids with words, and ``(doc_id, h)`` of the texts that stand for ids."""
    search = _Search(docs, percent, width)
    found = materialize(features(docs, width), "features")
    sets = ["n_shingles", "s1", "s2"]
    chosen = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.max(F.struct(*sets, "h")).alias("s"))
    full = materialize(chosen.select("doc_id", "s.*"), "documents")
    classes = materialize(full.groupBy(*sets).agg(F.min("doc_id").alias("rep")), "classes")
    first = classes.select(F.col("rep").alias("doc_id"), *sets)
    reps = found.join(first, ["doc_id", *sets], "left_semi").dropDuplicates(["doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "s1", "bands", "signature"), "reps")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1").select("key", "center"), "buckets")
    shared, _ = broadcast_if_small(buckets)
    members = materialize(keyed.join(shared, "key"), "members")
    stars = materialize(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = search.verify(search.estimate(stars, reps), reps, "stars")
    roots = components(links)
    # what is left: buckets that hold several components
    labelled = members.join(roots, members["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    labelled = materialize(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    pairs = search.across(labelled.join(open_keys, "key"), reps).join(stars, ["a", "b"], "left_anti")
    more = search.verify(pairs, reps, "across")
    roots = components(links.union(more))
    by_class = classes.join(roots, classes["rep"] == roots["node"], "left").select(*sets, F.coalesce("root", "rep").alias("root"))
    by_id = materialize(full.join(by_class, sets).select(F.col("doc_id").alias("_id"), "root", F.col("h").alias("_h")), "roots")
    discard(full, classes, reps, buckets, members, stars, labelled, links, more)
    return found, by_id.select("_id", "root"), by_id


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id.

    Rows that repeat an id and its text are exact copies: one of them stays. If an id has several texts, the one with
    the largest set is judged and the others stay. Rows with a null id, and those without words, stay.
    """
    found, _, by_id = _grouped(docs, percent, WIDTH)
    gone = by_id.where("root <> _id").select("_id", "_h")
    h, number = free_name(docs, "_text"), free_name(docs, "_copy")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(gone, (hashed["doc_id"] == gone["_id"]) & (hashed[h] == gone["_h"]), "left_anti")
    again = materialize(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = (kept["doc_id"] == again["_id"]) & (kept[h] == again["_h"])
    # only rows that are repeated are numbered, in the order of all their columns
    copies = kept.join(again, same, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.to_json(F.struct(*docs.columns)))))
    return kept.join(again, same, "left_anti").select(*docs.columns).union(copies.where(F.col(number) == 1).select(*docs.columns))
