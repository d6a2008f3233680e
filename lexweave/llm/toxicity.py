"""Toxicity scores from a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first bytes. Filters of several widths run
over the whole text; each one's largest response is pooled and a logistic layer weighs them. The decision threshold is
calibrated for each language on labelled texts that training didn't see, and moved to ``THRESHOLD`` by shifting the
score; the language is guessed from function words of the text itself.

``fit_all`` learns from every labelled text, in blocks all over the cluster; ``fit`` from a bounded sample on the driver.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches, broadcast_if_small, discard, materialize
from lexweave.llm.shingles import word_hashes

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Bytes of a word's beginning that have an embedding of their own.
FIRST = 4
THRESHOLD = 0.7
#: Toxic texts that are learned from at most, of which one in ``CALIBRATE`` only calibrates, and how many times as many
#: others: those that training doesn't need calibrate too, as the threshold lies in their tail.
SAMPLE, CALIBRATE, OTHERS = 3000, 5, 3
#: Bytes of the sample's words (four each) at most; texts beyond, in the order of their ids' hashes, are left out of it.
SAMPLE_BYTES = 96 << 20
EPOCHS, RATE, SEED, BATCH = 10, 0.01, 11, 48
#: Hashed words that one task learns from at once in ``fit_all``, in bytes; a longer text is a block of its own length.
BLOCK_BYTES = 4 << 20
#: Halves of the labelled texts that ``fit_all`` learns from, and embedding rows whose changes are added up together.
FOLDS, CHUNK = 2, 1 << 13
#: Changes are added up as multiples of 1 / UNIT, so that the sum doesn't depend on how the blocks are spread over tasks.
UNIT = float(1 << 44)
#: Steps of the log-odds, in which ``fit_all`` counts texts to calibrate: 1 / GRID.
GRID = 1 << 10
#: Share of words that a training pass leaves out, so that no single word explains a text; scale of untrained embeddings.
DROPPED, SCALE = 0.5, 0.05
#: What a logit of distance from the balanced threshold costs in calibration, in F1: few labels don't move it far.
PULL = 0.01
#: Words that are convolved at once.
STRETCH = 1 << 16

FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on are be this by from",
    "de": "der die und das ist nicht mit den von sich auf ein eine dem zu auch für",
    "fr": "le les et des est une dans que qui pour pas sur avec au du ce",
    "es": "el los las y del que en una por con para es como se su al",
    "it": "il di che è per una con del non sono gli della",
    "pt": "o os as e do da em um uma para com não por dos",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two embedding rows per word, words per text, language number per text)."""
    words, heads, counts = word_hashes(texts, FIRST)
    ids = np.stack([words % np.uint64(BUCKETS), heads % np.uint64(BUCKETS) + np.uint64(BUCKETS)], axis=1).astype(np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    hits = np.zeros((len(counts), len(FUNCTION_WORDS)), np.int64)
    for k, known in enumerate(_function_hashes()):
        hits[:, k] = np.bincount(owner[np.isin(words, known)], minlength=len(counts))
    return ids, counts, np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(FUNCTION_WORDS))


def _tokens_of(texts: list[str], at_once: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a list of texts, a few at once, so that only the embedding rows of all are held together."""
    parts = [_tokens(pa.array(texts[k : k + at_once], pa.string())) for k in range(0, len(texts), at_once)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


_known: list[np.ndarray] = []


def _function_hashes() -> list[np.ndarray]:
    if not _known:
        _known.extend(word_hashes(pa.array([w]), FIRST)[0] for w in FUNCTION_WORDS.values())
    return _known


@dataclass
class Model:
    """Embeddings, a filter bank per width, a logistic layer, and a shift of the log-odds per language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    base: float
    shift: np.ndarray

    def pooled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each text, not below 0, and the place of its window's first word (-1: none)."""
        total = len(WIDTHS) * FILTERS
        best, place = np.zeros((len(counts), total), np.float32), np.full((len(counts), total), -1, np.int64)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        reach = max(WIDTHS) - 1
        for at in range(0, len(ids), STRETCH):
            part = ids[at : at + STRETCH + reach]
            vectors = self.embedding[part[:, 0]] + self.embedding[part[:, 1]]
            new = min(STRETCH, len(ids) - at)
            mine = owner[at : at + new]
            starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            texts = mine[starts]
            for w, width in enumerate(WIDTHS):
                rows = min(new, len(vectors) - width + 1)
                if rows <= 0:
                    continue
                out = np.full((new, FILTERS), -np.inf, np.float32)
                out[:rows] = self.bias[w]
                for j in range(width):
                    out[:rows] += vectors[j : j + rows] @ self.filters[w][j]
                # windows that leave their text don't count
                out[:rows][at + np.arange(rows) + width > ends[mine[:rows]]] = -np.inf
                top = np.maximum.reduceat(out, starts, axis=0)
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                better = top > best[texts, cols]
                if better.any():
                    if self.training:
                        sizes = np.diff(np.r_[starts, new])
                        for k in np.flatnonzero(better.any(axis=1)):
                            where = at + starts[k] + out[starts[k] : starts[k] + sizes[k]].argmax(axis=0)
                            place[texts[k], cols] = np.where(better[k], where, place[texts[k], cols])
                    best[texts, cols] = np.where(better, top, best[texts, cols])
        return best, place

    training: bool = False

    def log_odds(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(ids, counts)[0] @ self.weights + self.base

    def score(self, texts: pa.Array) -> np.ndarray:
        return Committee([self]).score(texts)


@dataclass
class Committee:
    """Models whose shifted log-odds are averaged, and of how many texts each was fitted to and calibrated on."""

    models: list[Model]
    fitted: tuple[int, ...] = ()
    checked: tuple[int, ...] = ()

    def score(self, texts: pa.Array) -> np.ndarray:
        ids, counts, language = _tokens(texts)
        z = np.mean([m.log_odds(ids, counts) - m.shift[language] for m in self.models], axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


class _Adam:
    def __init__(self, *shapes):
        self.state = [(np.zeros(s, np.float32), np.zeros(s, np.float32)) for s in shapes]
        self.step = 0

    def move(self, values: list[np.ndarray], slopes: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for x, g, (m, v) in zip(values, slopes, self.state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


class _Learner:
    """A model that is being fitted, and what its steps remember."""

    def __init__(self, r: np.random.Generator):
        self.model = model = Model(
            (r.standard_normal((2 * BUCKETS + 1, DIM)) * SCALE).astype(np.float32),
            [(r.standard_normal((w, DIM, FILTERS)) * (1.0 / (w * DIM) ** 0.5)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            (r.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
            0.0,
            np.zeros(len(LANGUAGES)),
        )
        model.embedding[-1] = 0  # stands for words that are left out
        model.training = True
        self.small = _Adam(*(f.shape for f in model.filters), *(b.shape for b in model.bias), model.weights.shape, (1,))
        self.squares = np.full(2 * BUCKETS + 1, 1e-4, np.float32)
        self.base = np.zeros(1, np.float32)

    def walk(self, ids: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, order: np.ndarray, r: np.random.Generator, batch: int = BATCH) -> None:
        """A pass over the texts in ``order``, by stochastic gradients of the log-loss."""
        model, small, squares, base, ends = self.model, self.small, self.squares, self.base, np.cumsum(counts)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            sub = np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in rows])
            sub[r.random(len(sub)) < DROPPED] = 2 * BUCKETS
            pooled, place = model.pooled(sub, counts[rows])
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + base[0], -30, 30)))
            slope = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            down = slope[:, None] * model.weights * (place >= 0)
            g_filters, g_bias = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.bias]
            touched, pushed = [], []
            for w, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    c = w * FILTERS + f
                    at = np.flatnonzero(down[:, c])
                    if not len(at):
                        continue
                    d = down[at, c]
                    g_bias[w][f] = d.sum()
                    for j in range(width):
                        tokens = sub[place[at, c] + j]
                        vectors = model.embedding[tokens[:, 0]] + model.embedding[tokens[:, 1]]
                        g_filters[w][j, :, f] = d @ vectors
                        push = d[:, None] * model.filters[w][j, :, f]
                        touched += [tokens[:, 0], tokens[:, 1]]
                        pushed += [push, push]
            small.move([*model.filters, *model.bias, model.weights, base], [*g_filters, *g_bias, slope @ pooled + 1e-4 * model.weights, slope.sum(keepdims=True)], RATE)
            if touched:
                at, g = np.concatenate(touched), np.concatenate(pushed)
                unique, where = np.unique(at, return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, where, g)
                total[unique == 2 * BUCKETS] = 0
                squares[unique] += (total**2).mean(axis=1)
                model.embedding[unique] -= 0.1 * total / np.sqrt(squares[unique])[:, None]

    def done(self) -> Model:
        self.model.training = False
        self.model.base = float(self.base[0])
        return self.model

    def _dense(self) -> list[np.ndarray]:
        """What every step moves."""
        return [*self.model.filters, *self.model.bias, self.model.weights, self.base, *(x for pair in self.small.state for x in pair)]

    def change(self, old: _Learner) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What differs from ``old``: (embedding rows, 1 for each, units) by chunk; at -1 what every step moves, in one row."""
        units = lambda x: np.rint(x * UNIT).astype(np.int64)
        flat = [np.concatenate([x.ravel() for x in own._dense()] + [[own.small.step]]).astype(np.float64) for own in (self, old)]
        out = {-1: (np.zeros(1, np.int64), np.ones(1, np.int64), units(flat[0] - flat[1])[None, :])}
        rows = np.flatnonzero(self.squares != old.squares)
        both = [np.column_stack([own.model.embedding[rows], own.squares[rows]]).astype(np.float64) for own in (self, old)]
        moved = units(both[0] - both[1])
        for c in np.unique(rows // CHUNK):
            mine = rows // CHUNK == c
            out[int(c)] = rows[mine], np.ones(mine.sum(), np.int64), moved[mine]
        return out

    def move(self, chunk: int, at: np.ndarray, n: np.ndarray, units: np.ndarray) -> None:
        """Add the mean of the changes of all blocks; of an embedding row, of those blocks that changed it."""
        mean = units / n[:, None] / UNIT
        if chunk >= 0:
            self.model.embedding[at] += mean[:, :-1].astype(np.float32)
            self.squares[at] += mean[:, -1].astype(np.float32)
            return
        parts, place = self._dense(), 0
        for x in parts:
            x += mean[0, place : place + x.size].reshape(x.shape).astype(np.float32)
            place += x.size
        for _, v in self.small.state:
            np.maximum(v, 0, out=v)
        self.small.step += max(1, round(mean[0, place]))


def _passes(texts: float, epochs: int = EPOCHS, batch: int = BATCH) -> int:
    """How often texts are gone through: few are seen more often."""
    return min(60, max(epochs, -int(-400 * batch // max(1, texts))))


def _constant(model: Model, toxic: bool) -> Model:
    model.weights[:] = 0
    model.base = 3.0 if toxic else -3.0
    model.training = False
    return model


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH) -> Model:
    """Fit to labelled texts."""
    return train_words(*(_tokens_of(texts) if texts else (np.empty((0, 2), np.int32), np.empty(0, np.int64), np.empty(0, np.int64))), labels, epochs, batch)


def train_words(ids: np.ndarray, counts: np.ndarray, language: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH) -> Model:
    """Fit by stochastic gradients of the log-loss, the classes weighted alike; then calibrate. One class only: a constant.

    ``ids``: two embedding rows per word of all texts, one after the other; ``counts``: words per text.
    """
    r = np.random.default_rng(SEED)
    learner = _Learner(r)
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return _constant(learner.model, bool(len(labels) and labels[0]))
    ends = np.cumsum(counts)
    toxic, other = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    toxic = toxic[np.arange(len(toxic)) % CALIBRATE != 0] if len(toxic) >= CALIBRATE else toxic
    known = np.zeros(len(labels), bool)
    known[toxic] = True
    known[other[: max(1, min(len(other) * 3 // 5, 200 + len(toxic)))]] = True
    weight = np.where(labels == 1, 0.5 / labels[known].mean(), 0.5 / (1 - labels[known].mean())).astype(np.float32)
    for _ in range(_passes(known.sum(), epochs, batch)):
        learner.walk(ids, counts, labels, weight, r.permutation(np.flatnonzero(known)), r, batch)
    model = learner.done()
    check = ~known if (~known).sum() >= 20 and 0 < labels[~known].mean() < 1 else np.ones(len(labels), bool)
    parts = np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in np.flatnonzero(check)])
    odds = model.log_odds(parts, counts[check])
    model.shift = calibrated(odds, labels[check], language[check])
    return model


def calibrated(odds: np.ndarray, labels: np.ndarray, language: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
    """Shifts that bring each language's best decision threshold (by F1) to ``THRESHOLD``; few labels: the common one.

    With ``texts``, an entry stands for as many texts, of which ``labels`` are toxic.
    """
    target = np.log(THRESHOLD / (1 - THRESHOLD))
    texts = np.ones(len(odds), np.int64) if texts is None else texts

    def best(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        z, y, n = z[order], y[order], n[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.cumsum(n) + y.sum())
        # between two neighbouring scores nearer to the higher one: a largest response has its long tail above
        between = np.r_[0.3 * z[1:] + 0.7 * z[:-1], z[-1] - 1]
        between = np.clip(np.minimum(between, z - 1e-6), np.r_[z[1:] + 1e-6, -np.inf], None)
        gain = f1 - PULL * np.abs(between)
        gain[np.r_[z[1:] == z[:-1], False]] = -1e9  # equal scores fall on one side
        return float(between[int(np.argmax(gain))])

    common = best(odds, labels, texts)
    out = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        mine = language == k
        if labels[mine].sum() >= 10 and (texts - labels)[mine].sum() >= 10:
            out[k] = best(odds[mine], labels[mine], texts[mine])
    return out - target


def _given(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, _o``, one row per labelled id, with a hash of the id, which differs for any two."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return given.withColumn("_o", F.xxhash64(F.lit("toxicity"), "doc_id"))


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, language = _tokens(batch.column("text"))
        narrow, ends = (ids - np.array([0, BUCKETS], np.int32)).astype("<u2"), np.cumsum(counts)
        words = [narrow[e - n : e].tobytes() for n, e in zip(counts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("_o"), batch.column("toxic"), pa.array(language.astype(np.int32)), pa.array(words, pa.binary())], ["o", "toxic", "language", "words"])


def _rows_of(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<u2").reshape(-1, 2).astype(np.int32) + np.array([0, BUCKETS], np.int32)


def _hashed(docs: DataFrame, given: DataFrame) -> DataFrame:
    """``o, words, toxic, language`` of the labelled texts: four bytes a word; of a repeated id one text."""
    arrow_batches(docs.sparkSession)
    rows = docs.where("text is not null").select("doc_id", "text").join(given, "doc_id").select("_o", "toxic", "text")
    hashed = rows.mapInArrow(_hash_words, "o long, toxic int, language int, words binary")
    return hashed.groupBy("o").agg(F.min(F.struct("words", "toxic", "language")).alias("x")).select("o", "x.*")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; null ids, texts and labels are left out.

    The sample is bounded: ``sample`` toxic documents and ``OTHERS`` times as many others, those with the smallest hashes
    of their ids, and of these as many as ``SAMPLE_BYTES`` hold, a share per class. They are picked from the labels alone
    and then broadcast to the documents, so no text is shuffled; only hashed words reach the driver. A document that is
    labelled more than once is toxic if one label says so; of a repeated id one text counts.
    """
    given = _given(labels)
    chosen = [given.where(F.col("toxic") == y).orderBy("_o", "doc_id").limit(n) for y, n in ((0, sample * OTHERS), (1, sample))]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most (1 + OTHERS) * sample rows
    one = materialize(_hashed(docs, picked), "toxicity-sample")
    sizes = one.select("toxic", "o", F.octet_length("words")).collect()  # as few rows
    last = {}
    for label, share in ((0, OTHERS), (1, 1)):
        room = SAMPLE_BYTES * share // (1 + OTHERS)
        for _, o, size in sorted(r for r in sizes if r[0] == label):
            room -= size
            if room < 0:
                break
            last[label] = o
    within = [(F.col("toxic") == label) & (F.col("o") <= o) for label, o in last.items()]
    found = sorted(one.where(reduce(lambda a, b: a | b, within)).collect()) if within else []
    discard(one)
    words = [_rows_of(r["words"]) for r in found]
    ids = np.concatenate([*words, np.empty((0, 2), np.int32)])
    column = lambda c: np.array([r[c] for r in found], np.int64)
    return train_words(ids, np.array([len(w) for w in words], np.int64), column("language"), column("toxic"))


_BLOCK = "fold int, block int, toxic binary, language binary, lengths binary, words binary"
_CHANGE = "part int, at binary, n binary, units binary"


def _pack(block: pa.Table) -> pa.Table:
    """The texts of a block in one row, in the order of their ids' hashes."""
    block = block.sort_by("o")
    words = block.column("words").to_pylist()
    lengths = np.array([len(w) // 4 for w in words], "<i8")
    binary = [np.asarray(block.column(c)).astype("<i4").tobytes() for c in ("toxic", "language")] + [lengths.tobytes(), b"".join(words)]
    return pa.table([block.column("fold")[:1], block.column("block")[:1], *(pa.array([b], pa.binary()) for b in binary)], ["fold", "block", "toxic", "language", "lengths", "words"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, block, embedding rows, words per text, labels, languages) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            fold, block, toxic, language, lengths, words = (c[k].as_py() for c in batch.columns)
            yield fold, block, _rows_of(words), np.frombuffer(lengths, "<i8"), np.frombuffer(toxic, "<i4"), np.frombuffer(language, "<i4")


class _Sums:
    """Changes of many blocks, added up per part: a chunk of a fold's embedding, or what every step of it moves."""

    def __init__(self):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, part: int, at: np.ndarray, n: np.ndarray, units: np.ndarray) -> None:
        if part not in self.parts:
            self.parts[part] = np.zeros(CHUNK if part >= 0 else 1, np.int64), np.zeros((CHUNK if part >= 0 else 1, units.shape[1]), np.int64)
        seen, total = self.parts[part]
        seen[at % CHUNK] += n
        total[at % CHUNK] += units

    def batches(self) -> Iterator[pa.RecordBatch]:
        for part, (seen, total) in self.parts.items():
            at = np.flatnonzero(seen)
            columns = [x.astype("<i8").tobytes() for x in (at, seen[at], total[at])]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], ["part", "at", "n", "units"])


def _changes(rows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for part, *binary in rows:
        at, n, units = (np.frombuffer(b, "<i8") for b in binary)
        yield part, at, n, units.reshape(len(at), -1)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        for change in _changes(zip(*(c.to_pylist() for c in batch.columns))):
            sums.add(*change)
    yield from sums.batches()


def fit_all(docs: DataFrame, labels: DataFrame) -> Committee:
    """Learn from every text of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` names; nulls are left out.

    The texts fall into two halves by a hash of their ids. One model is fitted to each half and calibrated on the other,
    so every text counts in a model and in thresholds that it wasn't fitted to; scores average both. Where a half has
    fewer than ``CALIBRATE`` texts of a class, one model is fitted to all texts and calibrated on them. One class only
    gives a constant. A document that is labelled more than once is toxic if one label says so; of a repeated id one text
    counts.

    A half is split by the same hash into blocks of about ``BLOCK_BYTES`` of hashed words. In each round all blocks walk
    on from the common model on their own, and the means of their changes move it; an embedding row moves by the mean over
    the blocks that hold it, so a word that few blocks hold is not held back. A half of one block is walked in one job.
    Changes are added up by chunks of the embedding on the executors: the driver gets one sum per half (at most 7 MB),
    and counts of texts by language and log-odds in steps of 1 / ``GRID``.
    """
    spark = docs.sparkSession
    one = materialize(_hashed(docs, broadcast_if_small(_given(labels))[0]), "toxicity-words")
    halves = F.pmod("o", F.lit(FOLDS)).cast("int")
    sizes = one.groupBy(halves.alias("fold"), "toxic").agg(F.count("*"), F.sum(F.octet_length("words"))).collect()
    texts = np.zeros((FOLDS, 2), np.int64)
    held = np.zeros(FOLDS, np.int64)
    for fold, toxic, n, size in sizes:
        texts[fold, toxic] = n
        held[fold] += size
    if not texts.sum(axis=0).all():
        discard(one)
        n = (int(texts.sum()),)
        return Committee([_constant(_Learner(np.random.default_rng(SEED)).model, bool(texts[:, 1].any()))], n, n)
    if texts.min() < CALIBRATE:
        texts, held, halves = texts.sum(axis=0, keepdims=True), held.sum(keepdims=True), F.lit(0)
    folds = range(len(texts))
    n_blocks = [max(1, -int(-size // BLOCK_BYTES)) for size in held]
    block = F.pmod(F.shiftright("o", 8), F.array(*map(F.lit, n_blocks))[F.col("fold")]).cast("int")
    packed = materialize(one.withColumn("fold", halves).withColumn("block", block).groupBy("fold", "block").applyInArrow(_pack, _BLOCK), "toxicity-blocks")
    discard(one)

    weights = [np.array([0.5 * t.sum() / t[0], 0.5 * t.sum() / t[1]], np.float32) for t in texts]
    learners = [_Learner(np.random.default_rng([SEED, k])) for k in folds]
    passes = max(_passes(t.sum() / n) for t, n in zip(texts, n_blocks))
    at_once = passes if max(n_blocks) == 1 else 1
    chunks = 2 * BUCKETS // CHUNK + 1
    for first in range(0, passes, at_once):
        shared = spark.sparkContext.broadcast(learners)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = _Sums()
            for fold, block, ids, counts, toxic, _ in _blocks(batches):
                old = shared.value[fold]
                own = copy.deepcopy(old)
                r = np.random.default_rng([SEED, first, fold, block])
                for _ in range(at_once):
                    own.walk(ids, counts, toxic, weights[fold][toxic], r.permutation(len(counts)), r)
                for chunk, change in own.change(old).items():
                    sums.add(fold * chunks + chunk if chunk >= 0 else -1 - fold, *change)
            yield from sums.batches()

        moved = packed.mapInArrow(walk, _CHANGE).repartition("part").mapInArrow(_add_up, _CHANGE).collect()
        for part, at, n, units in _changes(moved):
            fold, chunk = divmod(part, chunks) if part >= 0 else (-1 - part, -1)
            learners[fold].move(chunk, at + max(chunk, 0) * CHUNK, n, units)
        shared.destroy()

    models, last = [learner.done() for learner in learners], len(learners) - 1
    shared = spark.sparkContext.broadcast(models)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, _, ids, counts, toxic, language in _blocks(batches):
            k = last - fold  # the model of the other half
            odds = np.rint(np.clip(shared.value[k].log_odds(ids, counts), -30, 30) * GRID).astype(np.int64)
            keys, where = np.unique(np.column_stack([language, odds]), axis=0, return_inverse=True)
            n = np.bincount(where.ravel(), minlength=len(keys))
            hits = np.bincount(where.ravel(), toxic, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), pa.array(hits)], ["model", "language", "odds", "n", "hits"])

    seen = packed.mapInArrow(look, "model long, language long, odds long, n long, hits long")
    counted = seen.groupBy("model", "language", "odds").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).orderBy("model", "language", "odds").toArrow()
    shared.destroy()
    discard(packed)
    model, language, odds, n, hits = (c.to_numpy() for c in counted.columns)
    for k in folds:
        mine = model == k
        models[k].shift = calibrated(odds[mine] / GRID, hits[mine], language[mine], n[mine])
    return Committee(models, tuple(int(t.sum()) for t in texts), tuple(int(n[model == k].sum()) for k in folds))


def score(docs: DataFrame, model: Model | Committee) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, score, predicted``, a row per row.

    A null or empty text has no words and gets the score of an empty pool. Null ids and repeated rows are carried along;
    other columns are ignored; an empty table gives no rows. A model has a fixed size of about 3 MB.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
