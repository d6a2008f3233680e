"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with pieces of a bounded sample of labelled texts. A
text is encoded whole with every dictionary, block by block; the language whose encodings are smallest wins, and a
narrow margin rejects.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches, free_name

UNKNOWN = "und"
#: Bytes of each dictionary, and of a piece of a sampled text: the sample per language holds about their quotient of texts.
DICT_BYTES, PIECE_BYTES = 112 * 1024, 1024
#: Languages learned at most, the most frequent ones: the model is sent to every task. Rarer ones are never predicted.
MAX_LANGUAGES = 256
#: Compression levels of long texts and of those up to ``SHORT_BYTES``, where each match counts and time matters less.
LEVEL, SHORT_LEVEL, SHORT_BYTES = 4, 12, 1_000
#: Bytes of a text that are encoded together.
BLOCK_BYTES = 8_000
#: zstandard takes no shorter dictionary; a language with less text is never predicted.
LEAST_BYTES = 8
#: A prediction is rejected if the second-best encoding is larger than the best by a smaller share than this.
MIN_MARGIN = 0.005
#: Bytes of the language's own text before a text, whose size is taken off again: short texts alone would not be compressed.
SEED_BYTES = 300
#: Steepness of the score in the margin.
STEEP = 60.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The words of the whole text, lower-cased, with single spaces between them: digits and signs tell no language."""
    return " ".join(_NOT_LETTERS.sub(" ", text.lower()).split())


class Encoder:
    """Sizes of texts under one language's dictionary, after a seed of the same language that isn't in it."""

    def __init__(self, content: bytes):
        import zstandard

        cut = SEED_BYTES if len(content) > 4 * SEED_BYTES else 0
        self.seed, content = content[len(content) - cut :], content[: len(content) - cut]

        def encoder(level: int):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.encoders = encoder(LEVEL), encoder(SHORT_LEVEL)
        self.alone = [len(e(self.seed)) if cut else 0 for e in self.encoders]

    def size(self, blocks: list[bytes]) -> int:
        short = len(blocks) == 1 and len(blocks[0]) <= SHORT_BYTES
        encode, alone = self.encoders[short], self.alone[short]
        first = len(encode(self.seed + b" " + blocks[0])) - alone if self.seed else len(encode(blocks[0]))
        return max(1, first + sum(len(encode(b)) for b in blocks[1:]))


@dataclass(frozen=True)
class Model:
    """Sampled text by language; may be empty, then every text is unknown."""

    contents: dict[str, bytes]

    def encoders(self) -> dict[str, Encoder]:
        return {lang: Encoder(content) for lang, content in sorted(self.contents.items())}


def classify(text: str | None, encoders: dict[str, Encoder]) -> tuple[str, float, bool]:
    """(language, score, rejected). Null texts and texts without a letter are unknown with score 0; ties go to the first name."""
    found = letters(text).encode() if text else b""
    if not found or not encoders:
        return UNKNOWN, 0.0, True
    blocks = [found[i : i + BLOCK_BYTES] for i in range(0, len(found), BLOCK_BYTES)]
    sizes = sorted((e.size(blocks), lang) for lang, e in encoders.items())
    margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], 1 / (1 + math.exp(-min(700.0, STEEP * margin))), margin < MIN_MARGIN


def fit(labelled: DataFrame, dict_bytes: int = DICT_BYTES, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn dictionaries from ``labelled(doc_id, text, lang)``; rows with a null text or language are left out.

    The sample is bounded: about ``dict_bytes / PIECE_BYTES`` texts per language, picked by a hash of the id, each
    giving pieces of ``PIECE_BYTES`` from all over it. Fewer texts give more pieces each.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect())
    if not counts:
        return Model({})
    wanted = math.ceil(dict_bytes / PIECE_BYTES)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * wanted / n))])
    picked = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    each = {k: math.ceil(1.5 * wanted / min(n, 1.5 * wanted)) for k, n in counts.items()}
    arrow_batches(labelled.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                joined = letters(text).encode()
                for k in range(each[lang]):
                    at = k * PIECE_BYTES if each[lang] > 1 else key % max(1, len(joined) - PIECE_BYTES)
                    piece = joined[at : at + PIECE_BYTES]
                    if piece:
                        out.append((lang, key, k, piece.decode(errors="ignore")))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "key", "k", "piece"])

    sample = rows.where(F.col("lang").isin(list(counts))).where(picked).select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("key"), "text")
    pieces = sample.mapInArrow(cut, "lang string, key long, k int, piece string").collect()
    contents: dict[str, bytes] = {}
    for lang, _, _, piece in sorted(pieces):
        if len(contents.setdefault(lang, b"")) < dict_bytes:
            contents[lang] += piece.encode() + b" "
    return Model({k: v for k, v in contents.items() if len(v) >= LEAST_BYTES})


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """True for ids whose crc32 (of the id as text) has this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


VERDICT = "lang_pred string, score double, rejected boolean"


def verdict(text: Column, model: Model) -> Column:
    """``struct<lang_pred, score, rejected>`` of a text. Only the text goes to Python, and only the verdict comes back."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders = shared.value.encoders()
        for batch in batches:
            found = [classify(t.as_py(), encoders) for t in batch]
            columns = list(zip(*found)) or [[]] * 3
            parts = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(parts, [x.split()[0] for x in VERDICT.split(", ")])

    return run(text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``; columns of these names are replaced.

    Only ``text`` is read. Null texts and texts without a letter are ``und``, rejected, with score 0. Nulls elsewhere
    and repeated rows are carried along; an empty table gives no rows; with nothing learned all are ``und``.
    """
    arrow_batches(docs.sparkSession)
    kept = docs.drop(*(x.split()[0] for x in VERDICT.split(", ")))
    found = free_name(kept, "_found")
    return kept.withColumn(found, verdict(F.col("text"), model)).select(*kept.columns, f"{found}.*")
