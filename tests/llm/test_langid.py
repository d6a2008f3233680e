"""Language ID: accuracy on held-out documents, rejection, and odd texts."""

import pytest
from pyspark.sql import functions as F

from lexweave.llm import langid as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.fit(docs.where(~L.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(L.held_out(F.col("doc_id")))
    found = L.predict(docs, model).select("lang", "lang_pred", "rejected", "score").collect()
    assert len(found) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)
    assert all(0.5 <= r["score"] <= 1 for r in found)


def test_prediction_reads_only_the_text(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 50")
    a = L.predict(docs, model)
    b = L.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("doc_id", -F.col("doc_id")), model)
    pick = lambda df, sign: sorted((sign * r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    assert pick(a, 1) == pick(b, -1)


def test_held_out_is_crc32(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(0, 300).select("id", L.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)}


def test_bounded_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = L.fit(docs, dict_bytes=4096, max_languages=2)
    assert len(small.contents) == 2 and all(len(c) <= 4096 + L.PIECE_BYTES + 1 for c in small.contents.values())
    assert L.fit(docs) == L.fit(docs.repartition(3))


def test_odd_texts(spark, model):
    long = "the of and with this that is for " * 40_000
    rows = [(1, None, "x", 5), (2, "", None, 5), (3, "12 !! ...", "x", 5), (None, long, "x", 5), (4, "ça", "x", 5), (4, "ça", "x", 5)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    out = [(r["doc_id"], r["lang_pred"], r["score"] == 0, r["rejected"]) for r in got.collect()]
    assert out[:3] == [(i, "und", True, True) for i in (1, 2, 3)]
    assert out[3][1] == "en" and out[4] == out[5] and out[4][1] != "und"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.predict(empty, model).count() == 0
    assert L.fit(empty).contents == {} and L.fit(spark.createDataFrame([(1, None, "en"), (2, "x", None)], empty.schema)).contents == {}
    assert [r["lang_pred"] for r in L.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), L.Model({})).collect()] == ["und"]


def test_classify_by_brute_force():
    """The smallest total of plain compressions of the whole text, block by block, less the seed's own size."""
    import random

    import zstandard

    r = random.Random(3)
    say = lambda pool, n: " ".join(r.choice(pool) for _ in range(n))
    pools = {"aa": ["the", "house", "of", "winter", "and"], "bb": ["das", "haus", "der", "und", "nicht"], "cc": ["la", "maison", "des", "et", "pas"]}
    contents = {k: say(v, 3000).encode() for k, v in pools.items()}
    encoders = L.Model(contents).encoders()
    for n in (1, 5, 40, 4000):
        for pool in pools.values():
            text = say(pool, n) + " 12 !? " + say(pool, 2).upper()
            found = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
            totals = {}
            for lang, content in contents.items():
                shared = zstandard.ZstdCompressionDict(content[: -L.SEED_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                level = L.SHORT_LEVEL if len(found) <= L.SHORT_BYTES else L.LEVEL
                press = lambda b: len(zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))  # noqa: E731, B023
                seed = content[-L.SEED_BYTES :]
                blocks = [found[i : i + L.BLOCK_BYTES] for i in range(0, len(found), L.BLOCK_BYTES)]
                totals[lang] = max(1, press(seed + b" " + blocks[0]) - press(seed) + sum(map(press, blocks[1:])))
            first, second = sorted((t, lang) for lang, t in totals.items())[:2]
            got = L.classify(text, encoders)
            assert got[0] == first[1] and got[2] == ((second[0] - first[0]) / first[0] < L.MIN_MARGIN)


def test_short_texts(spark):
    """The seed lets texts of a few words compress at all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    found = L.predict(docs.where(L.held_out(F.col("doc_id")) & (F.length("text") < 120)), model).select("lang", "lang_pred", "rejected").collect()
    assert len(found) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert sum(r["rejected"] for r in found) <= 0.05 * len(found)
