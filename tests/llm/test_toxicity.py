"""Toxicity: held-out quality, calibration, the convolution against a plain one, and odd texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import langid
from lexweave.llm import toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return X.fit(docs, labels.where(~langid.held_out(F.col("doc_id"), 3, 1)), sample=1500)


def test_held_out(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score(docs, model).join(labels.where(langid.held_out(F.col("doc_id"), 3, 1)), "doc_id").select("score", "predicted", "toxic").toPandas()
    y, s = rows["toxic"].to_numpy(), rows["score"].to_numpy()
    rank = s.argsort().argsort()
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))
    # some labelled texts hold no word that tells
    assert n > 80 and auc > 0.93
    hits = (rows["predicted"] * y).sum()
    assert hits / n > 0.85 and hits / rows["predicted"].sum() > 0.9
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def plain_pooled(model, text):
    ids, _, _ = X._tokens(pa.array([text]))
    v = model.embedding[ids[:, 0]] + model.embedding[ids[:, 1]]
    out = []
    for w, width in enumerate(X.WIDTHS):
        best = np.zeros(X.FILTERS)
        for k in range(len(v) - width + 1):
            best = np.maximum(best, model.bias[w] + sum(v[k + j] @ model.filters[w][j] for j in range(width)))
        out.append(best)
    return np.concatenate(out)


@pytest.mark.parametrize("stretch", [4, 7, 1 << 16])
def test_pooling_over_stretches(model, monkeypatch, stretch):
    texts = ["one two three four five six seven", "", "a", "a b", "you are a moron and a clown", "x " * 30]
    monkeypatch.setattr(X, "STRETCH", stretch)
    ids, counts, _ = X._tokens(pa.array(texts))
    got, _ = model.pooled(ids, counts)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_pooled(model, text), abs=1e-4)


def test_language_guess():
    _, _, language = X._tokens(pa.array(["the cat of the house", "der Hund und das Haus", "le chat et les maisons", "el gato y los perros", "zzz", None]))
    assert [X.LANGUAGES[k] for k in language] == ["en", "de", "fr", "es", "other", "other"]


def test_calibration_moves_the_threshold():
    odds = np.array([-3.0, -2, -1.5, -1, 0, 1] * 20)
    labels = (odds > -1.2).astype(int)
    shift = X.calibrated(odds, labels, np.zeros(len(odds), int))[0]
    p = 1 / (1 + np.exp(-(odds - shift)))
    assert ((p >= X.THRESHOLD) == labels).all()


def test_odd_texts(spark, model):
    rows = [(1, None, 3, "x"), (2, "", 3, "x"), (None, "a", 3, "x"), (3, "moron " * 200_000, 3, "x"), (3, "ça va", 3, "x"), (3, "ça va", 3, "x")]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string"), model).collect()
    assert [r["doc_id"] for r in got] == [1, 2, None, 3, 3, 3]
    assert all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] and got[4]["score"] == got[5]["score"]
    assert got[3]["predicted"] == 1 and got[0]["predicted"] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.score(empty, model).count() == 0


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(200)] + [(7, "again")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 3) for i in range(200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "train_words", lambda ids, counts, language, toxic: seen.append((len(ids), toxic.tolist())))
    X.fit(docs, labels)
    assert len(seen[0][1]) == 200 and sum(seen[0][1]) == 50
    monkeypatch.setattr(X, "SAMPLE_BYTES", 16_000)  # 200 bytes a text
    X.fit(docs, labels)
    assert seen[1][0] * 4 <= 16_000 and 60 <= len(seen[1][1]) <= 81 and 15 <= sum(seen[1][1]) <= 21


def test_gradients_of_the_filters(monkeypatch):
    """A step lowers the loss of a tiny sample, and the scores are those of the plain formula."""
    texts, labels = ["good day to you", "you vile moron", "a fine house", "vile moron again"] * 12, np.array([0, 1, 0, 1] * 12)
    model = X.train(texts, labels, epochs=20)
    got = model.score(pa.array(texts[:4]))
    _, _, language = X._tokens(pa.array(texts[:4]))
    for k, text in enumerate(texts[:4]):
        odds = plain_pooled(model, text) @ model.weights + model.base - model.shift[language[k]]
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -30, 30))), abs=1e-4)
    assert ((got >= X.THRESHOLD) == (labels[:4] == 1)).all()


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, toxic int")
    none = X.fit(docs, labels())
    assert X.score(docs, none).where("predicted = 1").count() == 0
    alone = X.fit(docs, labels((1, 1), (2, None), (None, 0), (9, 1)))
    assert X.score(docs, alone).where("predicted = 1").count() == 3
    both = X.fit(docs, labels((1, 1), (2, 0), (1, 0)))
    assert X.score(docs, both).count() == 3


def test_the_query_learns_from_every_label(spark, tmp_path):
    """A word that only toxic texts of the largest hashes hold is known, though these are more than a sample would hold."""
    from lexweave.llm import queries

    n = 13_000
    ids = spark.range(n).withColumn("held", langid.held_out(F.col("id"), 3, 1)).withColumn("toxic", (F.col("id") % 2).cast("int"))
    late = {r["id"] for r in ids.where("toxic = 1 and not held").orderBy(F.desc(F.xxhash64(F.lit("toxicity"), "id"))).limit(500).collect()}
    asked = [r["id"] for r in ids.where("toxic = 1 and held").limit(40).collect()]
    assert ids.where("toxic = 1 and not held").count() - len(late) > X.SAMPLE
    word = lambda k: "zorgl" if k in late or k in asked else "moron" if k % 2 else "house"
    docs = [(k, f"plain{k % 97} {word(k)} plain{k % 89} text{k % 83}") for k in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids.selectExpr("id doc_id", "1 quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op10_toxicity_cnn(spark, str(tmp_path)).collect()}
    assert len(got) == n and all(got[k]["held_out"] for k in asked)
    assert sum(got[k]["predicted"] for k in asked) >= 36
    assert sum(r["predicted"] for k, r in got.items() if k % 2 == 0) < 60


def test_every_text_counts_in_a_model_and_in_thresholds(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.where(~langid.held_out(F.col("doc_id"), 3, 1))
    n = learned.join(docs, "doc_id").where("text is not null and toxic is not null").select("doc_id").distinct().count()
    whole = X.fit_all(docs, learned)
    assert sum(whole.fitted) == n and whole.checked == whole.fitted[::-1]
    monkeypatch.setattr(X, "BLOCK_BYTES", 50_000)  # several blocks a half
    blocks, spread = X.fit_all(docs, learned), X.fit_all(docs.repartition(5), learned.repartition(3))
    assert blocks.fitted == whole.fitted and blocks.checked == whole.checked
    for a, b in zip(blocks.models, spread.models):
        assert (a.embedding == b.embedding).all() and a.base == b.base and (a.shift == b.shift).all()
    rows = X.score(docs, blocks).join(learned, "doc_id")
    assert rows.where("predicted = toxic").count() / rows.count() > 0.95


def test_counted_texts_calibrate_as_single_ones():
    r = np.random.default_rng(3)
    odds, language, texts = np.arange(400) / 64 - 3, r.integers(0, 3, 400), r.integers(1, 6, 400)
    toxic = r.binomial(texts, 1 / (1 + np.exp(-2 * odds)))
    single = np.concatenate([np.arange(n) < y for n, y in zip(texts, toxic)]).astype(int)
    assert X.calibrated(odds, toxic, language, texts) == pytest.approx(X.calibrated(np.repeat(odds, texts), single, np.repeat(language, texts)))


def test_little_to_learn_from_for_the_whole(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, ""), (1, "a")], "doc_id long, text string")
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, toxic int")
    none = X.fit_all(docs, labels())
    assert X.score(docs, none).where("predicted = 1").count() == 0
    alone = X.fit_all(docs, labels((1, 1), (2, None), (None, 0), (9, 1)))
    assert X.score(docs, alone).where("predicted = 1").count() == 5 and alone.fitted == (1,)
    both = X.fit_all(docs, labels((1, 1), (2, 0), (1, 0), (4, 0), (3, 1)))
    assert both.fitted == both.checked == (3,)  # one model of all, where a half would have too few
    assert X.score(docs, both).count() == 5
