import numpy as np
import pytest
from pyspark.sql import functions as F

from lexirun.llm import toxicity as T
from lexirun.llm.queries import op10_classifier_chain


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    told = T.score(docs, seen).select("doc_id", F.col("p_toxic").alias("p"), F.col("p_low_quality").alias("low"))
    found = told.join(held.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    flagged = found["p"] >= T.THRESHOLD
    assert (flagged & (found["truth"] == 0)).sum() <= 0.002 * len(found)
    assert (flagged & (found["truth"] == 1)).sum() >= 0.75 * (found["truth"] == 1).sum()
    assert (((found["low"] >= 0.5) == (found["quality"] == 0)).mean()) > 0.98


def test_chain_feeds_probabilities_forward():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.integers(0, 40, 8).astype(np.uint32)), rng.normal(size=T.NUMBERS)) for _ in range(900)]
    rows = [(np.unique(w), x) for w, x in rows]
    first = np.array([float(7 in w) for w, _ in rows])
    noise = rng.random(900) < 0.05
    second = np.where(noise, 1 - first, first)
    labels, folds = np.stack([first, second], 1), np.arange(900) % T.FOLDS
    chain = T.fit_chain(rows, labels, folds)
    p = T.predict_chain(chain, rows)
    assert len(chain[1].mean) == T.NUMBERS + 1 and chain[1].weights[-1] > 0
    assert ((p[:, 0] >= 0.5) == first.astype(bool)).mean() > 0.98 and ((p[:, 1] >= 0.5) == first.astype(bool)).mean() > 0.97


def test_out_of_fold_predictions_do_not_see_their_row():
    rows = [(np.array([k], np.uint32), np.zeros(T.NUMBERS)) for k in range(60)]
    labels = np.array([[float(k % 2), float(k % 2)] for k in range(60)])
    chain = T.fit_chain(rows, labels, np.arange(60) % T.FOLDS)
    assert abs(chain[1].weights[-1]) < 1  # a word that no other row has tells nothing about the fold left out


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, None, None), (None, 1, 1), (77, 0, 1)]])
def test_small_and_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (None, None, 1.0), (3, "", 1.0)], "doc_id bigint, text string, p_toxic double")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = T.score(docs, labels).collect()
    assert len(found) == 4 and all(0 < r.p_toxic < 1 for r in found)
    assert T.score(docs.limit(0), labels).count() == 0
    assert T.drop_toxic(docs, labels).columns == docs.columns


def test_toxic_documents_go(spark):
    docs = [(k, f"word{k % 7} plain text {'idiotic words' if k % 5 == 0 else 'kind words'}") for k in range(300)]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(0, 300, 2)]
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert sorted(r.doc_id for r in T.drop_toxic(docs, labels).collect()) == [k for k in range(300) if k % 5]


def test_query(spark, sf_dir):
    found = op10_classifier_chain(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_dropping_by_row(spark):
    kind, bad = "kind words for all", "idiotic words you idiot"
    docs = [(k, f"word{k % 7} plain text {bad if k % 5 == 0 else kind}", 1, "x") for k in range(300)]
    odd = [(None, f"word1 plain text {bad}", 2, "a"), (None, f"word1 plain text {kind}", 2, "b"), (3, f"word2 plain text {bad}", 2, "c"), (4, None, 2, "d"), (6, "", 2, "e"), (7, f"{kind} " * 40_000, 2, "f")]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(0, 300, 2) if k not in (3, 4, 6, 7)], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, __id int, row string")
    left = T.drop_toxic(df, labels)
    assert left.columns == df.columns
    apart = spark.createDataFrame(docs + [(1000 + k, *r[1:]) for k, r in enumerate(odd)], df.schema)
    clean = {odd[r.doc_id - 1000][3] for r in T.score(apart, labels).collect() if r.doc_id >= 1000 and not r.toxic}
    assert {"b"} <= clean and not clean & {"a", "c"}
    assert {r.row for r in left.collect() if r.row != "x"} == clean
    assert T.drop_toxic(df.limit(0), labels).count() == 0


def test_query_scores(spark, sf_dir):
    """The query's own columns beside a chain fitted and applied here, row by row."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: (1.0 - r.quality, float(r.toxic)) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = sorted(set(labels) & set(docs))
    folds = T.pd.util.hash_array(np.array(known), categorize=False) % T.FOLDS
    chain = T.fit_chain([T.features(docs[d]) for d in known], np.array([labels[d] for d in known]), folds.astype(int))
    found = op10_classifier_chain(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs) and len(known) <= T.TRAIN_ROWS
    for r in found:
        words, numbers = T.features(docs[r.doc_id])
        earlier = np.zeros((1, 0))
        for model in chain:
            z = model.weights[0] + model.weights[1 : 1 + len(model.words)] @ np.isin(model.words, words)
            z += model.weights[1 + len(model.words) :] @ ((np.concatenate([numbers, earlier[0]]) - model.mean) / model.scale)
            earlier = np.hstack([earlier, [[1 / (1 + np.exp(-z))]]])
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(tuple(earlier[0]), abs=1e-6)
        assert r.toxic == (r.p_toxic >= T.THRESHOLD)
