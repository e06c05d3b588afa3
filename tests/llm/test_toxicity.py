import pytest
from pyspark.sql import functions as F

from provlake.llm import toxicity as tx


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, tx.fit(docs, labels)


def test_held_out_accuracy(spark, fitted):
    docs, labels, model = fitted
    rows = model.scored(docs).join(labels, "doc_id").select("doc_id", "score", "toxic", tx.fold_of(F.col("doc_id"), 5).alias("fold")).collect()
    held = [r for r in rows if r.fold == 0]
    assert sum((r.score >= 0.5) == r.toxic for r in held) / len(held) > 0.93
    assert sum(r.score >= 0.5 for r in rows if not r.toxic) <= 3


def test_features():
    f = dict(zip(tx.FEATURES, tx.text_features("You are an IDIOT! m0r*n sooo bad", frozenset({"bad"})), strict=True))
    assert f["seed_rate"] == pytest.approx(1 / 7) and f["masked_hits"] > 0 and f["near_second_person"] > 0 and f["long_runs"] > 0
    assert tx.text_features("caramelo", frozenset({"caram*"}))[3] == 1.0
    assert tx.text_features(None, frozenset()) == tx.text_features(" \n", frozenset()) == [0.0] * len(tx.FEATURES)


def test_odd_rows_and_filter(spark, fitted, odd_docs, no_docs):
    _, _, model = fitted
    rows = model.scored(odd_docs, "_s").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["_s"] <= 1 for r in rows)
    assert model.scored(no_docs).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = tx.without_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and tx.fit(no_docs, none).scored(odd_docs, "_s").select("_s").distinct().count() == 1


def test_labels_outside_the_training_folds_do_not_count(spark, fitted):
    docs, labels, model = fitted
    flipped = labels.withColumn("toxic", F.when(tx.fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    sample = lambda x: sorted((r.doc_id, r.label) for r in tx.labelled_sample(docs, x).collect())
    assert sample(flipped) == sample(labels)
