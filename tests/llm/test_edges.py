"""Empty tables, nulls, repeated rows, very long texts, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm import (
    bag_minhash, chat_format, cross_polytope, language_id, mixing, pieces, pii, quality_network, quality_rules, secret_scan,
)
from llm_helpers import ODD, docs_of


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def owned(docs):
    return docs.select("doc_id", "text", F.col("source").alias("owner"), F.col("lang").alias("repo"))


def everything(spark, docs):
    """Rows of every operator over documents, by name."""
    labels = labels_of(spark, [(2, 1, 0), (4, None, 0), (None, 1, 1), (99, 0, 0)])
    vocabulary = pieces.load()
    out = {
        "secrets": secret_scan.digest(secret_scan.scan(owned(docs))), "rules": quality_rules.judge(docs, quality_rules.fit(docs, labels)),
        "mixing": mixing.take(docs), "network": quality_network.score(docs, quality_network.fit(docs, labels)),
        "pieces": pieces.decode(pieces.encode(docs.select("doc_id", "text"), vocabulary), vocabulary), "pii": pii.find(docs, pii.learn(docs)),
        "language": language_id.predict(docs, language_id.learn(docs)), "classes": bag_minhash.classes(docs),
    }
    return {name: df.collect() for name, df in out.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_all_come_back(spark, extra):
    found = everything(spark, docs_of(spark, ODD, extra))
    assert {name: len(rows) for name, rows in found.items()} == {name: len(ODD) for name in found}
    assert all((r.text or "") == r.decoded for r in found["pieces"])
    assert {r.lang_pred for r in found["language"] if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found["network"] + found["rules"] + found["language"])
    assert {r.class_size for r in found["classes"] if r.doc_id in (4, 5)} == {3}
    assert {(r.class_id, r.class_size) for r in found["classes"] if r.doc_id in (1, 2)} == {(1, 2)}
    assert all(r.taken <= 2 * r.size for r in found["mixing"])


def test_empty_tables(spark):
    assert all(rows == [] for rows in everything(spark, docs_of(spark, [])).values())
    log = chat_format.event_log(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat_format.digests(chat_format.render(chat_format.fold(log))).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cross_polytope.nearest(none, none).collect() == []


@pytest.mark.parametrize("rows, extra", [(ODD, True), ([], False)])
def test_stages_return_the_columns_of_documents(spark, rows, extra):
    docs = docs_of(spark, rows, extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert len(out.collect()) == len(rows)
