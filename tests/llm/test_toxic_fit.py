"""What the toxicity score is fitted on."""

import time

import numpy as np
from pyspark.sql import functions as F

from fathomry.llm import common, passage_quality, toxic_spans


def test_fitted_on_six_thousand_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxic_spans, "fit", lambda texts, labels: seen.append((len(texts), len(labels))))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    toxic_spans.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert seen == [(6000, 6000)]


def test_background_is_a_named_bound(monkeypatch):
    texts = [(f"tox{i % 3} " if i % 4 == 0 else "") + " ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(30)) for i in range(400)]
    labels = np.array([float(i % 4 == 0) for i in range(400)])
    known = []
    for n in (0, 6_000):
        monkeypatch.setattr(toxic_spans, "BACKGROUND", n)
        known.append(len(toxic_spans.fit([t.encode() for t in texts], labels, 2).weights[0]))
    assert known[0] < known[1]


def test_labels_of_absent_documents_take_no_place(spark):
    """Labels cover far more documents than the table holds: the fit is of those that are there."""
    docs = spark.range(200).select((F.col("id") * 1999).alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "BUY!! $$$ now ").otherwise("some plain words here "), "id").alias("text"))
    label = lambda df: df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    few, many = label(docs), label(spark.range(400_000).withColumnRenamed("id", "doc_id"))
    drawn = [common.labelled_sample(docs, labels, "quality", 4000).orderBy("doc_id").collect() for labels in (few, many)]
    assert len(drawn[0]) > 140 and drawn[0] == drawn[1]
    models = [passage_quality.train(docs, labels) for labels in (few, many)]
    assert all(np.allclose(models[0].weights[k], models[1].weights[k]) for k in models[0].weights)


def test_stretches_in_linear_time():
    odd = "é bad bad x  日本 bad" * 3
    marks = np.array([1.0 if w.startswith("bad") else -1.0 for w in odd.split()])
    found = [(s["start"], s["end"]) for s in toxic_spans.stretches(odd.encode(), marks)]
    assert [odd[a:b] for a, b in found] == ["bad bad", "badé bad bad", "badé bad bad", "bad"]
    long, began = ("bad good " * 400_000).encode(), time.time()
    assert len(toxic_spans.stretches(long, np.tile([1.0, -1.0], 400_000))) == 400_000
    assert time.time() - began < 20
