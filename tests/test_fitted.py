"""The embedder against numpy, the guard on rows that it has not seen, and tables that are filled again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import guards, hashed
from quern.sources import tables


def _texts(n=120):
    r = random.Random(1)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("tax", "law", "sea", "sun")]
    return [(i, " ".join(r.choice(topics[i % 4]) for _ in range(30)) + (" Common" if i % 2 else "")) for i in range(n)]


@pytest.fixture
def features(spark, tmp_path):
    docs = spark.createDataFrame([*_texts(), (500, None), (501, " . ")], "doc_id long, text string").repartition(3)
    hashed.hashed_words(docs, "doc_id", "text", 256).write.parquet(f"{tmp_path}/f")
    return spark.read.parquet(f"{tmp_path}/f")


def test_embedder_is_the_leading_subspace(spark, features):
    model = hashed.fit_embedder(features, 256, 4, 8)
    rows = {r["doc_id"]: (r["at"], r["weight"]) for r in features.collect()}
    x = np.zeros((len(rows), 256))
    for i, (at, weight) in enumerate(rows.values()):
        x[i, at] = weight
    held = (x > 0).sum(0)
    x *= np.log((len(rows) + 1) / (held + 1))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    right = np.linalg.svd(x, full_matrices=False)[2][:4]
    assert np.linalg.svd(right @ model.basis)[1].min() > 0.999
    got = {r["doc_id"]: r["vector"] for r in hashed.embed(features, "doc_id", model).collect()}
    assert got[500] == got[501] == [0.0] * 4
    for i, key in enumerate(rows):
        assert np.allclose(np.abs(got[key]), np.abs(x[i] @ model.basis), atol=1e-9)
    # texts of a topic are nearer to each other than to any other
    unit = np.array([got[i] / np.linalg.norm(got[i]) for i in range(120)])
    near = unit @ unit.T - 2 * np.eye(120)
    assert all(j % 4 == i % 4 for i, j in enumerate(near.argmax(1)))


def test_few_texts(spark):
    none = hashed.hashed_words(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 16)
    assert hashed.embed(none, "doc_id", hashed.fit_embedder(none, 16, 3, 1)).count() == 0
    one = hashed.hashed_words(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text", 16)
    assert len(hashed.embed(one, "doc_id", hashed.fit_embedder(one, 16, 3, 1)).first()["vector"]) == 3


def test_guard_on_unseen_rows(spark, tmp_path):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("toxic").alias("y")).where("y IS NOT NULL")
    rows = docs.join(labels, "doc_id")
    hashed.hashed_words(rows, "doc_id", "text", 1 << 13).write.parquet(f"{tmp_path}/g")
    features = spark.read.parquet(f"{tmp_path}/g")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = hashed.fit_guard(features.where(~held_out), 1 << 13, 25)
    told = hashed.guarded(features.where(held_out), model, F.lit(True)).collect()
    ones, zeros = [r["score"] for r in told if r["y"] == 1], [r["score"] for r in told if r["y"] == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) > 0.8
    # the gradient is that of the loss, worked out by hand
    small = features.where(~held_out).limit(40)
    found, rest = hashed._gradient(small, model, 3.0)
    want, total, n = np.zeros(1 << 13), 0.0, 0.0
    for r in small.collect():
        x = np.zeros(1 << 13)
        x[r["at"]] = r["weight"]
        x *= model.scale
        x /= max(np.linalg.norm(x), 1e-300)
        count = 3.0 if r["y"] else 1.0
        off = count * (1 / (1 + np.exp(-(x @ model.weights + model.constant))) - r["y"])
        want, total, n = want + off * x, total + off, n + count
    assert np.allclose(found, want / n) and np.isclose(rest, total / n)


def test_guard_fails_closed(spark):
    features = hashed.hashed_words(spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a", 0)], "doc_id long, text string, y int").withColumn("has_text", F.col("text").isNotNull()), "doc_id", "text", 16)
    model = hashed.fit_guard(features.where("y IS NOT NULL"), 16)  # one label alone: no weights
    assert not model.weights.any()
    got = {r["doc_id"]: (r["score"], r["refused"]) for r in hashed.guarded(features, model, F.col("has_text"), 0.6).collect()}
    assert got == {1: (None, True), 2: (0.5, False), 3: (0.5, False)}


def test_filled_again(spark, tmp_path):
    """A second run adds nothing, a changed document gives way, and chunks meet documents without a shuffle."""
    schema = "doc_id long, lang string, text string"
    first = spark.createDataFrame([(i, "en", f"a{i}\nb\n\nc") for i in range(50)] + [(None, "en", "x"), (3, "zz", "A smaller text")], schema)
    tables.create_store(first, "doc_id", "text", "again", f"file://{tmp_path}/store", 4, 4)
    for _ in range(2):
        tables.upsert(first, "doc_id", "text", "\n", r"^(\S+)", "again")
        documents, chunks = tables.stored(spark, "again")
        assert documents.count() == 50 and chunks.count() == 150 and documents.columns == ["doc_id", "lang"]
    tables.upsert(spark.createDataFrame([(7, "de", "one"), (8, "de", None), (99, "fr", "x\ny")], schema), "doc_id", "text", "\n", r"^(\S+)", "again")
    documents, chunks = tables.stored(spark, "again")
    assert {r["doc_id"]: r["lang"] for r in documents.where("lang <> 'en'").collect()} == {7: "de", 8: "de", 99: "fr"}
    assert documents.count() == 51 and chunks.count() == 150 - 6 + 1 + 2
    assert sorted(r["chunk"] for r in chunks.where("doc_id = 99").collect()) == ["x", "y"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = chunks.join(documents, "doc_id")
        assert joined.count() == 147 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.upsert(first.limit(0), "doc_id", "text", "\n", r"^(\S+)", "again")
    assert tables.stored(spark, "again")[1].count() == 147
    spark.sql("DROP TABLE again_documents")
    spark.sql("DROP TABLE again_chunks")


def test_models_get_small_batches(spark):
    """However long the texts are, a model and the hashing of words get few of them at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        rows = spark.range(600, numPartitions=1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("word "), 20_000)).alias("text"))
        told = guards.with_model(rows, "text", "n", lambda texts: texts.fillna("").str.len() * 0 + len(texts), "long")
        assert told.schema["n"].dataType.simpleString() == "bigint" and told.columns == ["id", "text", "n"]
        found = told.agg(F.max("n").alias("most"), F.count("n").alias("n"), F.count("text").alias("texts")).first()
        assert found["most"] <= 64 and found["n"] == 600 and found["texts"] == 599
        spark.conf.set(key, "64m")
        hashed.hashed_words(rows, "id", "text", 16)
        assert spark.conf.get(key) == f"{4 << 20}b"
    finally:
        spark.conf.set(key, before)
