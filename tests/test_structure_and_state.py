"""Quantised search, ordered rules, limits, phrases, legal structure, quarantine and durable threads against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import guards, phrases, quantised, retrieval, structure, threads
from quern.streaming import threads as streams
from quern.streaming import turns


# Search by codes


def _recall(exact, found):
    want, got = defaultdict(set), defaultdict(set)
    for r in exact.collect():
        want[r.query_id].add(r.id)
    for r in found.collect():
        got[r.query_id].add(r.id)
    return sum(len(want[q] & got[q]) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("clusters, noise", [(50, 0.2), (4, 0.6)])
def test_recall_and_share(spark, metric, clusters, noise):
    """At least 0.9 of the five nearest, with full distances for a twentieth of the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 3000)] + noise * rng.normal(size=(3000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    asked = F.col("id") % 50 == 0
    assert _recall(retrieval.top_k(rows, asked, metric=metric), quantised.pq_top_k(rows, asked, parts=8, metric=metric)) >= 0.9
    full = quantised.candidates(rows, asked, 8, 150, metric)
    assert full.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 150


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = F.col("id") % 20 == 0
    assert _recall(retrieval.top_k(rows, asked), quantised.pq_top_k(rows, asked)) >= 0.9


def test_cells_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(quantised, "CODES", 40)
    monkeypatch.setattr(quantised, "QUERIES", 3)
    monkeypatch.setattr(quantised, "_SUMS", 64)
    r = random.Random(1)
    data = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(900, [0.0] * 5), (901, None), (None, [1.0] * 5), (0, [r.gauss(0, 1) for _ in range(5)])]
    rows = spark.createDataFrame(data, "id long, vector array<double>")
    asked = F.col("id") % 20 == 0
    assert _recall(retrieval.top_k(rows, asked), quantised.pq_top_k(rows, asked, parts=5)) >= 0.9
    assert quantised.pq_top_k(rows.limit(0), asked).count() == 0
    assert quantised.pq_top_k(rows.where("id = 900"), F.lit(True)).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_codes_with_bounds_are_exact(spark, monkeypatch, metric):
    """Where codes alone miss rows, those that can be nearer by what the codes hide are looked at too; ties, copies and odd vectors as in the exact search."""
    for name, n in (("FULL_CODES", 700), ("FULL_QUERIES", 30), ("_SUMS", 9000)):
        monkeypatch.setattr(quantised, name, n)
    monkeypatch.setattr(retrieval, "_PAIRS", 500)
    x = np.random.default_rng(5).normal(size=(3000, 24))
    x[100:140] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 24), (9001, None), (None, [1.0] * 24)]
    rows = spark.createDataFrame(data, "id long, vector array<double>").repartition(3)
    asked = F.col("id") % 20 == 0
    want = sorted(map(tuple, retrieval.top_k(rows, asked, metric=metric).collect()))
    assert want == sorted(map(tuple, quantised.exact_top_k(rows, asked, parts=6, metric=metric).collect()))
    assert want != sorted(map(tuple, quantised.pq_top_k(rows, asked, parts=6, share=0.005, metric=metric).collect()))
    assert quantised.exact_top_k(rows.limit(0), asked).count() == 0
    assert quantised.exact_top_k(rows.where("id < 3"), F.lit(True), metric=metric).count() == 6


def test_exact_search_in_few_blocks(spark, monkeypatch):
    """Short vectors stand in blocks of many rows, so that few copies of them move; what a task multiplies at once is bounded, and the rows are those of brute force."""
    made, blocked = [], retrieval._blocked
    monkeypatch.setattr(retrieval, "_blocked", lambda vectors, block, count: made.append((block, count)) or blocked(vectors, block, count))
    monkeypatch.setattr(retrieval, "_PRODUCTS", 5000)
    x = np.random.default_rng(8).normal(size=(4500, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {r["query_id"]: r["id"] for r in retrieval.top_k(rows, F.lit(True), 1).collect()}
    near = retrieval.similarity(x, x, "cosine")
    np.fill_diagonal(near, -2)
    assert got == dict(enumerate(np.round(near, 6).argmax(1).tolist()))
    assert dict(made)["block"] == 1


# Ordered rules


def test_rules(spark):
    r = random.Random(2)
    steps = [(t, s, r.choice("abcdx")) for t in range(60) for s in r.sample(range(400), r.randrange(1, 40))] + [(None, 1, "a"), (None, 2, "b"), (7, None, "c"), (8, 500, None)]
    df = spark.createDataFrame(steps, "request long, step long, node string").repartition(3)
    names = [(n, F.col("node") == n) for n in "abcd"]
    want = {}
    for t in {x[0] for x in steps}:
        path = sorted((s, n) for q, s, n in steps if q == t and s is not None and n is not None)
        extra = sum(q == t and n is None for q, s, n in steps)
        met, broken = 0, None
        for s, n in path:
            if n == "c" and broken is None:
                broken = s
            if met < 3 and n == "aba"[met]:
                met += 1
        want[t] = (len(path) + extra, None if broken is not None else met, broken, broken is None and met == 3)
    for span in (7, 10_000):
        got = {x[0]: tuple(x)[1:] for x in threads.obeys(df, "request", "step", names, ["a", "b", "a"], ["c"], span).collect()}
        assert got == want
    assert threads.obeys(df.limit(0), "request", "step", names, ["a"], []).count() == 0
    with pytest.raises(ValueError):
        threads.obeys(df, "request", "step", names, ["q"], [])


def test_a_long_request_is_spread(spark):
    """One request of 50,000 steps is folded in spans, not in one row."""
    df = spark.range(50_000).select(F.lit(1).alias("request"), F.col("id").alias("step"), F.when(F.col("id") == 49_999, "b").otherwise("a").alias("node"))
    done = threads.obeys(df, "request", "step", [(n, F.col("node") == n) for n in "ab"], ["a", "b"], [], 1000).first()
    assert tuple(done) == (1, 50_000, 2, None, True)


# Limits


def test_rolling_with_a_hot_user(spark):
    """Equal to counting by hand while one user holds a third of all rows; what a task sees of a user are two spans."""
    r = random.Random(3)
    rows = [(i, r.choice([1, r.randrange(2, 30), r.randrange(2, 30)]), r.randrange(0, 4000)) for i in range(1500)] + [(5000, None, 10), (5001, None, 11), (5002, 4, None), (5003, 4, None)]
    df = spark.createDataFrame(rows, "id long, user long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(3)
    got = {x["id"]: (x["n_recent"], x["limited"]) for x in threads.rolling(df, "ts", 60, "user", 3).collect()}
    for i, u, s in rows:
        n = sum(v == u and (t is None if s is None else t is not None and s - 60 <= t <= s) for _, v, t in rows)
        assert got[i] == (n, n > 3)


def test_limits_on_a_stream(spark, tmp_path):
    r = random.Random(4)
    rows = sorted((r.randrange(0, 50_000), i, r.choice([1, 1, r.randrange(2, 9)])) for i in range(900))
    df = spark.createDataFrame(rows, "s long, id long, user long").withColumn("ts", F.timestamp_seconds("s"))
    want = {i: sum(v == u and s - 600 <= t <= s for t, _, v in rows) for s, i, u in rows}
    for later in (False, True):
        df.where((F.col("s") >= 25_000) == later).write.mode("append").parquet(f"{tmp_path}/in")
        with turns.rocksdb(spark):
            done = streams.drain(turns.limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user", "id", "ts", 600, 5, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert {x["id"]: x["n_recent"] for x in done.collect()} == want
    assert all(x["limited"] == (x["n_recent"] > 5) for x in done.collect())


# Threads


def test_a_thread_goes_on_after_a_restart(spark, tmp_path):
    """Turns 1 and 2 before the stop, turn 3 after it; a thread that was idle for too long ends by its timer."""
    schema = "id long, thread long, ts timestamp, said string"

    def run(*rows):
        data = [(i, t, s, w) for i, t, s, w in rows]
        spark.createDataFrame(data, "id long, thread long, s long, said string").select("id", "thread", F.timestamp_seconds("s").alias("ts"), "said").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with turns.rocksdb(spark):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            return streams.drain(turns.follow_threads(stream, "thread", "id", "ts", "said", 100, "10 seconds", 2), f"{tmp_path}/out", f"{tmp_path}/ckpt")

    run((1, 7, 1000, "what is it?"), (2, 7, 1050, "and then?"), (3, 8, 1000, None), (4, None, 1000, "no thread"), (5, 9, None, "no time"))
    held = {(x.thread, x.id, x.said) for x in turns.open_threads(spark, f"{tmp_path}/ckpt").collect()}
    assert held == {(7, 1, "what is it?"), (7, 2, "and then?"), (8, 3, "")}
    done = run((6, 7, 1120, "so?"), (7, 7, 1130, "why?"), (8, 8, 1300, "again"), (9, 8, 1301, "more"))
    got = sorted((x.thread, x.id, x.kind, x.turn, x.previous) for x in done.collect())
    assert got == [
        (7, 1, "turn", 1, None),
        (7, 2, "turn", 2, "what is it?"),
        (7, 6, "turn", 3, "and then?"),
        (7, 7, "closed", 4, "why?"),
        (7, 7, "turn", 4, "so?"),
        (8, 3, "closed", 1, ""),
        (8, 3, "turn", 1, None),
        (8, 8, "turn", 1, None),
        (8, 9, "turn", 2, "again"),
    ]
    assert {(x.thread, x.id) for x in turns.open_threads(spark, f"{tmp_path}/ckpt").collect()} == {(8, 8), (8, 9)}


def test_an_open_thread_is_whole(spark, tmp_path):
    """Of a thread longer than what is remembered by default the state holds all turns, over a restart; one that ended leaves none."""
    rows = [(i, 1, 1000 + i) for i in range(70)] + [(100 + i, 2, 1000) for i in range(30)] + [(200 + i, 2, 1500 + i) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, thread long, s long").select("id", "thread", F.timestamp_seconds("s").alias("ts"), F.col("id").cast("string").alias("said"))
    for half in ("ts < timestamp_seconds(1040)", "ts >= timestamp_seconds(1040)"):
        df.where(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with turns.rocksdb(spark):
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            done = streams.drain(turns.follow_threads(stream, "thread", "id", "ts", "said", 450, "10 minutes", None), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    held = sorted((x.thread, x.id, x.said) for x in turns.open_threads(spark, f"{tmp_path}/ckpt").collect())
    assert held == [(1, i, str(i)) for i in range(70)] + [(2, 200 + i, str(200 + i)) for i in range(25)]
    got = {x.id: (x.turn, x.previous) for x in done.where("kind = 'turn'").collect()}
    assert got == {i: (i + 1, str(i - 1) if i else None) for i in range(70)} | {a + i: (i + 1, str(a + i - 1) if i else None) for a, n in ((100, 30), (200, 25)) for i in range(n)}


# Phrases


def test_phrases(spark):
    r = random.Random(6)
    docs = [(i % 90, " ".join(r.choice(["a", "B", "c", "d", "é"]) + r.choice(["", ",", "! "]) for _ in range(r.randrange(0, 60)))) for i in range(100)] + [(500, None), (None, "a b c")]
    table = [("A b", "x"), ("a b", "w"), ("b c d", "y"), ("c", "z"), ("d, d", "dd"), ("é a b c", "long"), (None, "n"), ("!", "none"), ("a a", None)]
    own = {"a b": "w", "b c d": "y", "c": "z", "d d": "dd", "é a b c": "long"}
    want = []
    for key, text in docs:
        words = re.findall(phrases.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = 0
        while at < len(words):
            size = max((k for k in range(1, 5) if " ".join(words[at : at + k]) in own and at + k <= len(words)), default=0)
            if size:
                p = " ".join(words[at : at + size])
                want.append((key, at, size, p, own[p]))
            at += size or 1
    given = spark.createDataFrame(docs, "doc long, body string").withColumn("term", F.lit("clash")).repartition(3)
    names = spark.createDataFrame(table, "phrase string, term string")
    got = [tuple(x) for x in phrases.tag_phrases(given, "doc", "body", names).collect()]
    assert Counter(got) == Counter(want)
    assert phrases.tag_phrases(given, "doc", "body", names.limit(0)).count() == 0
    assert phrases.tag_phrases(given.limit(0), "doc", "body", names).count() == 0


# Structure


LAW = """Preface
(1) whereas one
more of one
(2) whereas two
CHAPTER I General
Article 1
text of 1
(3) no recital here
Section 1
Article 2
Articles 3 to 4 apply
CHAPTER II Special
Words of II
Article 3
Section 2
Loose"""


def test_structure(spark):
    docs = spark.createDataFrame([(1, LAW), (2, None), (3, ""), (4, "Article 9\nx")], "doc long, text string")
    lines = structure.lines_of(docs, "doc", "text")
    for span in (3, 10_000):
        got = {(x["doc"], x["metadata"]["pos"]): (x["metadata"]["kind"], x["metadata"]["number"], tuple(x["metadata"]["path"]), x["chunk"]) for x in structure.heading_chunks(lines, "doc", "pos", "line", span=span).collect()}
        assert got == {
            (1, None): (None, None, (None, None, None, None), "Preface"),
            (1, 1): ("recital", "1", (None, None, None, "1"), "(1) whereas one\nmore of one"),
            (1, 3): ("recital", "2", (None, None, None, "2"), "(2) whereas two"),
            (1, 4): ("chapter", "I", ("I", None, None, None), "CHAPTER I General"),
            (1, 5): ("article", "1", ("I", None, "1", None), "Article 1\ntext of 1\n(3) no recital here"),
            (1, 8): ("section", "1", ("I", "1", None, None), "Section 1"),
            (1, 9): ("article", "2", ("I", "1", "2", None), "Article 2\nArticles 3 to 4 apply"),
            (1, 11): ("chapter", "II", ("II", None, None, None), "CHAPTER II Special\nWords of II"),
            (1, 13): ("article", "3", ("II", None, "3", None), "Article 3"),
            (1, 14): ("section", "2", ("II", "2", None, None), "Section 2\nLoose"),
            (3, None): (None, None, (None, None, None, None), ""),
            (4, 0): ("article", "9", (None, None, "9", None), "Article 9\nx"),
        }
    stated = spark.createDataFrame([(1, 3), (4, 2), (5, 1)], "doc long, stated long")
    chunks = structure.heading_chunks(lines, "doc", "pos", "line")
    assert sorted(map(tuple, structure.count_check(chunks, "doc", "article", stated).collect())) == [(1, 3, 3, True), (4, 2, 1, False), (5, 1, None, False)]


# Quarantine


def test_quarantine(spark, tmp_path):
    given = [(1, '{"k": 60, "s": "é"}'), (2, '{"k": 10}'), (3, '{"k": "x"}'), (4, '{"k": 60'), (5, None), (6, "{}"), (7, ""), (8, '{"k": 60, "other": 1}'), (9, "[1]")]
    rows = spark.createDataFrame(given, "id long, payload string")
    told = guards.checked(rows, "payload", "k long, s string", {"k is missing": lambda p: p["k"].isNotNull(), "k below 50": lambda p: p["k"] >= 50})
    assert {x["id"]: x["reason"] for x in told.collect()} == {1: None, 2: "k below 50", 3: "mistyped", 4: "malformed", 5: "absent", 6: "k is missing", 7: "malformed", 8: None, 9: "mistyped"}
    guards.quarantine(told, "payload", f"{tmp_path}/q")
    back = spark.read.parquet(f"{tmp_path}/q")
    refused = {x["id"]: x["payload"] for x in back.where("outcome = 'refused'").collect()}
    assert refused == {i: p for i, p in given if i not in (1, 8)}
    accepted = {x["id"]: (tuple(x["parsed"]), x["payload"]) for x in back.where("outcome = 'accepted'").collect()}
    assert accepted == {1: ((60, "é"), None), 8: ((60, None), None)}
