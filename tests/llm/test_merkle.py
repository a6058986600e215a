"""The Merkle manifest against one made by hand, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part string, pos long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=None):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], row[4] if text is None else text)))


def climb(level, i):
    """The siblings of node i on its way up, and what is left."""
    path = []
    while len(level) > 1:
        a = i // 3 * 3
        path.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        level, i = [digest("".join(level[k : k + 3])) for k in range(0, len(level), 3)], i // 3
    return path, level[0]


def by_hand(rows):
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb([leaf(r) for r in trees[s]], 0)[1] for s in order]
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            own, sub = climb([leaf(x) for x in trees[s]], i)
            above, root = climb(tops, j)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf(r, r[4].replace("\n", "") if changed else None)
            for a, b in own + above:
                h = digest(a + h + b)
            out.append((r[0], leaf(r), sub, root, digest("".join(a + b for a, b in own + above)), h, h == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 3], [28, 9, 1, 10]])
def test_shapes(spark, tmp_path, sizes):
    rows = [(100 * k + i, f"s{k}", "en", i, f"text {i}\nof {k}" if i % 3 else f"line {i}", "x", 1) for k, n in enumerate(sizes) for i in range(n)]
    assert run(spark, tmp_path, rows) == by_hand(rows)


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [
        (1, None, None, None, None, "a", 1),
        (None, "é", "de", 1, "a\nb", "a", 1),
        (None, "é", "de", 1, "a\nb", "a", 1),
        (2, "", "", 0, "", "a", 1),
        (2, "", "", 0, "other\n", "a", 1),
        (3, "z", "en", 5, "-", "a", 1),
        (4, "z", "en", 5, "\n" * 50_000 + "é" * 100_000, None, None),
        (-5, "Z", "en", 5, "1:2", "a", 1),
    ]
    assert run(spark, tmp_path, rows) == by_hand(rows)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_hot_nodes_are_shared_out(spark, monkeypatch):
    """Near the root, no key of the climb has more than SHARE leaves."""
    monkeypatch.setattr(merkle, "SHARE", 4)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    leaves = merkle.placed(docs.select(F.col("doc_id").alias("_key"), F.col("source").alias("_tree"), merkle.hashed(F.col("text")).alias("digest")), "_tree", ["_key"])
    nodes = leaves.select(F.col("pos").alias("key"), "start", F.col("pos").alias("i"), "size", F.lit(1).cast("long").alias("under"), "digest")
    links, left = merkle.build(nodes, 0)
    copies = [t.agg(F.max("copies")).first()[0] for t in links]
    assert copies == [1, 1, 3, 7, 21]  # nodes over 1, 3, 9, 27 and 81 leaves
    assert left[-1].count() == 1
    assert [(t.count(), t.agg(F.max(F.size("steps"))).first()[0]) for t in merkle.strides(links)] == [(100, 3), (4, 2)]
    done = merkle.manifest(docs, change={"text": F.when(F.col("doc_id") == 7, F.lit("x")).otherwise(F.col("text"))})
    assert done.where("folded_root = root").count() == 99 and done.where("folded_root <> root").first()["doc_id"] == 7
