"""Search, joins, classifiers, scores and the pipeline: against brute force, held-out labels and the hard cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import ctw, lshjoin, quality, substring, topk, toxicity
from quern.llm._graph import components
from quern.llm._labels import labelled_sample
from quern.llm._spark import crc32_mod
from quern.llm._text import text_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(n)]


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-3, 4, 4).tolist()) for i in range(150)] + [(7, [1, 1, 1, 1]), (None, [1, 1, 1, 1]), (900, None), (950, [2, 2]), (951, [1, 5]), (952, [3, 1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<int>")
    got = sorted(tuple(x) for x in topk.exact_top_k(df, "vec_id", "vector", F.col("vec_id") % 50 == 0, 5, pivots=6).collect())
    want = []
    for q, v in rows:
        if q is None or v is None or q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and w is not None and i != q and len(w) == len(v))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert got == sorted(want)
    assert topk.exact_top_k(df.where("false"), "vec_id", "vector", F.lit(True)).count() == 0
    odd = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([None],)], "e array<float>")
    assert [x[0] for x in odd.select(topk.quantised(F.col("e"))).collect()] == [[128, -1], None, None, None, None, None]


def test_top_k_stops_early():
    """In the order of bounds, clustered vectors cost a small share of the candidates, and the result is that of all of them."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 48))
    v = centres[rng.integers(0, 200, 8000)] / np.sqrt((centres**2).sum(1).mean()) + 0.02 * rng.normal(size=(8000, 48))
    v = np.floor(256 * v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.int64)
    ids, asked = np.arange(len(v)), np.arange(0, 8000, 50)
    table = topk.distances(v.astype(float), topk.choose_pivots(v[rng.permutation(8000)[:1024]].astype(float), topk.PIVOTS))
    scored: list[int] = []
    q, found, score = topk.search_cell(asked, v[asked], table[asked], ids, v, table, 5, scored)
    assert sum(scored) <= 0.15 * len(asked) * len(v)
    for i in asked:
        all_scores = v @ v[i]
        want = sorted((-int(s), j) for j, s in enumerate(all_scores) if j != i)[:5]
        assert [(-int(s), int(j)) for j, s in zip(found[q == i], score[q == i], strict=True)] == want


def test_a_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("text").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 100).count() == 2
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 5000).count() == 2000


def test_top_k_of_wide_components(spark):
    """Scores beyond 2**53 are exact, one beyond 64 bits fails, and 1e7 is a component like any other."""
    r = np.random.default_rng(7)
    rows = [(i, [int(x) for x in r.integers(-(1 << 31), 1 << 31, 3)]) for i in range(60)] + [(60, [1 << 31, 1, 0]), (61, [1 << 31, 2, 0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), "vec_id", "vector", F.col("vec_id") % 30 == 0).collect()
    for q in (0, 30, 60):
        want = sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q)[:5]
        assert sorted((-x["score"], x["vec_id"]) for x in got if x["query_id"] == q) == want
    of = lambda *x: spark.createDataFrame([(list(x),)], "e array<double>").select(topk.quantised(F.col("e"))).first()[0]
    assert of(1e7, -1e7) == [2_560_000_000, -2_560_000_000]
    with pytest.raises(Exception, match="64 bits"):
        of(1.0, 1e30)
    huge = spark.createDataFrame([(0, [1 << 62, 4]), (1, [1 << 62, 4])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(huge, "vec_id", "vector", F.lit(True)).collect()


def test_pivots_prune():
    """Clustered vectors: the result is that of a full scan."""
    r = np.random.default_rng(1)
    centers = r.integers(-200, 200, (8, 16))
    v = np.concatenate([c + r.integers(-5, 6, (500, 16)) for c in centers]).astype(np.float64)
    ids = np.arange(len(v))
    pivots = topk.choose_pivots(v, 16)
    table = topk.distances(v, pivots)
    q, _, s = topk.search_cell(ids[:4], v[:4].astype(np.int64), table[:4], ids, v.astype(np.int64), table, 5)
    for i in range(4):
        full = sorted(((-int(v[i] @ v[j]), j) for j in ids if j != i))[:5]
        assert [-a for a, _ in full] == [x for x, y in zip(s, q, strict=True) if y == i]


def brute_links(docs, threshold=0.8):
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and i is not None else frozenset()))
    links, edges = collections.Counter(), []
    for (a, (i, s)), (b, (j, u)) in itertools.combinations(enumerate(sets), 2):
        if s and u and len(s & u) >= threshold * len(s | u) - 1e-9:
            links[a] += 1
            links[b] += 1
            edges.append((i, j))
    roots = roots_of({i for i, _ in docs if i is not None}, edges)
    return sorted((i if i is not None else -1, roots.get(i, -1), links[n]) for n, (i, _) in enumerate(sets))


def near_corpus():
    r = random.Random(3)
    docs = [(i, " ".join(prose(i, r.randrange(1, 120)))) for i in range(40)]
    base = prose(999, 100)
    for k in range(45):  # a hot group of near copies, many blocks when blocks are small
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, "  ".join(prose(5, 80)).upper()) for k in range(6)]  # exact copies but for case and blanks
    docs += [(300, None), (301, ""), (302, "?!"), (303, "two words"), (304, "Two, words"), (None, docs[0][1]), (0, docs[0][1]), (305, "long " * 30_000)]
    return docs


@pytest.mark.parametrize("members", [8, lshjoin.BLOCK_MEMBERS])
def test_near_duplicates(spark, monkeypatch, members):
    monkeypatch.setattr(lshjoin, "BLOCK_MEMBERS", members)
    docs = near_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["class_id"] if x["class_id"] is not None else -1, x["n_links"]) for x in lshjoin.near_duplicates(df).collect())
    assert got == brute_links(docs)


def test_near_duplicates_empty(spark):
    assert lshjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lshjoin.shortest_prefix(0.8, 16, 8, 0.9995) == 4 and lshjoin.shortest_prefix(0.8, 16, 8, 0.95) > 4 and lshjoin.shortest_prefix(0.8, 1, 8, 0.999) == 1


def test_signatures_are_sorted_tries():
    """Prefixes of packed signatures are equal just where their values are, and shrink runs never."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    packed = lshjoin.signatures(np.concatenate(sets), starts, 3)
    values = np.stack([(packed[:, :, k // 4] >> np.uint64(48 - 16 * (k % 4))) & np.uint64(65535) for k in range(8)], -1)
    for tree, length in itertools.product(range(3), range(1, 9)):
        want = (values[:, None, tree, :length] == values[None, :, tree, :length]).all(-1)
        assert (lshjoin.shared_prefix(packed, tree, length) == want).all()
        assert (np.lexsort((packed[:, tree, 1], packed[:, tree, 0])) == np.lexsort(values[:, tree, ::-1].T)).all()


def test_forest_descends_as_far_as_the_data_ask(spark, monkeypatch):
    """Where links are copies but for a word in thousands, long prefixes find all; links near the threshold need shorter ones."""
    levels = []
    own = lshjoin._level
    monkeypatch.setattr(lshjoin, "_level", lambda *a: (levels.append(a[3]), own(*a))[1])
    base = prose(1, 4000)
    alike = [(i, " ".join([*base[: 100 * i], "changed", *base[100 * i + 1 :]])) for i in range(1, 7)]
    assert {r["n_links"] for r in lshjoin.near_duplicates(spark.createDataFrame(alike, "doc_id long, text string")).collect()} == {5} and levels == [8]
    levels.clear()
    apart = [x for k in range(30) for x in ((k, " ".join(prose(k, 54))), (100 + k, " ".join([*prose(k, 54), *prose(500 + k, 12)])))]
    assert {r["n_links"] for r in lshjoin.near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect()} == {1}
    assert levels[0] == 8 and levels[-1] == 4 and len(levels) < 4


def test_one_of_each_keeps_texts_under_one_id(spark):
    """Two texts under one id, a copy under another, repeated rows, null ids and empty texts: no text is lost."""
    one, two = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [(5, one, 1), (5, two, 2), (5, two, 2), (7, one, 3), (8, two.upper(), 4), (9, None, 5), (9, "", 6), (10, "?", 7), (None, one, 8), (None, one, 8)]
    kept = lshjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n"]) for r in kept) == sorted([(5, one, 1), (5, two, 2), (9, "", 5), (9, "", 6), (10, "?", 7), (0, one, 8), (0, one, 8)])


def test_overlaps():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    own = np.triu(np.ones((30, 30), bool), 1)
    got = lshjoin.overlaps(sets, own)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(30), 2))
    few = own & (np.arange(30)[:, None] == 3)
    assert (lshjoin.overlaps(sets, few)[3, 4:] == got[3, 4:]).all()


def test_compact_windows():
    r = np.random.default_rng(4)
    for least in (1, 2, 3, 7, 16):
        sizes = r.integers(0, 60, 12)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values = r.integers(1, 30, starts[-1]).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in substring.compact_windows(values, starts, least)), strict=True))
        want = set()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            for p in range(a, b):
                lo, hi = p, p
                while lo > a and values[lo - 1] > values[p]:
                    lo -= 1
                while hi < b - 1 and values[hi + 1] >= values[p]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((p, lo, hi))
        assert got == want


def passage_corpus():
    shared, near, other = prose(50, 60), prose(51, 90), prose(52, 55)
    changed = list(near)
    changed[45] = "changed"
    docs = [(1, prose(1, 30) + shared + prose(2, 20)), (2, shared + prose(3, 200)), (3, prose(4, 100) + shared), (4, prose(5, 40) + near + prose(6, 10)), (5, changed), (6, prose(7, 300)), (7, prose(8, 20) + other[:49] + prose(9, 20)), (8, other[:49] + prose(10, 100)), (10, prose(20, 300)), (11, prose(20, 300))]
    rows = [(i, " ".join(w)) for i, w in docs]
    return rows + [(12, None), (13, ""), (14, "a b"), (None, rows[0][1]), (3, rows[2][1])]


def test_passages(spark):
    df = spark.createDataFrame(passage_corpus(), "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = substring.passages(df.select("doc_id", "text"))
    got = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"], r["keep"], r["n_docs"]) for r in found.collect()}
    assert got == {(1, 30, 90, 1, True, 3), (2, 0, 60, 1, False, 3), (3, 100, 160, 1, False, 3), (4, 40, 130, 4, True, 2), (5, 0, 90, 4, False, 2), (10, 0, 300, 10, True, 2), (11, 0, 300, 10, False, 2)}
    kept = {r["doc_id"]: r for r in substring.without_repeats(df, found).where("doc_id IS NOT NULL").collect()}
    assert set(kept) == {1, 2, 3, 4, 6, 7, 8, 10, 12, 13, 14}  # 5 and 11 have nothing left
    text = dict(passage_corpus()[:10])
    assert kept[2]["text"].split() == text[2].split()[60:] and kept[3]["text"].split() == text[3].split()[:100] and kept[1]["text"] == text[1]
    assert kept[2]["n_chars"] == len(kept[2]["text"]) and kept[12]["text"] is None
    assert substring.passages(df.where("false").select("doc_id", "text")).count() == 0


def test_passages_hot(spark):
    """A passage that all documents hold: rows grow with the documents."""
    shared = " ".join(prose(60, 70))
    rows = [(i, " ".join(prose(1000 + i, 30)) + " " + shared + " " + " ".join(prose(2000 + i, 30))) for i in range(80)]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == 80 and {r["first_doc_id"] for r in got} == {0} and sum(r["keep"] for r in got) == 1 and {r["n_docs"] for r in got} == {80}


def test_passages_chain(spark):
    """Two documents quote overlapping parts of a text that a third holds whole: only the third is cut, and no word is lost."""
    article = [f"w{i}" for i in range(120)]
    docs = {1: prose(70, 20) + article[:60] + prose(71, 20), 2: article[50:] + prose(72, 20), 3: prose(73, 30) + article + prose(74, 10)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = substring.passages(df)
    assert {(r["doc_id"], r["start"], r["end"], r["first_doc_id"], r["first_start"], r["keep"], r["n_docs"]) for r in found.collect()} == {(1, 20, 80, 1, 20, True, 3), (2, 0, 70, 1, 20, True, 3), (3, 30, 150, 1, 20, False, 3)}
    left = {r["doc_id"]: r["text"].split() for r in substring.without_repeats(df, found).collect()}
    assert left[1] == docs[1] and left[2] == docs[2] and left[3] == docs[3][:30] + docs[3][150:]
    assert [sum(w in x for x in left.values()) for w in article] == [1] * 50 + [2] * 10 + [1] * 60  # ten shared words are no passage


@pytest.mark.parametrize("parts", [1, 5])
def test_passages_round_a_line(spark, parts):
    """Pairs that share a passage round a line that earlier documents hold in other surroundings."""
    line = prose(80, 38)
    rows = [(i, prose(3000 + i, 60) + line + prose(3100 + i, 60)) for i in range(6)]
    for k in range(12):
        passage = prose(3200 + k, 12) + line + prose(3300 + k, 12)
        rows += [(10 + k, prose(3400 + k, 30) + passage + prose(3500 + k, 30)), (30 + k, prose(3600 + k, 40) + passage + prose(3700 + k, 20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(parts)
    got = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"], r["keep"]) for r in substring.passages(df).collect()}
    assert got == {x for k in range(12) for x in ((10 + k, 30, 92, 10 + k, True), (30 + k, 40, 102, 10 + k, False))}


@pytest.mark.parametrize("parts", [1, 3])
def test_passages_that_an_earlier_document_holds_in_part(spark, parts):
    """Pairs that share a passage of 56 words, of which an earlier document holds just the middle 44: no link is lost."""
    rows = []
    for k in range(40):
        passage = prose(4000 + k, 56)
        rows += [(k, prose(4100 + k, 40) + passage[6:50] + prose(4200 + k, 40)), (100 + k, prose(4300 + k, 30) + passage + prose(4400 + k, 30)), (200 + k, prose(4500 + k, 50) + passage + prose(4600 + k, 10))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(parts)
    got = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"], r["keep"]) for r in substring.passages(df).collect()}
    assert got == {x for k in range(40) for x in ((100 + k, 30, 86, 100 + k, True), (200 + k, 50, 106, 100 + k, False))}


def exact_repeats(docs, size):
    """Brute force: for each document, the words that lie in a run of so many that an earlier document holds."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        w = words(t)
        runs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        out[i] = {p for k, r in enumerate(runs) if seen.get(r, i) != i for p in range(k, k + size)}
        for r in runs:
            seen.setdefault(r, i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(spark, seed):
    """A corpus of stretches that documents share in many overlapping ways: every word in an exact repeat is cut, and nothing that is in none (no near repeats here)."""
    r = random.Random(seed)
    stock = [prose(5000 + 50 * seed + k, r.randrange(20, 120)) for k in range(12)]
    docs = []
    for i in range(90):
        w = []
        for _ in range(r.randrange(1, 6)):
            piece = r.choice(stock)
            a = r.randrange(max(1, len(piece) - 30))
            w += piece[a : a + r.randrange(20, 110)] if r.random() < 0.7 else prose(r.randrange(10**6), r.randrange(5, 60))
        docs.append((i, " ".join(w)))
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    got = {i: {p for x in found if x["doc_id"] == i and not x["keep"] for p in range(x["start"], x["end"])} for i, _ in docs}
    want = exact_repeats(docs, 50)
    assert sum(map(len, want.values())) > 2000
    assert all(want[i] <= got[i] for i, _ in docs)
    # what else is cut joins exact parts to a passage of 0.8 similarity: nearly all of it stands in earlier documents, five words at a time
    seen, new, cut = set(), 0, 0
    for i, t in docs:
        w = words(t)
        fives = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        held = {p for k, x in enumerate(fives) if x in seen for p in range(k, k + 5)}
        new, cut = new + len(got[i] - held), cut + len(got[i])
        seen |= set(fives)
    assert new <= 0.1 * cut


def test_recall_of_near_repeats(spark):
    """Planted near repeats of four kinds, sixty pairs each: at least nine in ten are found."""
    kinds = {"90 words, one changed": (90, 1), "60 words, one changed": (60, 1), "120 words, two changed": (120, 2), "200 words, four changed": (200, 4)}
    docs, later = [], {}
    for k, (size, changes) in enumerate(kinds.values()):
        for i in range(60):
            key = 1000 * k + 2 * i
            passage = prose(10_000 + key, size)
            other = list(passage)
            for c in range(changes):
                other[(c + 1) * size // (changes + 1)] = f"changed{key}x{c}"
            docs += [(key, prose(20_000 + key, 60) + passage + prose(30_000 + key, 40)), (key + 1, prose(40_000 + key, 30) + other + prose(50_000 + key, 70))]
            later[key + 1] = (30, 30 + size)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["start"], r["end"]) for r in substring.passages(df).where("NOT keep").collect()}
    for k, name in enumerate(kinds):
        caught = [key for key, (a, b) in later.items() if key // 1000 == k and key in found and min(b, found[key][1]) - max(a, found[key][0]) >= 0.9 * (b - a)]
        assert len(caught) >= 54, (name, len(caught))


def test_passages_of_texts_under_one_id(spark):
    """Two texts under one id are two documents: each is cut where it repeats an earlier text, and only there."""
    shared = prose(61, 60)
    rows = [(1, prose(1, 30) + shared), (5, prose(2, 80) + shared), (5, prose(3, 200)), (5, prose(2, 80) + shared), (6, prose(4, 10) + shared + prose(5, 10))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = substring.passages(df)
    assert {(r["doc_id"], r["start"], r["end"], r["first_doc_id"], r["keep"], r["n_docs"]) for r in found.collect()} == {(1, 30, 90, 1, True, 3), (5, 80, 140, 1, False, 3), (6, 10, 70, 1, False, 3)}
    left = sorted((r["doc_id"], tuple(r["text"].split())) for r in substring.without_repeats(df, found).collect())
    assert left == sorted([(1, tuple(rows[0][1])), (5, tuple(prose(2, 80))), (5, tuple(prose(3, 200))), (5, tuple(prose(2, 80))), (6, tuple(prose(4, 10) + prose(5, 10)))])


def test_run_hashes():
    """Equal just where the tokens are, for runs of any size; Thue-Morse sequences do not collide."""
    a, b = np.array([1], np.uint64), np.array([2], np.uint64)
    for _ in range(11):
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    assert substring.doubled(a, 2048)[-1][0] != substring.doubled(b, 2048)[-1][0]
    r = np.random.default_rng(3)
    x = r.integers(0, 2, 300).astype(np.uint64)
    runs = substring.doubled(x, 92)
    first, size = np.repeat(np.arange(200), 92), np.tile(np.arange(1, 93), 200)
    got = substring.run_hash(runs, first, first + size - 1).tolist()
    want = [tuple(x[a : a + n].tolist()) for a, n in zip(first, size, strict=True)]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_ties_by_doc(spark):
    """Overlapping exact ties are runs, near ties in a run go, the others are stretches if of two functions."""
    rows = [(9, 1, 0, 45, 5, -1), (9, 1, 10, 60, 5, -2), (9, 1, 62, 110, 5, -1), (9, 1, 0, 45, 7, -1), (9, 2, 20, 60, 0, 0), (9, 2, 20, 60, 0, 1), (9, 2, 40, 130, 3, 2), (9, 2, 135, 180, 9, 0), (9, 2, 300, 350, 9, 0), (8, 2, 40, 130, 3, 1), (8, 2, 40, 130, 3, 3)]
    got = substring.ties_by_doc(spark.createDataFrame(rows, "doc long, lead long, s int, e int, k int, h int"), 2).collect()
    assert sorted((r["doc"], r["lead"], r["s"], r["e"], r["k0"], r["k1"], r["exact"]) for r in got) == [(8, 2, 40, 130, 3, 3, False), (9, 1, 0, 45, 7, 7, True), (9, 1, 0, 60, 5, 5, True), (9, 1, 62, 110, 5, 5, True), (9, 2, 40, 180, 3, 9, False)]


def test_matching_passages():
    """A near copy with changed tokens; two side by side that differ too much as one; a text of one token."""
    r = np.random.default_rng(6)
    fresh = lambda n: r.integers(0, 1 << 62, n).astype(np.uint64)
    one, two = fresh(86), fresh(86)
    near = lambda t: np.concatenate([t[:40], fresh(5), t[45:]])
    a = np.concatenate([fresh(30), near(one), fresh(30)])
    (found,) = substring.matching_passages(a, np.concatenate([fresh(10), one, fresh(50)]), 40, 100, 46)
    assert found[:4] == (30, 115, 10, 95) and found[4] == pytest.approx(81 / 91)
    a = np.concatenate([fresh(30), one, two[:50], fresh(30)])
    b = np.concatenate([one, fresh(60), two])
    assert [x[:4] for x in substring.matching_passages(a, b, 40, 150, 46)] == [(30, 115, 0, 85), (116, 165, 146, 195)]
    same = np.zeros(3000, np.uint64)
    assert substring.matching_passages(same, np.concatenate([same[:50], fresh(50)]), 0, 2999, 46)
    assert substring.matching_passages(same[:0], same, 0, 0, 46) == [] == substring.matching_passages(fresh(90), fresh(90), 0, 89, 46)


def held_out(spark, scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    rank = rows["score"].rank().to_numpy()
    y = rows["y"].to_numpy()
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)), (rows["predicted"] == y).mean()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op4_quality(spark, sf).cache()
    area, right = held_out(spark, scored, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert area > 0.95 and right > 0.93
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == 1000


def test_quality_by_hand(spark):
    """Scores against a look-up entry by entry, one text at a time."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels, F.lit(True))
    for r in quality.score_quality(docs, model).collect():
        x = quality.text_features(*text_bytes(pa.array([r["text"]])))[0]
        total = model.intercept
        for f, table in enumerate(model.tables):
            total += table[sum(edge < x[f] for edge in model.edges[f])]
        for a, b, table in model.pairs:
            total += table[sum(edge < x[a] for edge in model.coarse[a])][sum(edge < x[b] for edge in model.coarse[b])]
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-12


def test_trees_by_hand():
    """The best cut of ordered bins, and of pairs of bins, against all cuts."""
    r = np.random.default_rng(5)
    for _ in range(50):
        g, h = r.normal(size=7), r.random(7) + 0.1
        value = lambda g, h: g.sum() ** 2 / (h.sum() + quality.SMOOTH)
        gains = [value(g[:c], h[:c]) + value(g[c:], h[c:]) - value(g, h) for c in range(1, 7)]
        gain, cut = quality._split(g, h)
        assert (cut == 0 and max(gains) <= 1e-9) or (abs(gain - max(gains)) < 1e-9 and abs(gains[cut - 1] - gain) < 1e-9)
        own = quality._tree(g, h, 1)
        parts = [slice(0, 7)] if not cut else [slice(0, cut), slice(cut, 7)]
        for p in parts:
            assert np.allclose(own[p], g[p].sum() / (h[p].sum() + quality.SMOOTH))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "x " * 50_000, "s"), (3, "y", "s"), (None, "é", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none, F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, model).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.fit_quality(docs, odd, F.lit(True))).count() == 5
    assert quality.score_quality(docs.where("false"), model).count() == 0
    r = np.random.default_rng(5)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    fitted = quality.fit_additive(x, y)
    assert ((fitted.score(x) > 0.5) == y).mean() > 0.9


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    scored = toxicity.op7_toxicity(spark, sf).cache()
    area, right = held_out(spark, scored, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert area > 0.8 and right > 0.9
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == 1000


def test_toxicity_by_hand(spark):
    """Scores against a sum over the distinct words and prefixes of each text, looked up one by one."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    weight = dict(zip(model.keys.keys.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score_toxicity(docs, model).collect():
        keys = {k for w in set(words(r["text"])) for k in toxicity.keys_of(*text_bytes(pa.array([w])))[0].tolist()}
        total = model.bias + sum(weight.get(k, 0.0) for k in keys)
        assert abs(r["score"] - 1 / (1 + math.exp(-min(max(total, -30), 30)))) < 1e-9


def test_toxicity_fit_by_hand():
    """One step of the fit against the loss and its penalty, differentiated by hand."""
    rows = pa.table({"y": pa.array([1, 0, 1], pa.int32()), "own": pa.array([[0, 1], [1], [0, 2]], pa.list_(pa.int32())), "swap": pa.array([None, [2], None], pa.list_(pa.int32()))})
    keys = toxicity.Keys(np.array([3, 5, 9], np.uint64))

    def loss(w, bias):
        own, y = [[0, 1], [1], [0, 2]], [1, 0, 1]
        z = [sum(w[i] for i in o) + bias for o in own]
        out = sum(math.log(1 + math.exp(-a)) if b else math.log(1 + math.exp(a)) for a, b in zip(z, y, strict=True)) / 3
        return out + toxicity.RIDGE / 2 * sum(x * x for x in w) + toxicity.SWAP_PENALTY * (w[1] - w[2]) ** 2

    fitted = toxicity.fit_linear(rows, keys)
    at = loss(fitted.weights, fitted.bias)
    r = random.Random(1)
    for _ in range(200):
        near = fitted.weights + np.array([r.gauss(0, 0.3) for _ in range(3)])
        assert loss(near, fitted.bias + r.gauss(0, 0.3)) >= at - 2e-2


def test_toxicity_swaps(spark, monkeypatch):
    """An identity term that goes with the label in the sample by chance: the penalty keeps it from moving scores."""
    assert toxicity.swapped("Muslim women met, mentioned") != "Muslim women met, mentioned" and toxicity.swapped("menu of womenfolk") == "menu of womenfolk"
    rows = [(f"those muslim people are vile{i % 3}", 1) for i in range(40)] + [(f"the christian people met {i % 3}", 0) for i in range(40)] + [("muslim neighbours met", 0)] * 2
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    probe = text_bytes(pa.array(["muslim women met", "christian women met", "those people are vile1", ""]))

    def scores(penalty):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        return toxicity.fit_toxicity(docs, labels, F.lit(True)).score(*probe)

    with_penalty, without = scores(1.0), scores(0.0)
    gap = lambda s: abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))
    assert gap(with_penalty) < 0.5 < 2 < gap(without)
    assert with_penalty[2] > 0.7 and with_penalty[0] < 0.5 and 0 <= with_penalty[3] < 0.5


def neutral_mentions(spark, monkeypatch, penalty):
    """The share of neutral sentences called toxic, over every identity term, by a model whose sample names some groups in insults alone; and the share of insults caught."""
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
    r = random.Random(11)
    filler = lambda n: " ".join(prose(r.randrange(10**6), n))
    rows = []
    for terms in toxicity.IDENTITY_TERMS:
        half = len(terms) // 2
        for i in range(40):
            rows.append((f"{filler(4)} {terms[i % half]} {('vile', 'worthless', 'disgusting')[i % 3]} {filler(4)}", 1))
            rows.append((f"{filler(4)} {terms[half + i % (len(terms) - half)]} {('met', 'works', 'reads')[i % 3]} {filler(4)}", 0))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    neutral = [f"{filler(6)} {t} {w} {filler(3)}" for terms in toxicity.IDENTITY_TERMS for t in terms for w in ("met", "today")]
    insults = [f"{filler(4)} {t} {w} {filler(4)}" for terms in toxicity.IDENTITY_TERMS for t in terms for w in ("vile", "worthless")]
    called = lambda texts: float((model.score(*text_bytes(pa.array(texts))) >= toxicity.REJECT).mean())
    return called(neutral), called(insults)


def test_toxicity_of_neutral_mentions(spark, monkeypatch):
    """Planted mentions over all terms of four languages: the penalty cuts false positives and still catches insults."""
    without, _ = neutral_mentions(spark, monkeypatch, 0.0)
    with_penalty, caught = neutral_mentions(spark, monkeypatch, 1.0)
    print(f"neutral mentions called toxic: {without:.3f} without the penalty, {with_penalty:.3f} with it; insults caught {caught:.3f}")
    assert with_penalty < 0.02 and without > 5 * with_penalty + 0.1 and caught > 0.9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 50_000, 1), (3, "y", 1), (None, "é", 1)], "doc_id long, text string, score int")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


def brute_ctw(train, depth):
    """A function that gives log10 of a text's probability, from sums over explicit trees."""
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(text):
        data = bytes([ctw.END] * depth) + text.encode().translate(bytes(ctw._LOW)) + bytes([ctw.END])
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i], (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1

    for t in train:
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight, stop = {}, {}
    for d in range(depth, -1, -1):
        for key in [k for k in counts if len(k[0]) == d]:
            own = kt(*counts[key])
            if d == depth:
                weight[key], stop[key] = own, 1.0
                continue
            below = sum(weight.get((bytes([x]) + key[0], key[1]), 0.0) for x in range(256))
            weight[key] = np.logaddexp(own, below) - math.log(2)
            stop[key] = math.exp(own - math.log(2) - weight[key])

    def score(text):
        total = 0.0
        for context, node, bit in decisions(text):
            mixed, left, p = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (context[depth - d :], node)
                if key not in counts:
                    break
                a, b = counts[key]
                guess = (b + 0.5) / (a + b + 1)
                p = mixed + left * guess
                mixed, left = mixed + left * stop[key] * guess, left * (1 - stop[key])
            total += math.log10(p if bit else 1 - p)
        return total

    return score


@pytest.mark.parametrize(("depth", "size", "fan"), [(2, ctw.CHUNK_BYTES, ctw.FAN), (5, 60, 2), (3, 1, 1)])
def test_ctw(spark, monkeypatch, depth, size, fan):
    """Against sums over explicit trees, whatever the size of chunks and the number of tasks that a frequent context is dealt to."""
    monkeypatch.setattr(ctw, "CHUNK_BYTES", size)
    monkeypatch.setattr(ctw, "FAN", fan)
    monkeypatch.setattr("quern.llm._text.STEP_BYTES", 64)
    texts = ["the cat sat on the mat", "The Cat sat", "a dog\x00 sat\ton \n the é", "", None, "zzz qqq the", "the cat sat on the mat", "x" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [t or "" for i, t in enumerate(texts) if i not in (2, 5)]
    score = brute_ctw(train, depth)
    tokens = lambda t: re.findall(r"[^ \t-\r]+", t.translate({c: c + 32 for c in range(65, 91)})) + [None]
    c = collections.Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    got = ctw.score_texts(docs, ~F.col("doc_id").isin(2, 5), depth).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["score"] == pytest.approx(score(t), abs=1e-6)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), abs=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n)


def test_ctw_words_of_a_pattern(spark):
    """Two words of 1,024 letters that a sum of powers would confuse are two words."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, f"{a} {a} {b}"), (2, b), (3, f"{a}b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score_texts(docs, F.col("doc_id") == 1).collect()}
    n, v = 4, 3
    assert got[2]["base_score"] == pytest.approx(math.log10(2 / (n + v + 1)) + math.log10(2 / (n + v + 1)))
    assert got[1]["n_known"] == 4 and got[3]["n_known"] == 1


def test_ctw_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ctw.score_texts(docs, F.lit(False)).first()
    assert r["score"] == pytest.approx(24 * math.log10(0.5)) and r["base_score"] == 0 and r["n_known"] == 0
    assert ctw.score_texts(docs.where("false"), F.lit(True)).count() == 0


def test_crc(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 12345, None)], "doc_id long").select("doc_id", crc32_mod(F.col("doc_id"), 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 7 for r in rows)


def test_pipeline(spark, tmp_path):
    """Each stage's decisions on a corpus of planted cases, with extra columns of clashing names."""
    vile = [(i, f"you are a vile{i % 2} person {' '.join(prose(i, 12))}") for i in range(0, 40)]
    fine = [(i, " ".join(prose(i, 40))) for i in range(40, 90)]
    shared, item = " ".join(prose(777, 60)), " ".join(prose(778, 15))
    planted = [
        (100, " ".join(prose(100, 50))), (101, " ".join(prose(100, 50))), (102, " ".join([*prose(100, 50), "more"])),
        (110, shared + " " + " ".join(prose(110, 200))), (111, " ".join(prose(111, 200)) + " " + shared),
        (140, " ".join(prose(140, 50))), (140, " ".join(prose(141, 50))), (140, " ".join(prose(141, 30)) + " " + shared),
        (120, " ".join(prose(120, 20)) + " " + item.upper() + " end"), (130, None), (131, ""), (132, "<|endoftext|> é"), (None, "no id"),
    ]
    rows = vile + fine + planted
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_hit int, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i, _ in vile + fine], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows_left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in rows_left}
    assert set(got) == {i for i, _ in fine} | {100, 110, 111, 130, 131, 132, 140, None} and len(rows_left) == len(got) + 2  # three texts under one id
    assert [len(n) > 0 and callable(f) for n, f in corpus_pipeline.STAGES] == [True] * 5
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(rows)
    for i in (100, 110, 130, 132, 50):
        assert got[i]["ids"] == library.encode(text[i] or "", add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["ids"])
    assert library.decode(got[111]["ids"]).split() == text[111].split()[:200]
    assert sorted(len(library.decode(r["ids"]).split()) for r in rows_left if r["doc_id"] == 140) == [30, 50, 50]
