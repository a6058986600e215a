"""The divergence audit against plain counting, and its edge cases."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quern.llm import divergence
from quern.llm.divergence import op11_divergence

UNIT = 1_000_000_000
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string"


def plain(rows, least=3, ranks=200):
    groups, langs, docs = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault((lang, source), Counter()).update(words)
        langs.setdefault(lang, Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    p = lambda own, total, v, t: 1 + UNIT * (own[t] + 1) // (total + v)
    f = lambda a, b: (a - b) ** 2 // b
    for (lang, source), own in groups.items():
        terms = [t for t, n in docs[lang].items() if n >= least]
        size = lambda c: sum(c[t] for t in terms)  # noqa: E731, B023
        ps = {s: {t: p(c, size(c), len(terms), t) for t in terms} for (x, s), c in groups.items() if x == lang}
        q = {t: p(langs[lang], size(langs[lang]), len(terms), t) for t in terms}
        pairs = [(s, sum(f(ps[source][t], ps[s][t]) for t in terms)) for s in ps if s != source]
        found = [(t, f(ps[source][t], q[t])) for t in terms if own[t] and ps[source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(tuple(r) for r in op11_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect())


def test_random(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha", "Beta", "g", "É", "é", "日本", "tail", "x1y", "o'clock"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(300):
        lang, source = r.choice(["en", "en", "de"]), f"s{min(r.randrange(12), r.randrange(12))}"
        own = words[: 5 + 3 * int(source[1:])]
        rows.append((i, " ".join(r.choice(own) for _ in range(r.randrange(1, 40))), lang, source, "clash", "clash"))
    assert run(spark, tmp_path, rows) == plain(rows)


def test_ties_nulls_and_groups_without_terms(spark, tmp_path):
    many = " ".join("t" + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(400))
    rows = [(i, many, "en", "same", None, None) for i in range(3)]  # 400 terms of one cell, of which 200 are named
    rows += [(9, "other other", "en", "b", None, None), (9, "other", "en", "b", None, None), (9, "other", "en", "b", None, None)]
    rows += [(1, None, "en", "empty", None, None), (2, "1 2 3 !", "en", None, None, None)]
    rows += [(3, "one two", None, "a", None, None), (3, "one", None, "c", None, None), (None, "", "fr", "alone", None, None)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows)
    assert [r for r in got if r[0] == ""] == [("", "a", "pair", "c", 0, 1), ("", "c", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "fr"]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_bounds(spark, tmp_path, monkeypatch):
    """What tasks hold is bounded, and the results stay."""
    for name, value in {"HELD": 5, "SLICE": 8, "PAIRS": 3, "AT_ONCE": 4, "PARTNERS": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)), "en", f"s{i % 7}", "x", "y") for i in range(60)]
    texts = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "source": [x[3] for x in rows], "text": [x[1] for x in rows]})
    parts = list(divergence._counted(iter([texts])))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= 12
    total = Counter()
    for p in parts:
        for x in p.to_pylist():
            total[x["term"]] += x["n"]
    assert total == Counter(w for x in rows for w in x[1].split())
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_pairs_in_pieces(monkeypatch, most):
    monkeypatch.setattr(divergence, "PAIRS", most)
    monkeypatch.setattr(divergence, "AT_ONCE", 2)
    lists = [[{"g": g, "p": 10 * g + t, "none": 3} for g in range(2, 2 + t)] for t in range(2, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int64()), ("none", pa.int64())])))], ["groups"])
    got, want = Counter(), Counter()
    for b in divergence._together(iter([batch, batch])):
        for x in b.to_pylist():
            got[x["a"], x["b"]] += x["value"]
    f = lambda a, b: (a - b) ** 2 // b
    for row in lists * 2:
        for a in row:
            for b in row:
                if a is not b:
                    want[a["g"], b["g"]] += f(a["p"], b["p"]) - f(a["p"], 3) - f(3, b["p"]) + f(3, 3)
    assert got == want
