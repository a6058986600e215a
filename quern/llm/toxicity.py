"""Toxicity: a counterfactual-regularised linear classifier.

Features are the words of a text and the beginnings of its longer words (3 to 8
bytes), each counted once a text. Those that go with a label are chosen by a
likelihood-ratio test over the sampled texts, in Spark. The weights then
minimise the logistic loss plus a penalty on score changes: every labelled text
that names a group is paired with a copy in which each identity term is swapped
for another of its kind, and the squared difference of both scores is added.
A neutral mention of a group thus moves a score little. Where no labelled text
names a group the penalty changes nothing.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._labels import SAMPLE_ROWS, labelled_sample
from quern.llm._spark import crc32_mod, read, small_batches, written
from quern.llm._text import HELD, Counter, Words, list_array, steps, text_bytes

PREFIX_BYTES = (3, 4, 5, 6, 7, 8)
#: Features that the model keeps: those with the largest likelihood ratio above LEAST_RATIO.
MOST_FEATURES, LEAST_RATIO = 8192, 15.0
EPOCHS, RATE, RIDGE, SWAP_PENALTY = 400, 0.1, 2e-5, 1.0

#: Identity terms in English, French, German and Spanish (fixed values): each is swapped for another of its row.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "bisexual", "transgender", "straight"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["disabled", "deaf", "blind", "elderly", "young"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"],
    ["immigré", "réfugié", "étranger", "citoyen"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"],
    ["einwanderer", "flüchtlinge", "ausländer", "bürger"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo"],
    ["inmigrante", "refugiado", "extranjero", "ciudadano"],
]
_ROW = {t: row for row in IDENTITY_TERMS for t in row}
_TERM = re.compile(r"(?<![\w])(" + "|".join(sorted(map(re.escape, _ROW), key=len, reverse=True)) + r")(?![\w])", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term swapped for the next of its row, chosen by a checksum of the text."""
    turn = zlib.crc32(text.encode())

    def other(m: re.Match) -> str:
        row = _ROW[m[0].lower()]
        new = row[(row.index(m[0].lower()) + 1 + turn % (len(row) - 1)) % len(row)]
        return new.capitalize() if m[0][0].isupper() else new

    return _TERM.sub(other, text)


def keys_of(data: np.ndarray, offsets: np.ndarray, among: Keys | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, as 64-bit keys or, if a set of keys is given, as numbers in it; and where each text's begin."""
    words = Words(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), words.counts())
    parts = [(words.hash, owner)] + [(key, owner[i]) for i, key in (words.prefixes(k) for k in PREFIX_BYTES)]
    if among is not None:
        found = [(among.number(k), o) for k, o in parts]
        number = np.concatenate([k[k >= 0] for k, _ in found])
        home = np.concatenate([o[k >= 0] for k, o in found])
        pairs = np.unique(home * (len(among.keys) + 1) + number)
        home, number = np.divmod(pairs, len(among.keys) + 1)
        return number, np.searchsorted(home, np.arange(len(offsets)))
    key, home = np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])
    order = np.lexsort((key, home))
    key, home = key[order], home[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
    key, home = key[fresh], home[fresh]
    return key, np.searchsorted(home, np.arange(len(offsets)))


class Keys:
    """A sorted set of keys with a bitmap before it, which turns most others away at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def number(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in the set, or -1."""
        out = np.full(len(key), -1, np.int64)
        at = np.flatnonzero(self.maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == key[at], place, -1)
        return out


@dataclass
class Linear:
    keys: Keys
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        number, at = keys_of(data, offsets, self.keys)
        total = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), self.weights[number], len(at) - 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _counts(sample: DataFrame) -> DataFrame:
    """key, n, positive: sampled texts that have a feature, and those labelled 1 among them, counted within tasks first."""

    def out(counter: Counter):
        keys, both = counter.merge()
        counter.parts, counter.size = [], 0
        for a in range(0, len(keys), 1 << 16):
            key, n = keys[a : a + (1 << 16)], both[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n & 0xFFFFFFFF), "positive": pa.array(n >> 32)})

    def count(batches):
        counter = Counter()  # texts in the lower half of a count, those labelled 1 in the upper half
        for batch in batches:
            for part in steps(batch, "text"):
                key, at = keys_of(*text_bytes(part.column(part.schema.get_field_index("text"))))
                y = np.repeat(part.column(part.schema.get_field_index("y")).to_numpy().astype(np.int64), np.diff(at))
                counter.add(key, (y << 32) + 1)
                if counter.size > HELD:
                    counter.merge()
                    if counter.size > HELD:
                        yield from out(counter)
        yield from out(counter)

    return sample.select("text", "y").mapInArrow(count, "key long, n long, positive long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def _ratio(n: Column, k: Column, all_n: int, all_k: int) -> Column:
    """Twice the log of the likelihood ratio of a feature and the label."""

    def part(seen: Column, rows: Column, total: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * all_n / (rows * total))).otherwise(0.0)

    other_n, pos, neg = F.lit(float(all_n)) - n, all_k, all_n - all_k
    return 2 * (part(k, n, pos) + part(n - k, n, neg) + part(F.lit(float(all_k)) - k, other_n, pos) + part(F.lit(float(neg)) - n + k, other_n, neg))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists of integers, and the row of each; null lists are empty."""
    lists = lists.combine_chunks().fill_null([])
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), size)


def fit_linear(rows: pa.Table, keys: Keys) -> Linear:
    """rows: y, own (features), swap (features of the swapped copy, or null). Full-batch gradient steps with per-weight scaling."""
    n, f, y = rows.num_rows, len(keys.keys), rows["y"].to_numpy().astype(np.float64)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return Linear(keys, np.zeros(f), float(np.log(rate / (1 - rate))))
    flat, of = _flat(rows["own"])
    swap = rows.filter(rows["swap"].is_valid())
    plus, plus_of = _flat(swap["own"])
    minus, minus_of = _flat(swap["swap"])
    swaps = swap.num_rows
    w, bias = np.zeros(f), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    m, v = np.zeros(f + 1), np.zeros(f + 1)
    for t in range(1, EPOCHS + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(of, w[flat], n) + bias, -30, 30)))
        slope = np.bincount(flat, (p - y)[of], f) / n + RIDGE * w
        if swaps:
            gap = np.bincount(plus_of, w[plus], swaps) - np.bincount(minus_of, w[minus], swaps)
            slope += 2 * SWAP_PENALTY / swaps * (np.bincount(plus, gap[plus_of], f) - np.bincount(minus, gap[minus_of], f))
        g = np.append(slope, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Linear(keys, w, float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", most: int = SAMPLE_ROWS) -> Linear:
    """The model from about `most` labelled rows that keep accepts. The driver gets MOST_FEATURES keys and, of each sampled row, its numbers among them."""
    small_batches(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, label, keep, most).select("doc_id", "text", "y"), "toxic-sample")
    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    scored = _counts(sample).where("n >= 3").withColumn("ratio", _ratio(F.col("n").cast("double"), F.col("positive").cast("double"), n, k)) if n else _counts(sample).withColumn("ratio", F.lit(0.0))
    best = scored.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "key").limit(MOST_FEATURES).select("key").toPandas()["key"]
    terms = pa.array([t for row in IDENTITY_TERMS for t in row])
    always = keys_of(*text_bytes(terms))[0]
    keys = Keys(np.unique(np.concatenate([best.to_numpy(np.int64).view(np.uint64), always])))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def encode(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                texts = [t or "" for t in column.to_pylist()]
                own, at = keys_of(*text_bytes(column), shared.value)
                names = [i for i, t in enumerate(texts) if _TERM.search(t)]
                others, there = keys_of(*text_bytes(pa.array([swapped(texts[i]) for i in names], pa.string())), shared.value)
                rows = list_array(others, there, pa.int32()).to_pylist()
                swaps = dict(zip(names, rows, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "y": part.column(part.schema.get_field_index("y")), "own": list_array(own, at, pa.int32()), "swap": pa.array([swaps.get(i) for i in range(len(texts))], pa.list_(pa.int32()))})

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(encode, f"doc_id {kind}, y int, own array<int>, swap array<int>").toArrow().sort_by("doc_id")
    return fit_linear(rows, keys)


def score_toxicity(docs: DataFrame, model: Linear) -> DataFrame:
    """docs with score double: 0 to 1, higher the likelier label 1. Null texts count as empty. A column named score gives way."""
    from quern.llm.quality import _mapped

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES keys and weights, and a bitmap of 1 MB
    return _mapped(docs, lambda data, offsets: pa.array(shared.value.score(data, offsets), pa.float64()), "score", "double")


#: From this score on a text is rejected.
REJECT = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc32_mod(F.col("doc_id"), 3)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), remainder != 1)
    return score_toxicity(docs, model).select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
