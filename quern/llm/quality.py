"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees over the bins are boosted
in turn, feature by feature, so that every feature ends with one lookup table;
then pairs of features that still explain errors get a table each. A score is
the sigmoid of the intercept and the sum of the tables' entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._labels import SAMPLE_ROWS, labelled_sample
from quern.llm._spark import crc32_mod, read, small_batches
from quern.llm._text import Words, shingles, steps, text_bytes, with_columns

FEATURES = ["length", "words", "word_bytes", "letters", "capitals", "digits", "symbols", "bangs", "bars", "spaces", "lines", "stops", "beyond_ascii", "distinct", "commonest", "again", "repeats", "short"]
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 32, 8, 120, 60, 8, 0.1, 5.0

_KINDS = np.zeros(256, np.uint8)
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c] = 7 if _c >= 128 else 1 if "a" <= _s <= "z" else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 4 if _s == "!" else 5 if _s == "|" else 6 if _s in " \t\r" else 8 if _s == "\n" else 9 if _s in ".,;:?'\"-()" else 0


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from its bytes and words alone; of an empty text all are 0."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 10 + _KINDS[data], minlength=10 * n).reshape(n, 10)
    words = Words(data, offsets)
    count = words.counts()
    per_byte, per_word = 1.0 / np.maximum(size, 1), 1.0 / np.maximum(count, 1)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 7]
    of = np.repeat(np.arange(n), count)
    # words of one text side by side: the text's number in the upper bits, the word's hash below
    keys = np.sort((of.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(keys)))
    home = (keys[at] >> np.uint64(40)).astype(np.int64)
    commonest = np.zeros(n)
    np.maximum.at(commonest, home, runs)
    again = np.zeros(len(of), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    run, starts = shingles(words)
    run_of = np.repeat(np.arange(n), np.diff(starts))
    seen = np.unique((run_of.astype(np.uint64) << np.uint64(40)) | (run >> np.uint64(24)))
    seen_n = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=n)
    length = words.end - words.start
    columns = [
        np.log1p(size), np.log1p(count), np.bincount(of, length, n) * per_word, letters * per_byte, kinds[:, 2] / np.maximum(letters, 1), kinds[:, 3] * per_byte, kinds[:, 0] * per_byte,
        kinds[:, 4] * per_word, kinds[:, 5] * per_word, kinds[:, 6] * per_byte, kinds[:, 8] * per_word, kinds[:, 9] * per_word, kinds[:, 7] * per_byte, np.bincount(home, minlength=n) * per_word,
        commonest * per_word, np.bincount(of, again, n) * per_word, 1.0 - seen_n / np.maximum(np.diff(starts), 1), np.bincount(of, length <= 3, n) * per_word,
    ]
    for i, c in enumerate(columns):
        out[:, i] = c
    out[size == 0] = 0
    return out


@dataclass
class Additive:
    """edges: the upper borders of each feature's bins. tables, pairs: added where a text falls."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "left")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "left"), np.searchsorted(self.coarse[b], x[:, b], "left")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut ordered bins in two, and what is gained; 0 bins to the left: none."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] ** 2 / (ch[:-1] + SMOOTH) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + SMOOTH)
    best = int(np.argmax(left))
    gain = left[best] - cg[-1] ** 2 / (ch[-1] + SMOOTH)
    return (float(gain), best + 1) if gain > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a shallow tree over ordered bins."""
    _, cut = _split(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut of one feature, then one of the other on either side; the better order, and what it gains."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, cut = _split(a.sum(1), b.sum(1))
        value, gain = np.empty_like(a), 0.0
        for part in (slice(0, cut), slice(cut, len(a))):
            if part.stop <= part.start:
                continue
            pg, ph = a[part].sum(0), b[part].sum(0)
            row = _tree(pg, ph, 1)
            gain += float((row * pg).sum())
            value[part] = row
        if gain > best:
            best, out = gain, value.T if turned else value
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """From a bounded sample. Without rows, or with one label alone, the score is constant."""
    if not len(y):
        return Additive([], 0.0, [], [], [])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive([_borders(c, BINS) for c in x.T], float(np.log(rate / (1 - rate))), [], [_borders(c, COARSE) for c in x.T], [])
    bins = [np.searchsorted(e, c, "left") for e, c in zip(model.edges, x.T, strict=True)]
    rough = [np.searchsorted(e, c, "left") for e, c in zip(model.coarse, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if y.min() == y.max():
        return model
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(model.tables[f])), np.bincount(b, h, len(model.tables[f])))
            model.tables[f] += step
            total += step[b]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        na, nb = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = rough[a] * nb + rough[b]
        g, h = slopes()
        return at, np.bincount(at, g, na * nb).reshape(na, nb), np.bincount(at, h, na * nb).reshape(na, nb)

    gains = sorted(((_pair_tree(*cells(a, b)[1:])[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for _, a, b in gains]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            at, g, h = cells(a, b)
            step = RATE * _pair_tree(g, h)[1]
            table += step
            total += step.ravel()[at]
    return model


def _mapped(df: DataFrame, of, column: str, kind: str) -> DataFrame:
    """df with the column that of gives for the bytes of text."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                yield with_columns(part, {column: of(*text_bytes(part.column(part.schema.get_field_index("text"))))})

    kept = StructType([f for f in df.schema if f.name != column])
    return df.mapInArrow(run, StructType(kept.fields + StructType.fromDDL(f"{column} {kind}").fields))


def fit_quality(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", most: int = SAMPLE_ROWS) -> Additive:
    """The model from about `most` labelled rows that keep accepts; their features (18 numbers a row) go to the driver."""

    def features(data, offsets):
        return pa.array(list(text_features(data, offsets)), pa.list_(pa.float64()))

    small_batches(docs.sparkSession)
    rows = _mapped(labelled_sample(docs, labels, label, keep, most), features, "features", "array<double>").select("doc_id", "features", "y").toPandas().sort_values("doc_id")
    return fit_additive(np.array(rows["features"].tolist()).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with score double: 0 to 1, higher the likelier label 1. Null texts count as empty. A column named score gives way."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of at most 32 entries a feature and 64 a pair

    def score(data, offsets):
        return pa.array(shared.value.score(text_features(data, offsets)), pa.float64())

    return _mapped(docs, score, "score", "double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc32_mod(F.col("doc_id"), 5)
    model = fit_quality(docs, read(spark, sf_dir, "labels"), remainder != 0)
    return score_quality(docs, model).select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
