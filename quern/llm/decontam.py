"""Benchmark decontamination: where documents repeat windows of benchmark items.

Texts are normalised to words joined by single spaces; every window of an item,
with a space at either end, goes into one Aho-Corasick automaton. A document is
scanned once; matches are mapped through word numbers to characters of the
original.

The automaton holds AUTOMATON_BYTES of windows at most. That size is checked
before anything is sent to executors: a larger benchmark is cut into parts, one
at a time. Each part is a pass over the documents that writes what it hits; these
hits are then united by document. Both ways give the same rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._spark import read, small_batches, written
from quern.llm._text import LOWER, with_columns

WINDOW_WORDS = 10
#: Bytes of window text in one automaton. An automaton takes about 40 times that in a worker.
AUTOMATON_BYTES = 4 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of lower-cased text (fixed value)
_UPPER = {c: c + 32 for c in range(65, 91)}
_TABLE = bytes(int(x) or 32 for x in LOWER)


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text in lower case, as UTF-8."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def windows_of(text: str | None, size: int = WINDOW_WORDS) -> set[str]:
    """Windows of a text, each as latin-1 letters of its UTF-8 bytes with a space at either end."""
    words = normal_words(text)
    if not words:
        return set()
    last = max(1, len(words) - size + 1)
    return {f" {b' '.join(words[i : i + size]).decode('latin-1')} " for i in range(last)}


class Scanner:
    """One automaton of windows; each window knows its number of words and its items (None: an item without an id)."""

    def __init__(self, windows: dict[str, list[int]], items: list[str | None]):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        for w, own in windows.items():
            self.automaton.add_word(w, (w.count(" ") - 1, len(w), own))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words; runs of hit words, first and past the last; items with occurring windows, sorted."""
        words = normal_words(text)
        if not words or not len(self.automaton):
            return len(words), [], []
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = [(end, *value) for end, value in self.automaton.iter(joined)]
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        runs: list[list[int]] = []
        items: set[int] = set()
        for last, size in sorted({(int(np.searchsorted(spaces, end)), size) for end, size, _, _ in found}, key=lambda x: x[0] - x[1]):
            if runs and last - size <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([last - size, last])
        for *_, own in found:
            items.update(own)
        return len(words), [(a, b) for a, b in runs], sorted({self.items[i] for i in items} - {None})


def word_spans(text: str) -> list[tuple[int, int]]:
    """Characters of each word in the original text."""
    return [m.span() for m in WORD.finditer(text.translate(_UPPER))]


_HITS = "n_words long, n_hit long, hit_items array<string>, hit_spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _hit_columns(texts: list[str | None], words: list[int], runs: list[list], items: list[list[str]]) -> dict[str, pa.Array]:
    """The columns of _HITS, from runs of hit words."""
    spans = []
    for text, own in zip(texts, runs, strict=True):
        at = word_spans(text) if own else []
        spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in own])
    return {"n_words": pa.array(words, pa.int64()), "n_hit": pa.array([sum(b - a for a, b in own) for own in runs], pa.int64()), "hit_items": pa.array(items, pa.list_(pa.string())), "hit_spans": pa.array(spans, _SPANS)}


def _with_hits(docs: DataFrame) -> StructType:
    names = {f.name for f in StructType.fromDDL(_HITS)}
    return StructType([f for f in docs.schema if f.name not in names] + StructType.fromDDL(_HITS).fields)


def benchmark_parts(benchmark: DataFrame, most: int | None = None) -> Iterator[tuple[dict[str, list[int]], list[str | None]]]:
    """The benchmark's windows in parts of bounded size, one at a time. Rows arrive one at a time; wordless texts have no windows."""
    windows, items, held = {}, [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        items.append(row[0])
        for w in windows_of(row[1]):
            if w not in windows:
                if held and held + len(w) > (most or AUTOMATON_BYTES):  # an item may be cut: its windows are sought one by one
                    yield windows, items
                    windows, items, held = {}, [row[0]], 0
                held += len(w)
            windows.setdefault(w, []).append(len(items) - 1)
    yield windows, items


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (with text) and n_words, n_hit, hit_items (item ids as strings, distinct and sorted), hit_spans (characters of the original).

    Null and empty texts have no words. Repeated rows each get their result. A
    column of docs with one of these names gives way. Items that repeat an id
    are one item; the words of items without an id are hit, but such items not
    listed. If the benchmark fits one automaton (AUTOMATON_BYTES, about 60,000
    windows), documents are read once and nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = benchmark_parts(benchmark)
    part, more = next(parts), next(parts, None)
    return _scanned(docs, spark.sparkContext.broadcast(part)) if more is None else _scanned_in_parts(docs, itertools.chain([part, more], parts))


def _scanned(docs: DataFrame, shared) -> DataFrame:
    def scan(batches):
        scanner = Scanner(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            words, runs, items = zip(*map(scanner.scan, texts), strict=True) if texts else ([], [], [])
            yield with_columns(batch, _hit_columns(texts, words, runs, items))

    return docs.mapInArrow(scan, _with_hits(docs))


def _scanned_in_parts(docs: DataFrame, parts: Iterator) -> DataFrame:
    """One pass and one written table of hits for each part; then the hits of a row, numbered once and for all, are united."""
    spark = docs.sparkSession
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            scanner = Scanner(*shared.value)
            for batch in batches:
                hits = [(r, *scanner.scan(t)[1:]) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                hits = [h for h in hits if h[1]]
                yield pa.RecordBatch.from_pydict({"_row": pa.array([h[0] for h in hits], pa.int64()), "_runs": pa.array([[{"start": a, "end": b} for a, b in h[1]] for h in hits], _SPANS), "_items": pa.array([h[2] for h in hits], pa.list_(pa.string()))})

        here = written(rows.select("_row", "text").mapInArrow(scan, "_row long, _runs array<struct<start:int,end:int>>, _items array<string>"), "hits")
        shared.unpersist()
        found = here if found is None else found.union(here)
    # of one row: as many as there are parts
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("_runs")).alias("_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    def unite(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            texts, runs = column("text"), []
            for own in column("_runs"):
                runs.append([])
                for s in sorted(own or [], key=lambda s: s["start"]):
                    if runs[-1] and s["start"] <= runs[-1][-1][1]:
                        runs[-1][-1][1] = max(runs[-1][-1][1], s["end"])
                    else:
                        runs[-1].append([s["start"], s["end"]])
            new = _hit_columns(texts, [len(normal_words(t)) for t in texts], runs, [x or [] for x in column("_items")])
            yield with_columns(batch, new).drop_columns(["_row", "_runs", "_items"])

    return rows.join(found, "_row", "left").mapInArrow(unite, _with_hits(docs))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         bs AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(2, len(w) - 8))) AS i0 FROM b WHERE len(w) > 0),
         bw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i0, i0 + size - 1), ' ') AS win FROM bs),
         ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i0 FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
         dw AS (SELECT doc_id, size, i0, array_to_string(list_slice(w, i0, i0 + size - 1), ' ') AS win FROM ds),
         h AS (SELECT doc_id, i0, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
         n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i0, i0 + size)) AS p FROM h) GROUP BY doc_id),
         i AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h WHERE item_id IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""
