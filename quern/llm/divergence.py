"""Source divergence audit: how each source's words differ from its language's and from the other sources'.

Documents are counted where they are read: a task keeps the counts of its
(lang, source, term) and hands on what it has when they are many. One shuffle by
(lang, term) sums them, and there the terms of too few documents go.

Terms with equal counts in a group and in its language are one cell, and f is
worked out once a cell. Cells of equal f are merged; a group's values are ranked,
at most as many as ranks are asked for leave a task, and their multiplicities
summed tell the rank at which each begins. Only terms of such values are then
looked at, in UTF-8 order, as many of each as are left to rank.

Between two sources A and B of a language the sum of f over all terms is taken
apart: terms that both have, terms that one has, terms that none has. What a term
of A adds where B lacks it depends on its count alone, so one histogram of counts
a group does for all partners; terms that both have are corrected where they
stand, in tasks that hold all sources of a term and keep sums by pair. So the
terms that a pair lacks cost nothing. All arithmetic is of integers, and sums
wrap or are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._spark import dropped, read, small_batches, written
from quern.llm._text import Counter as Sums
from quern.llm._text import steps

#: What p is a whole number of.
UNIT = 1_000_000_000
LEAST_DOCS, RANKS = 3, 200
#: Distinct (lang, source, term) that a counting task holds before it hands them on; bytes of text counted at once.
HELD, SLICE = 500_000, 1 << 20
#: Pieces that the rows of a group and of a cell are joined in; slices of tasks whose terms of one value are ranked first.
PIECES, SLICES = 32, 64
#: Pairs of sources whose sums a task holds before it hands them on; pairs of counts worked out at once; partners of a group in one row.
PAIRS, AT_ONCE, PARTNERS = 1 << 20, 1 << 18, 1000

#: A-Z in lower case, a-z and all bytes beyond ASCII as they are, anything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> Counter:
    """How often each term stands in a text, as UTF-8. A text is cut into slices at spaces, so that a long one is not held as words."""
    found: Counter = Counter()
    data = (text or "").encode("utf-8").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text → lang, source, term, n, docs."""
    counts: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k[0] for k in keys], pa.string()),
                "source": pa.array([k[1] for k in keys], pa.string()),
                "term": pa.array([k[2].decode("utf-8") for k in keys], pa.string()),
                "n": pa.array([v[0] for v in values], pa.int64()),
                "docs": pa.array([v[1] for v in values], pa.int64()),
            }
        )

    for batch in batches:
        for part in steps(batch, "text"):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for term, n in terms_of(text).items():
                    if (held := counts.get((lang, source, term))) is None:
                        counts[lang, source, term] = [n, 1]
                    else:
                        held[0] += n
                        held[1] += 1
                if len(counts) >= HELD:
                    yield out()
                    counts.clear()
    if counts:
        yield out()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, all_n: the counts in a group and in its language of the terms that at least so many documents of the language hold.

    docs: lang, source, text, none of them null. Each row is a document. One
    shuffle: partial sums of tasks are dealt by (lang, term), which the sums by
    group, the sums by language and the choice of terms share; a term has at
    most a row for each source and task.
    """
    small_batches(docs.sparkSession)
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"all_n": F.sum("n").over(by), "all_docs": F.sum("docs").over(by), "_first": F.row_number().over(by.orderBy("source")) == 1})
    return counts.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", F.col("_first").alias("first"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact for counts of 18 digits; null without terms."""
    return F.expr(f"1 + cast({count} + 1 AS decimal(19,0)) * cast({UNIT} AS decimal(10,0)) div nullif(cast({total} + {terms} AS decimal(19,0)), 0)")


#: f: the squared difference by q, rounded down.
_F = "(p - q) * (p - q) div q"


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of arrays of integers."""
    return (p - q) ** 2 // q


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a term, with the group, p and the p of count 0 of every source that has it → sums by pair of what having it both adds to having it alone."""
    codes: dict[int, int] = {}
    names: list[int] = []
    sums = Sums()

    def out() -> pa.RecordBatch:
        keys, values = sums.merge()
        name = np.array(names, np.int64)
        sums.parts, sums.size = [], 0
        codes.clear()
        names.clear()
        a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(name[a], pa.int64()), "b": pa.array(name[b], pa.int64()), "value": pa.array(values, pa.int64())})

    for batch in batches:
        lists = batch.column(0)
        if not len(lists):
            continue
        rows, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        group, p, none = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        distinct, of = np.unique(group, return_inverse=True)
        for g in distinct.tolist():
            if g not in codes:
                codes[g] = len(names)
                names.append(g)
        own = np.array([codes[g] for g in distinct.tolist()], np.int64)[of]
        first, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)  # of the term that each entry is of
        ends, at = np.cumsum(size), 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            each = size[at:stop]
            left = np.repeat(np.arange(at, stop), each)
            right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first[left]
            left, right = left[left != right], right[left != right]
            x, x0, y, y0 = p[left], none[left], p[right], none[right]
            value = _apart(x, y) - _apart(x, y0) - _apart(x0, y) + _apart(x0, y0)
            sums.add((own[left] << 32 | own[right]).astype(np.uint64), value)
            at = stop
        if sums.size > PAIRS:
            sums.merge()
            if sums.size > PAIRS:
                yield out()
    if sums.size:
        yield out()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's histogram of p and some of its partners → for each of them both ways round, the sum of f as if no term were in both."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
            mine, none, terms = row["a"].as_py(), row["none"].as_py(), row["terms"].as_py()
            others = row["partners"].values
            names, theirs = others.field("b").to_numpy(zero_copy_only=False), others.field("none").to_numpy(zero_copy_only=False)
            if terms:
                hist = row["histogram"].values
                p, m = (hist.field(i).to_numpy(zero_copy_only=False) if hist is not None else np.empty(0, np.int64) for i in range(2))
                to, back = terms * _apart(none, theirs), np.zeros(len(theirs), np.int64)
                for at in range(0, len(p), step := max(1, AT_ONCE // max(1, len(theirs)))):
                    x, w = p[at : at + step, None], m[at : at + step, None]
                    to += (w * (_apart(x, theirs[None, :]) - _apart(none, theirs)[None, :])).sum(0)
                    back += (w * (_apart(theirs[None, :], x) - _apart(theirs, none)[None, :])).sum(0)
            else:
                to = back = np.zeros(len(names), np.int64)
            yes = names != mine
            to, back, names = to[yes], back[yes], names[yes]
            same = np.full(len(names), mine)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([same, names]), pa.int64()), "b": pa.array(np.concatenate([names, same]), pa.int64()), "value": pa.array(np.concatenate([to, back]), pa.int64())})


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """g (a number), lang, source, total, all_total, terms, none, one row for every (lang, source) of docs: counts of kept terms in the group and in the language, how many terms there are, and p of a count of 0."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("all_total"))
    found = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "all_total"])
    return found.withColumns({"none": probability("0", "total", "terms"), "g": F.monotonically_increasing_id()})


def source_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, value: the sum of f over the language's terms, for every two groups of a language, either way round."""
    terms = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "none")).alias("groups"))  # at most one entry a source
    both = terms.where(F.size("groups") > 1).select("groups").mapInArrow(_together, "a long, b long, value long")
    # a group has as many entries as it has distinct counts, which is less than the root of twice its words
    counts = rows.groupBy("g", "p").agg(F.count("*").alias("m")).groupBy(F.col("g").alias("a")).agg(F.collect_list(F.struct("p", "m")).alias("histogram"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks"))
    numbered = groups.join(blocks, "lang")
    partners = numbered.groupBy("lang", F.pmod(F.xxhash64("g"), "blocks").cast("int").alias("block")).agg(F.collect_list(F.struct(F.col("g").alias("b"), "none")).alias("partners"))
    each = numbered.select(F.col("g").alias("a"), "lang", "none", "terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(counts, "a", "left")
    apart = each.join(partners, ["lang", "block"]).select("a", "none", "terms", "histogram", "partners").mapInArrow(_alone, "a long, b long, value long")
    return both.unionByName(apart).groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))


def leading_terms(rows: DataFrame, ranks: int = RANKS) -> DataFrame:
    """g, term, value, rank: a group's terms with p above q by f, up to so many ranks, ties in UTF-8 order."""
    above = rows.where("p > q")
    cells = above.groupBy("g", "n", "all_n").agg(F.first("p").alias("p"), F.first("q").alias("q"), F.count("*").alias("m")).withColumn("value", F.expr(_F))
    values = cells.groupBy("g", "value").agg(F.sum("m").alias("m"))
    best = Window.partitionBy("g").orderBy(F.desc("value"))
    # every value has a term, so no more values than ranks count
    values = values.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= ranks)
    values = values.withColumn("before", F.coalesce(F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < ranks).select("g", "value", "before")
    chosen = cells.select("g", "n", "all_n", "value").join(values, ["g", "value"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    named = above.select("g", "n", "all_n", "term", F.pmod(F.xxhash64("term"), F.lit(PIECES)).cast("int").alias("piece")).join(chosen, ["g", "n", "all_n", "piece"])
    # a value of very many terms is cut down in slices first, as every task would hand on as many as there are ranks
    slices = named.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    for by in (["g", "value", "slice"], ["g", "value"]):
        slices = slices.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("term"))).where(F.col("_r") <= ranks)
    named = slices
    return named.withColumn("rank", (F.col("before") + F.col("_r")).cast("int")).where(F.col("rank") <= ranks).select("g", "term", "value", "rank")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language, the distance from every other source (part pair) and the terms that stand out most (part term).

    docs: lang, source, text; null is the empty text. Rows are documents each,
    also where they repeat. A source of a language without kept terms has pairs
    of value 0 and no terms; an empty table gives no rows. A language may have up
    to a thousand million terms before a sum could pass 64 bits.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_terms(docs, least_docs), "terms")
    groups = written(group_totals(docs, kept), "groups")
    # a group may hold a third of all terms: it is joined in pieces
    pieces = groups.select("g", "lang", "source", "total", "all_total", "terms", "none", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"))
    rows = kept.withColumn("piece", F.pmod(F.xxhash64("term"), F.lit(PIECES)).cast("int")).join(pieces, ["lang", "source", "piece"])
    rows = rows.select("g", "lang", "term", "n", "all_n", probability("n", "total", "terms").alias("p"), "none", probability("all_n", "all_total", "terms").alias("q"))
    rows = written(rows, "rows")
    dropped(kept)
    names = groups.select("g", "lang", "source")
    pairs = source_pairs(rows, groups).join(names.withColumnRenamed("g", "a"), "a").join(names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = leading_terms(rows, ranks).join(names, "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    done = written(pairs.unionByName(terms), "divergence")
    for table in (rows, groups):
        dropped(table)
    return done


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
         k AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
         l AS (SELECT lang, count(*) AS v, sum(all_n)::BIGINT AS total FROM k GROUP BY lang),
         c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
         g AS (SELECT DISTINCT lang, source FROM d),
         s AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total, coalesce(v, 0)::BIGINT AS v FROM g LEFT JOIN l ON l.lang = g.lang),
         p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (s.total + s.v) AS p, 1 + (1000000000 * (all_n + 1)) // (l.total + l.v) AS q
               FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
         x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         y AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
         z AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM y),
         e AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term)::INTEGER AS rank FROM p WHERE n > 0 AND p > q)
    SELECT * FROM z UNION ALL SELECT * FROM e WHERE rank <= 200"""
