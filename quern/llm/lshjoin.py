"""N-gram Jaccard join over a MinHash LSH forest, verified exactly.

Every text's set of word 5-grams has a signature of DEPTH MinHash values in each
of TREES trees. In a tree, signatures are sorted, so that texts with a common
prefix are a run of neighbours: a prefix trie without pointers. The join starts
at whole signatures and verifies, on their whole 5-gram sets, the pairs that
share one; then prefixes are shortened by a value at a time, and each level
verifies the pairs that meet there for the first time. The similarities of the
links found so far tell what share of all links the level reaches (each link
stands for 1 / p links like it, p being its chance to be found): the join stops
when that share is RECALL, on these very data, or where a pair at the threshold
itself is found at that rate.

Texts with one 5-gram set are one class from the start: signatures and
candidates are of classes. A pair is verified only at the longest prefix and
in the first tree in which both meet. Large runs are cut into blocks, and a task
gets one block against another, so no task holds a group whose size grows with
the data; nothing is sampled or capped. Pairs never leave a task: it returns
each class's number of links and which classes hang together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._graph import components, sorted_groups
from quern.llm._spark import read, small_batches, written
from quern.llm._text import Words, list_array, mix, shingles, steps, text_bytes

THRESHOLD = 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
#: Members and 5-grams of a block, about; a run with more of either is cut.
BLOCK_MEMBERS, BLOCK_GRAMS = 512, 400_000
#: Values of a signature in one 64-bit number, and bits of each.
_PACKED, _BITS = 4, 16
#: Similarities of links are counted in bins of this width.
_BIN = 0.01


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold itself is found at this rate: below it no level need go."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= recall), 1)


def reached(links: np.ndarray, now: int, level: int, threshold: float, trees: int) -> float:
    """The estimated share of all links that prefixes of length `level` find, from the links found with length `now`, counted by bins of similarity from the threshold up."""
    similar = np.minimum(threshold + _BIN * np.arange(len(links)), 1.0)
    chance = lambda k: 1 - (1 - similar**k) ** trees
    whole = links / chance(now)
    return float((whole * chance(level)).sum() / whole.sum()) if links.sum() else 0.0


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def set_of(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 5-grams of each text, sorted, and where each text's begin."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(starts)))


def signatures(grams: np.ndarray, starts: np.ndarray, trees: int, depth: int = DEPTH) -> np.ndarray:
    """Of each text and tree: its MinHash values, of _BITS bits, packed in two numbers in their order; all texts have 5-grams."""
    out = np.zeros((len(starts) - 1, trees, 2), np.uint64)
    seeds = _seeds(depth * trees)
    for t in range(trees):
        for k in range(depth):
            values = (grams ^ seeds[t * depth + k]) * np.uint64(0x9FB21C651E98DF25)
            values ^= values >> np.uint64(32)
            least = mix(np.minimum.reduceat(values, starts[:-1])) >> np.uint64(64 - _BITS)
            out[:, t, k // _PACKED] |= least << np.uint64(64 - _BITS * (k % _PACKED + 1))
    return out


def _masks(length: int) -> tuple[int, int]:
    """What keeps a prefix of a packed signature, as signed numbers."""
    bits = [min(max(length - _PACKED * i, 0), _PACKED) * _BITS for i in (0, 1)]
    return tuple(-(1 << (64 - n)) if n else 0 for n in bits)


def prefix(tree: Column, first: Column, second: Column, length: int) -> Column:
    """The key of a run: a hash of the tree and the first values. Runs that collide are told apart when pairs are made."""
    one, two = _masks(length)
    return F.xxhash64(tree, first.bitwiseAND(F.lit(one)), second.bitwiseAND(F.lit(two)))


def _nodes(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's set of 5-grams; of an empty set 0."""
    n = np.diff(starts)
    some, out = np.flatnonzero(n), np.zeros((2, len(n)), np.uint64)
    if len(some):
        one, two = (np.add.reduceat(mix(grams ^ np.uint64(seed)), starts[:-1][some]) for seed in (0, 0x5851F42D4C957F2D))
        size = n[some].astype(np.uint64)
        out[:, some] = mix(one + size), mix(two ^ mix(size))
    return out[0], out[1]


def _sketches(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, copy (hash of the text), n (distinct 5-grams), one, two (hashes of the set), signature; n 0 for wordless texts."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                grams, starts = set_of(*shingles(Words(*text_bytes(part.column(1)))))
                n = np.diff(starts)
                some, packed = np.flatnonzero(n), np.zeros((len(n), trees, 2), np.uint64)
                if len(some):
                    packed[some] = signatures(grams, np.append(starts[:-1][some], len(grams)), trees)
                at = np.arange(len(n) + 1) * 2 * trees
                one, two = (pa.array(x.view(np.int64)) for x in _nodes(grams, starts))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "copy": part.column(2), "n": pa.array(n, pa.int64()), "one": one, "two": two, "signature": list_array(packed.view(np.int64).ravel(), at, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _copy()).mapInArrow(run, "doc_id long, copy long, n long, one long, two long, signature array<long>")


def _copy() -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64("text").alias("copy")


def _gram_sets(docs: DataFrame) -> DataFrame:
    """one, two, grams: the sorted 64-bit hashes of the distinct 5-grams as binary."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                grams, starts = set_of(*shingles(Words(*text_bytes(part.column(0)))))
                sets = [grams[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                one, two = (pa.array(x.view(np.int64)) for x in _nodes(grams, starts))
                yield pa.RecordBatch.from_pydict({"one": one, "two": two, "grams": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(run, "one long, two long, grams binary")


def shared_prefix(packed: np.ndarray, tree: int, length: int) -> np.ndarray:
    """Which pairs of rows share a prefix of this length in a tree. packed: rows by trees by two."""
    one, two = (packed[:, tree, i] & np.uint64(m % (1 << 64)) for i, m in enumerate(_masks(length)))
    return (one[:, None] == one[None, :]) & (two[:, None] == two[None, :])


def owned_pairs(packed: np.ndarray, tree: int, length: int, blocks: np.ndarray, across: bool, n: np.ndarray, threshold: float, before: int | None = None) -> np.ndarray:
    """Which pairs (upper triangle) belong to this cell: of different blocks if across, met neither at the prefix before, a longer one, nor in an earlier tree, and near enough in size."""
    own = np.triu(shared_prefix(packed, tree, length), 1)
    if across:
        own &= blocks[:, None] != blocks[None, :]
    own &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    for t in range(packed.shape[1] if before else 0):
        if not own.any():
            return own
        own &= ~shared_prefix(packed, t, before)
    for t in range(tree):
        if not own.any():
            return own
        own &= ~shared_prefix(packed, t, length)
    return own


def overlaps(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """The number of common 5-grams of each owned pair."""
    size = len(sets)
    out = np.zeros((size, size), np.int64)
    if own.sum() <= 4 * size:
        for i, j in zip(*np.nonzero(own), strict=True):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat, row = np.concatenate(sets), np.repeat(np.arange(size), [len(s) for s in sets])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    rank = np.full(len(values), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    column = rank[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, step = np.zeros((size, size), np.float32), 4096
    for at in range(0, len(shared), step):  # 0/1 matrices: sums below 2**24 are exact in float32
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((size, min(step, len(shared) - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return np.where(own, total.astype(np.int64), 0)


def linked(sets: list[np.ndarray], own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which owned pairs are links, and their number by bins of similarity."""
    n = np.array([len(s) for s in sets], np.int64)
    common = overlaps(sets, own)
    united = n[:, None] + n[None, :] - common
    links = own & (common >= threshold * united - 1e-9)
    bins = ((common[links] / united[links] - threshold + 1e-9) / _BIN).astype(np.int64)
    return links, np.bincount(np.maximum(bins, 0), minlength=int(1 / _BIN) + 1)


def _leaders(links: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    both = links | links.T
    label = np.arange(len(links))
    while True:
        near = np.where(both, label[None, :], len(links)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


CELL = ["key", "lo", "hi"]


def _level(trie: DataFrame, classes: DataFrame, sets: DataFrame, length: int, before: int | None, threshold: float, trees: int) -> DataFrame:
    """node, leader, links, bin: links of the pairs that first share a prefix of this length; rows with a bin count links by similarity. A written table.

    trie: tree, node, n, first, second (the signature) of classes with a
    neighbour. before: the prefix whose pairs are verified already.
    """
    key, child = (prefix(F.col("tree"), F.col("first"), F.col("second"), k) for k in (length, before or DEPTH))
    rows = trie.select("tree", "node", "n", key.alias("key"), child.alias("child"))
    # a run all of which shared the prefix before had its pairs then
    grown = "least < most" if before else "members > 1"
    runs = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("grams"), F.min("child").alias("least"), F.max("child").alias("most")).where(grown)
    parts = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("grams") / BLOCK_GRAMS))
    runs = runs.select("key", F.when((F.col("members") > 2 * BLOCK_MEMBERS) | (F.col("grams") > 2 * BLOCK_GRAMS), F.least(parts, "members")).otherwise(1).cast("int").alias("parts"))
    met = rows.join(runs, "key").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tree", "block", "node")

    def cells_of(batches):
        for table, starts in sorted_groups(batches, CELL):
            packed = table["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, trees, 2)
            tree, lo, hi, block, n = (table[c].to_numpy() for c in ("tree", "lo", "hi", "block", "n"))
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                if b - a > 1:
                    yield table, a, b, owned_pairs(packed[a:b], tree[a], length, block[a:b], lo[a] != hi[a], n[a:b], threshold, before)

    def own(batches):
        for table, a, b, pairs in cells_of(batches):
            keep = pairs.any(0) | pairs.any(1)
            if keep.any():
                yield from table.slice(a, b - a).filter(pa.array(keep)).select([*CELL, "tree", "block", "node"]).to_batches()

    cells = met.join(classes.select("node", "n", "signature"), "node").repartition(*CELL).sortWithinPartitions(*CELL)
    cells = written(cells.mapInArrow(own, "key long, lo int, hi int, tree int, block int, node long"), "cells")

    def verify(batches):
        bins = np.zeros(1, np.int64)
        for table, a, b, pairs in cells_of(batches):
            grams, node, weight = table["grams"].combine_chunks(), table["node"].to_numpy(), table["weight"].to_numpy()
            links, similar = linked([np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in range(a, b)], pairs, threshold)
            bins = np.pad(bins, (0, max(0, len(similar) - len(bins)))) + np.pad(similar, (0, max(0, len(bins) - len(similar))))
            both = links | links.T
            at = np.flatnonzero(both.any(1))
            if len(at):
                yield pa.RecordBatch.from_pydict({"node": pa.array(node[a + at]), "leader": pa.array(node[a + _leaders(links)[at]]), "links": pa.array((both[at] @ weight[a:b]).astype(np.int64)), "bin": pa.nulls(len(at), pa.int32())})
        used = np.flatnonzero(bins)
        yield pa.RecordBatch.from_pydict({"node": pa.nulls(len(used), pa.int64()), "leader": pa.nulls(len(used), pa.int64()), "links": pa.array(bins[used].astype(np.int64)), "bin": pa.array(used.astype(np.int32))})

    whole = cells.join(classes.select("node", "n", "weight", "signature"), "node").join(sets, "node")
    return written(whole.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(verify, "node long, leader long, links long, bin int"), "links")


def _classified(docs: DataFrame, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs with their class's node; each node's class (root's least doc_id and copy) and links; rows that take no part."""
    spark = docs.sparkSession
    small_batches(spark)
    sketched = written(_sketches(docs, trees), "sketches")
    some = sketched.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "copy")).alias("least")
    classes = some.groupBy("one", "two").agg(first, F.count("*").alias("weight"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    # numbered once they are in a table, whose rows no longer change
    classes = written(written(classes, "sets").withColumn("node", F.monotonically_increasing_id()), "classes")

    # who has a neighbour at the shortest prefix that a level may use; narrow rows first, so that lone signatures leave early
    shortest = shortest_prefix(threshold, trees, DEPTH, recall)
    packed = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.get("signature", 2 * t).alias("first"), F.get("signature", 2 * t + 1).alias("second")))
    rows = classes.select("node", "n", F.explode(packed).alias("s")).select("node", "n", "s.*")
    keyed = rows.withColumn("key", prefix(F.col("tree"), F.col("first"), F.col("second"), shortest))
    runs = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    trie = written(keyed.join(runs, "key").select("tree", "node", "n", "first", "second"), "trie")
    # the sets of these classes, from one document of each
    wanted = classes.join(trie.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _copy())
    texts = texts.join(wanted.select("least.doc_id", "least.copy"), ["doc_id", "copy"], "left_semi")
    sets = wanted.select("node", "one", "two").join(_gram_sets(texts), ["one", "two"]).groupBy("node").agg(F.first("grams").alias("grams"))
    sets = written(sets, "sets")

    found, links, length, before = None, np.zeros(int(1 / _BIN) + 1), DEPTH, None
    while True:
        here = _level(trie, classes, sets, length, before, threshold, trees)
        found = here if found is None else found.union(here)
        for r in here.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # a hundred bins
            links[min(r["bin"], len(links) - 1)] += r["n"]
        if length <= shortest or reached(links, length, length, threshold, trees) >= recall:
            break
        length, before = next((k for k in range(length - 1, shortest, -1) if reached(links, length, k, threshold, trees) >= recall), shortest), length
    found = found.where("bin IS NULL")
    roots = components(found.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = written(roots.join(classes.select("node", "least"), "node"), "roots")
    # from tables, so that a class or a text with very many documents meets its one row in a join that Spark can split
    least = written(roots.groupBy("root").agg(F.min("least").alias("root_least")), "least")
    linked_to = counts.join(roots.join(least, "root").select("node", "root_least"), "node")
    named = classes.select("one", "two", "node", "least", "weight").join(linked_to, "node", "left")
    named = named.select("one", "two", "least", F.coalesce("root_least", "least").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return some, written(named, "named"), sketched.where("NOT (n > 0 AND doc_id IS NOT NULL)")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links: one row per row of docs (doc_id, text).

    n_links: other documents with a Jaccard similarity of word 5-gram sets of at
    least the threshold. class_id: the smallest doc_id of all documents joined by
    such links, directly or through others. Texts of fewer than five words, but
    not none, are one 5-gram. Null, empty and wordless texts and rows with a null
    doc_id have no links; their class is their own id. Repeated rows are copies;
    rows that repeat a doc_id with another text are documents of their own.
    """
    some, named, rest = _classified(docs, threshold, trees, recall)
    joined = some.select("doc_id", "one", "two").join(named, ["one", "two"]).select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links")
    return joined.union(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates: that with the smallest doc_id, and of several texts under it that with the smallest hash.

    Of rows that repeat both one stays. Rows with a null, empty or wordless text
    are a class each, and rows with a null doc_id all stay.
    """
    _, named, rest = _classified(docs.select("doc_id", "text"), THRESHOLD, TREES, RECALL)
    kept = named.where(F.col("least") == F.col("class")).select("least.doc_id", "least.copy").union(rest.where("doc_id IS NOT NULL").select("doc_id", "copy"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_copy": _copy()})
    classed = keyed.where("_id IS NOT NULL").join(kept.toDF("_id", "_copy").distinct(), ["_id", "_copy"], "left_semi").dropDuplicates(["_id", "_copy"])
    return classed.select(docs.columns).union(keyed.where("_id IS NULL").select(docs.columns))


def op6_lshjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
