"""Merkle manifest of a table: a digest of each row, a tree for each group of rows, and proofs that climb it.

A row's leaf is the SHA-256 of its fields. The leaves of a group stand in order;
every three neighbours become one node until one is left, the group's subroot;
subroots become the root in the same way. Digests are hashed as hex text and
stored as bytes.

Building goes level by level: a level is a third of the one below and a written
table. Every node that has a parent becomes a row that knows the parent and the
siblings on either side; rows of every STRIDE levels are joined to one, which
knows the siblings on the way and the ancestor that it leads to. A recursive
query (WITH RECURSIVE) then climbs: it begins with one row a leaf and, a stride
at a time, joins the row of the node reached, puts out its siblings, and folds
the digest it carries with them. What an iteration carries does not grow with
the height, and a leaf's way is a third as many iterations as there are levels.

Near the root all leaves meet in few nodes. A node's row is therefore repeated
once for every SHARE leaves under it, and the leaves are dealt over these copies
by their number, so that no join key has more than SHARE leaves: copies of a
level are as many as the leaves by SHARE. The rows are a bucketed table, so that
no iteration shuffles them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._spark import crc32_mod, dropped, new_path, read, written

#: Neighbours that become one node.
FAN = 3
#: Levels that one iteration climbs.
STRIDE = 3
#: Leaves that meet in one key of the climb.
SHARE = 1024
#: Node rows of a bucket, about.
BUCKET_ROWS = 200_000
#: A node's key is its level in the high bits and its first leaf's number in the low ones; trees over subroots begin at TOP.
_LEVEL_BITS, TOP = 56, 64

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """A field as text: its length in UTF-8 bytes, a colon and itself; null is a hyphen."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def hashed(*texts: Column) -> Column:
    """The SHA-256 of texts one after another, as bytes."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (from a table) with pos: their place in the whole order from 0, nulls first; rows that are equal in it stand in any order. Written.

    Dealt by range and sorted within tasks; a task's rows are numbered from what
    the tasks before it hold, which is one row a task and so safe to broadcast.
    """
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, name).withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(parts), "_part").withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")


def placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves with pos, start (the pos of their group's first) and size (of the group). Written.

    A group's start comes to its rows by the tasks that hold it, so a group with
    very many rows is joined in as many pieces as it has tasks.
    """
    rows = numbered(leaves, [group, *order], "ranged")
    spans = rows.groupBy(group, "_part").agg(F.min("pos").alias("_low"), F.count("*").alias("_n"))
    starts = spans.groupBy(F.col(group).alias("_group")).agg(F.min("_low").alias("start"), F.sum("_n").alias("size"))
    spans = spans.join(starts, F.col(group).eqNullSafe(F.col("_group"))).select(F.col("_group"), F.col("_part").alias("_own"), "start", "size")
    done = written(rows.join(spans, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own"))).drop("_group", "_own", "_part"), "leaves")
    dropped(rows)
    return done


def _key(level: int, first: Column) -> Column:
    return F.lit(level << _LEVEL_BITS) + first


def _spread(leaves: Column) -> Column:
    """How often a node's row is stored."""
    return F.greatest(F.lit(1), F.ceil(leaves / SHARE)).cast("long")


def build(nodes: DataFrame, base: int, top: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes: key, start, i (place in the tree from 0), size (nodes of the tree), under (leaves below), digest → rows of all nodes with a parent, and the nodes that are left, one a tree.

    Both are lists of written or derived tables, one a level. A level groups each
    three neighbours by their place, so no group has more than three rows.
    """
    links, left = [], [nodes.where("size = 1")]
    most, level = nodes.agg(F.max("size")).first()[0] or 0, base
    while most > 1:
        child = F.struct("i", "key", "under", "digest")
        groups = nodes.where("size > 1").groupBy("start", F.expr(f"i div {FAN}").alias("i"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size"))
        groups = written(groups.agg(F.array_sort(F.collect_list(child)).alias("children"), F.sum("under").alias("under")), "level")
        parent = _key(level + 1, F.col("start") + F.col("i") * FAN ** (level + 1 - base))
        rows = groups.select(parent.alias("parent"), _spread(F.col("under")).alias("spread"), "children", F.posexplode("children").alias("at", "child"))
        siblings = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("children", lambda x: keep(x["i"], F.col("child.i"))), lambda x: F.hex(x["digest"])), ""), F.lit(""))
        step = F.array(F.struct(F.unhex(siblings(lambda a, b: a < b)).alias("before"), F.unhex(siblings(lambda a, b: a > b)).alias("after")))
        subroot = F.col("child.digest") if top and level == base else F.lit(None).cast("binary")
        links.append(rows.select(F.col("child.key").alias("node"), _spread(F.col("child.under")).alias("copies"), "parent", "spread", step.alias("steps"), subroot.alias("subroot")))
        digest = hashed(F.array_join(F.transform("children", lambda x: as_hex(x["digest"])), ""))
        nodes = groups.select(parent.alias("key"), "start", "i", "size", "under", digest.alias("digest"))
        left.append(nodes.where("size = 1"))
        most, level = -(-most // FAN), level + 1
    return links, left


def strides(links: list[DataFrame], stride: int | None = None) -> list[DataFrame]:
    """Rows of single levels, lowest first → of every so many levels those that lead past all of them, or to the end of their tree. An ancestor has few descendants on the way, so no join key is large."""
    out, stride = [], stride or STRIDE
    for k in range(0, len(links), stride):
        rows = links[k]
        for above in links[k + 1 : k + stride]:
            above = above.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"), F.col("spread").alias("_spread"), F.col("steps").alias("_steps"))
            met = rows.join(above, F.col("parent") == F.col("_node"), "left")
            rows = met.select("node", "copies", F.coalesce("_parent", "parent").alias("parent"), F.coalesce("_spread", "spread").alias("spread"), F.concat("steps", F.coalesce("_steps", F.array().cast(rows.schema["steps"].dataType))).alias("steps"), "subroot")
        out.append(rows)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


_CLIMB = """
    WITH RECURSIVE climb (leaf, node, part, folded, siblings, subroot) AS (
        SELECT leaf, leaf, 0L, tampered, CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
        UNION ALL
        SELECT c.leaf, n.parent, pmod(c.leaf, n.spread),
               aggregate(n.steps, c.folded, (h, s) -> unhex(sha2(concat(lower(hex(s.before)), lower(hex(h)), lower(hex(s.after))), 256))),
               aggregate(n.steps, CAST('' AS BINARY), (a, s) -> concat(a, s.before, s.after)), n.subroot
        FROM climb c JOIN {nodes} n ON c.node = n.node AND c.part = n.part)
    -- a way up leads to ever higher keys
    SELECT leaf, max_by(folded, node) AS folded, max(subroot) AS subroot,
           array_sort(collect_list(CASE WHEN siblings IS NOT NULL THEN struct(node, siblings) END)) AS siblings
    FROM climb GROUP BY leaf"""


def manifest(docs: DataFrame, tampered: DataFrame | None = None, fields: list[str] = FIELDS, group: str = "source", key: str = "doc_id", change: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, siblings (digests one after another, from the lowest up, as an array of bytes), folded_root: one row for each of docs; digests as bytes.

    fields: what a leaf is the digest of, in this order. change: fields as they
    were changed after the manifest was made; folded_root is then what the
    changed leaf and the original siblings give, and differs from root where a
    change took effect. Leaves stand by key within a group, null first; rows that
    repeat a key stand by their digest. Rows with a null group are a group, the
    first. Any field may be null or empty. An empty table gives no rows. Texts
    are hashed where they are read and go no further.
    """
    spark = docs.sparkSession
    change = change or {}
    digest = hashed(*[encoded(F.col(f)) for f in fields])
    other = hashed(*[encoded(change.get(f, F.col(f))) for f in fields])
    rows = written(docs.select(F.col(key).alias("_key"), F.col(group).alias("_tree"), digest.alias("digest"), other.alias("tampered")), "digests")
    leaves = placed(rows, "_tree", ["_key", "digest"])
    dropped(rows)
    nodes = leaves.select(F.col("pos").alias("key"), "start", (F.col("pos") - F.col("start")).alias("i"), "size", F.lit(1).cast("long").alias("under"), "digest")
    links, left = build(nodes, 0)
    # a group may be very large, and the groups may be very many: their subroots are numbered like leaves
    found = written(_union(left), "subroots")
    trees = numbered(found, ["start"], "trees")
    subroots = written(trees.select("key", F.lit(0).cast("long").alias("start"), F.col("pos").alias("i"), "under", "digest"), "subroots")
    for table in (found, trees):
        dropped(table)
    subroots = subroots.withColumn("size", F.lit(subroots.count()))
    above, last = build(subroots, TOP, True)
    root = _union(last).select("digest").first()
    root = F.lit(None if root is None else bytes(root[0])).cast("binary")
    links = strides(links) + strides(above)
    name, path = f"quern_nodes_{uuid.uuid4().hex}", new_path(spark, "nodes")
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.cteRecursionRowLimit",)}
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    start = leaves.select(F.col("pos").alias("leaf"), "tampered")
    try:
        if links:
            stored = _union(links).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
            buckets = max(spark.sparkContext.defaultParallelism, -(-leaves.count() * 3 // 2 // BUCKET_ROWS))
            stored.repartition(buckets, "node", "part").write.bucketBy(buckets, "node", "part").option("path", path).saveAsTable(name)
            climbed = spark.sql(_CLIMB, leaves=start, nodes=spark.table(name))
        else:  # a single leaf, or none
            climbed = start.select("leaf", F.col("tampered").alias("folded"), F.lit(None).cast("binary").alias("subroot"), F.array().cast("array<struct<node:long,siblings:binary>>").alias("siblings"))
        climbed = written(climbed, "climbed")
        for table in [subroots, *([_union(links), spark.read.parquet(path)] if links else [])]:
            dropped(table)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    done = leaves.select(F.col("pos").alias("leaf"), F.col("_key"), "digest").join(climbed, "leaf")
    return done.select(
        F.col("_key").alias(key),
        F.col("digest").alias("leaf"),
        F.coalesce("subroot", root).alias("subroot"),
        root.alias("root"),
        F.transform("siblings", lambda x: x["siblings"]).alias("siblings"),
        F.col("folded").alias("folded_root"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), 2) == 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    done = manifest(read(spark, sf_dir, "documents").select(*FIELDS), change={"text": cut})
    return done.select(
        "doc_id",
        as_hex(F.col("leaf")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform("siblings", as_hex), "").cast("binary"), 256).alias("proof_sha256"),
        as_hex(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: crc32 of the decimal id, bit by bit: the lowest bit of the inverted remainder.
_EVEN = """(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))),
                lambda crc, bit: xor(crc >> 1, CASE WHEN (crc & 1) <> bit THEN 3988292384 ELSE 0 END)) & 1) = 1"""
_ENCODED = lambda text: " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
_UP = "list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], '')))"
OP13_SQL = f"""
    WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, sha256({_ENCODED("text")}) AS leaf,
                   sha256({_ENCODED(f"CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END")}) AS tampered FROM documents),
         g AS (SELECT source, list(leaf ORDER BY doc_id) AS l FROM d GROUP BY source),
         up AS (SELECT source, 0 AS level, l FROM g UNION ALL SELECT source, level + 1, {_UP} FROM up WHERE len(l) > 1),
         s AS (SELECT source, l[1] AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM up WHERE len(l) = 1),
         t AS (SELECT 0 AS level, list(subroot ORDER BY j) AS l FROM s UNION ALL SELECT level + 1, {_UP} FROM t WHERE len(l) > 1),
         r AS (SELECT l[1] AS root FROM t WHERE len(l) = 1),
         -- the nodes of a run beside a leaf's own, for each level below its subroot, then below the root
         p AS (SELECT d.doc_id, up.level, l, (i // pow(3, up.level)::BIGINT) AS k FROM d JOIN up ON d.source IS NOT DISTINCT FROM up.source WHERE len(l) > 1
               UNION ALL SELECT d.doc_id, height + t.level, l, (j // pow(3, t.level)::BIGINT) FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, t WHERE len(l) > 1),
         q AS (SELECT doc_id, level, array_to_string(l[k - k % 3 + 1:k], '') AS a, array_to_string(l[k + 2:k - k % 3 + 3], '') AS b FROM p),
         f AS (SELECT doc_id, 0 AS level, tampered AS h FROM d UNION ALL SELECT f.doc_id, f.level + 1, sha256(a || h || b) FROM f JOIN q ON q.doc_id = f.doc_id AND q.level = f.level),
         x AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM f GROUP BY doc_id),
         z AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY level)) AS proof_sha256 FROM q GROUP BY doc_id)
    SELECT d.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN x USING (doc_id) LEFT JOIN z USING (doc_id), r"""
