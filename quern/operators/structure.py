"""The structure of legal texts: headings of several levels, carried down to what stands below them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of one document that a task sees together.
SPAN = 10_000

#: Levels of a regulation, outermost first: its kind, and the pattern of a heading whose first group is its number. Recitals stand before all of them.
REGULATION = [("chapter", r"^CHAPTER ([0-9IVXLC]+)\b"), ("section", r"^Section ([0-9]+)\b"), ("article", r"^Article ([0-9]+)\b")]
RECITAL = r"^\(([0-9]+)\) "


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the lines of texts in order; null texts have none."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def with_path(lines: DataFrame, key: str, pos: str, line: str, levels: list[tuple[str, str]] = REGULATION, recital: str | None = RECITAL, span: int = SPAN) -> DataFrame:
    """lines with path (a struct of each level's number, null where there is none), kind, number and start: of the innermost heading above each line, itself included.

    A heading ends all inner ones above it: their last place is looked at only if
    it comes after that of every outer one. A recital counts as long as no level
    has begun. Lines before any heading have kind null. pos is a number, not null
    and not repeated within a document; null lines are no headings; a null key is
    a document. A document is cut into spans of lines; what a span hands to the next is its
    last heading of each level, one row, so that a long document is spread.
    """
    marks = [*levels, *([("recital", recital)] if recital else [])]
    found = lambda p: F.when(F.col(line).rlike(p), F.struct(F.col(pos).cast("long").alias("at"), F.regexp_extract(line, p, 1).alias("number")))
    own = {f"_{k}": found(p) for k, p in marks} | {"_span": F.floor(F.col(pos) / span)}
    rows = lines.withColumns(own)
    so_far = Window.partitionBy(key, "_span").orderBy(pos)
    before = Window.partitionBy("_key").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_own")).agg(*[F.max(f"_{k}").alias(f"_{k}_end") for k, _ in marks])
    ends = ends.select("_key", "_own", *[F.max(f"_{k}_end").over(before).alias(f"_{k}_before") for k, _ in marks])
    # places grow, so the largest struct is the last heading: last() without its nulls, by a running maximum
    rows = rows.withColumns({f"_{k}_last": F.max(f"_{k}").over(so_far) for k, _ in marks})
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_own")))
    last = {k: F.coalesce(f"_{k}_last", f"_{k}_before") for k, _ in marks}
    valid: dict[str, Column] = {}
    outer: list[Column] = []
    for k, _ in levels:
        ok = reduce(lambda a, b: a & b, [F.coalesce(last[k]["at"] > o["at"], F.lit(True)) for o in outer], last[k].isNotNull())
        valid[k] = F.when(ok, last[k])
        outer.append(last[k])
    if recital:
        valid["recital"] = F.when(F.coalesce(*outer).isNull(), last["recital"])
    inner = F.coalesce(*[F.when(valid[k].isNotNull(), F.struct(F.lit(k).alias("kind"), valid[k]["number"].alias("number"), valid[k]["at"].alias("at"))) for k in [*[k for k, _ in reversed(levels)], *(["recital"] if recital else [])]])
    new = {"path": F.struct(*[valid[k]["number"].alias(k) for k, _ in marks]), "kind": inner["kind"], "number": inner["number"], "start": inner["at"]}
    return rows.select(*[c for c in lines.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def heading_chunks(lines: DataFrame, key: str, pos: str, line: str, levels: list[tuple[str, str]] = REGULATION, recital: str | None = RECITAL, span: int = SPAN) -> DataFrame:
    """key, metadata (struct of kind, number, path, pos), chunk: the text under each heading up to the next one, heading included.

    What stands before any heading is a chunk of kind null. One article is one
    row, so it is held whole; a document is not.
    """
    placed = with_path(lines, key, pos, line, levels, recital, span)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(line), F.lit("")).alias("l")))), lambda x: x["l"]), "\n")
    chunks = placed.groupBy(key, "start").agg(text.alias("chunk"), F.first("kind").alias("kind"), F.first("number").alias("number"), F.first("path").alias("path"))
    return chunks.select(key, F.struct("kind", "number", "path", F.col("start").alias("pos")).alias("metadata"), "chunk")


def count_check(chunks: DataFrame, key: str, kind: str, stated: DataFrame) -> DataFrame:
    """key, stated, found, agrees: how many chunks of a kind a document has, against what is stated (key, stated) of it. Documents on one side alone do not agree."""
    found = chunks.where(F.col("metadata.kind") == kind).groupBy(key).agg(F.count("*").alias("found"))
    both = stated.select(key, "stated").join(found, key, "full")
    return both.select(key, "stated", "found", F.coalesce(F.col("stated") == F.col("found"), F.lit(False)).alias("agrees"))
