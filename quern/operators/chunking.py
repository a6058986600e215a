"""Structural chunks with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk(docs: DataFrame, key: str, text: str, before: str, title: str) -> DataFrame:
    """key, pos, chunk, title, n_chars: a text cut where `before` (a lookahead pattern) matches; empty chunks go, positions stay.

    title is what the pattern's first group finds in the chunk, or the empty
    text. Null texts have no chunks.
    """
    parts = docs.select(key, F.posexplode(F.split(text, before)).alias("pos", "chunk")).where("length(chunk) > 0")
    return parts.select(key, "pos", "chunk", F.regexp_extract("chunk", title, 1).alias("title"), F.length("chunk").alias("n_chars"))
