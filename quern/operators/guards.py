"""Input and output guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quern.functions.text import INJECTIONS, matches_any
from quern.sources.tables import small_batches


def injection(rows: DataFrame, text: str, patterns: list[str] = INJECTIONS) -> DataFrame:
    """rows with flagged: whether the text tries to turn a model against its instructions."""
    return rows.withColumn("flagged", matches_any(F.col(text), patterns))


def unknown_citations(cited: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Citations of what does not exist; null citations are unknown."""
    return cited.join(known.select(on).distinct(), on, "left_anti")


def blocked_answers(answers: DataFrame, key: str, citations: str, known: DataFrame, on: str) -> DataFrame:
    """key, on: each citation of an answer that does not exist, once. Null citations are unknown; null and empty lists cite nothing."""
    cited = answers.select(key, F.explode(citations).alias(on)).distinct()
    return unknown_citations(cited, known, on).select(key, on)


def get_articles(articles: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """The articles that are asked for by equality, each once however often it is asked for; null asks for nothing."""
    return articles.join(asked.select(on).distinct(), on, "left_semi")


def in_scope(column: Column, scope: list) -> Column:
    """Whether a value is one of the scope; false for null."""
    return F.coalesce(column.isin(scope), F.lit(False))


def valid_answers(rows: DataFrame, payload: str, schema: str, required: Callable[[Column], Column]) -> DataFrame:
    """rows with parsed and valid: whether the JSON fits the schema and what is required holds."""
    parsed = rows.withColumn("parsed", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("valid", F.coalesce(required(F.col("parsed")), F.lit(False)))


def checked(rows: DataFrame, payload: str, schema: str, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """rows with parsed (null where refused) and reason (null where accepted).

    In this order: `absent` (a null payload), `malformed` (no JSON), `mistyped` (JSON
    that does not fit the schema), and the name of the first rule that does not
    hold, null counting as broken. The payload stays as it came.
    """
    typed = F.from_json(payload, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = rows.withColumn("_read", typed)
    reason = F.when(F.col(payload).isNull(), "absent").when(F.try_parse_json(payload).isNull(), "malformed").when(F.col("_read._corrupt").isNotNull(), "mistyped")
    for name, rule in rules.items():
        reason = reason.when(~F.coalesce(rule(F.col("_read")), F.lit(False)), name)
    told = read.withColumn("reason", reason)
    return told.withColumn("parsed", F.when(F.col("reason").isNull(), F.col("_read").dropFields("_corrupt"))).drop("_read")


def quarantine(told: DataFrame, payload: str, path: str) -> None:
    """The rows of checked() in two sinks by one pass: path/outcome=accepted, without the payload, and path/outcome=refused, with the payload as it came and its reason."""
    outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("refused")
    rows = told.withColumn("outcome", outcome).withColumn(payload, F.when(F.col("reason").isNotNull(), F.col(payload)))
    rows.write.partitionBy("outcome").mode("errorifexists").parquet(path)


def with_model(rows: DataFrame, text: str, name: str, model: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """rows with what an injected model says of a text: a guard, an embedder, a router or a judge. It gets and returns a Series, nulls included; a column of that name gives way. It gets batches of a bounded size, however long the texts are."""
    small_batches(rows.sparkSession)
    kept, field = [c for c in rows.columns if c != name], StructType.fromDDL(f"_v {kind}")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.Array.from_pandas(model(batch.column(batch.num_columns - 1).to_pandas()), type=to_arrow_type(field.dataType))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], said], [*kept, name])

    schema = StructType([*[rows.schema[c] for c in kept], StructField(name, field.dataType)])
    return rows.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def route(text: Column, rules: list[tuple[str, str]], neither: str = "out_of_scope", several: str = "both") -> Column:
    """The label whose pattern occurs; `several` if more than one does, `neither` if none does or the text is null."""
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules]), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, neither).when(F.size(hits) > 1, several).otherwise(F.get(hits, 0))
