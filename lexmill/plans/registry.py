"""Registered queries over the driver's tables, with their SQL.

Queries are named by what they compute, behind the id of the operator in the
survey. Documents stand in for records: the first line, cut at 80 signs, is the
title, the text the body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The same records in SQL.
REC = """rec AS (
  SELECT doc_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, coalesce(text, '') AS body,
    source AS source_name, lang AS language, n_chars, (doc_id % 3 + 1)::INT AS trust_tier FROM documents
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, 80).alias("title"), body.alias("body"),
        F.col("source").alias("source_name"), F.col("lang").alias("language"), "n_chars", (F.col("doc_id") % 3 + 1).cast("int").alias("trust_tier"))


def register(name: str, sql: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) -> DataFrame with its SQL."""

    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def scalar(name: str, columns: dict[str, tuple[Callable[[], Column], str]], base: dict[str, Callable[[], Column]] | None = None) -> None:
    """Registers a projection of the records: column -> (expression, SQL); ``base`` holds columns that several expressions share.

    Expressions are callables, as columns can't be built before there is a session.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).withColumns({k: c() for k, c in (base or {}).items()}).select("doc_id", *[c().alias(k) for k, (c, _) in columns.items()])

    register(name, f"WITH {REC} SELECT doc_id, " + ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items()) + " FROM rec")(query)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval for the benchmark items over all documents."""
    from . import load

    load()
    return QUERIES["l01_lexical_top_k"](spark, sf_dir)
