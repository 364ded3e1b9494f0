"""Quality reports: each is one pass of conditional counts, never a loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T


def _valid() -> Column:
    return ~P.missing(F.col("title")) & ~P.missing(F.col("body")) & F.col("trust_tier").isin(P.TRUST_TIERS)


def validation_stats(records: DataFrame) -> DataFrame:
    """Total and valid records by source and tier."""
    return records.groupBy("source_name", "trust_tier").agg(F.count(F.lit(1)).alias("total"), F.count_if(_valid()).alias("valid"))


def distributions(records: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column and in all, in one pass by grouping sets."""
    sets = [[F.col(c)] for c in columns] + [[]]
    level = F.grouping_id(*columns).alias("level")
    return records.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), level)


def reason_counts(records: DataFrame, reasons: Column, by: str) -> DataFrame:
    """how often each reason holds, by a column."""
    return records.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))


def content_report(records: DataFrame) -> DataFrame:
    """One row of issue counts over bodies and titles."""
    b, n = F.col("body"), F.char_length("body")
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n < 100).alias("too_short"), F.count_if(n > 10000).alias("too_long"),
        F.count_if(T.noise_ratio(b) > 0.15).alias("high_noise"), F.count_if(T.sentence_repetition(b) > 0.3).alias("sentence_repetition"),
        F.count_if(P.navigation_text(b)).alias("navigation_text"), F.count_if(P.mixed_topics(F.col("title"), b)).alias("mixed_topics"),
        (F.count(F.lit(1)) - F.count_distinct(T.body_hash(b))).alias("cross_doc_duplicate"), F.round(F.avg(n), 6).alias("mean_length"))


def chunk_hash(c: Column) -> Column:
    return F.substring(T.stable_text_hash(c), 1, 16)


def first_owner(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The document and place where each chunk's text comes first; joined back, as a common chunk would fill a window.

    The rows are dealt by document before, so that the join and the aggregate
    read one exchange and the chunks are cut once.
    """
    at = chunks.withColumn("__h", chunk_hash(F.col("chunk"))).repartition(F.col(id_col), F.col("chunk_index"))
    first = at.groupBy("__h").agg(F.min(F.struct(id_col, "chunk_index")).alias("__o"))
    return at.join(first, "__h").withColumns({"owner": F.col(f"__o.{id_col}"), "owner_index": F.col("__o.chunk_index")}).drop("__h", "__o")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row of issue counts over chunks."""
    c, t = F.col("chunk"), F.greatest(F.lit(1), F.floor(F.char_length("chunk") / 4))
    has = lambda x: F.contains(F.lower(c), F.lower(F.col(x)))
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(~has("title") & ~has("source_name")).alias("missing_provenance"),
        F.count_if(~F.contains(c, F.lit("Title:")) & ~F.contains(c, F.lit("Source:"))).alias("missing_context_header"),
        F.count_if(P.truncated_list(c)).alias("truncated_list"), F.count_if(P.truncated_table(c)).alias("truncated_table"),
        F.count_if(t < 50).alias("extremely_short"), F.count_if(t > 500).alias("extremely_long"),
        (F.count(F.lit(1)) - F.count_distinct(chunk_hash(c))).alias("duplicate_chunks"), F.round(F.avg(t), 6).alias("mean_tokens"))


def composite(stats: DataFrame, content: DataFrame, chunks: DataFrame) -> DataFrame:
    """Schema 40 %, content 35 %, chunks 25 %; from three one-row reports."""
    s = stats.agg(F.sum("total").alias("n"), (F.sum("total") - F.sum("valid")).alias("errors"))
    issues = sum((F.col(c) for c in ("too_long", "high_noise", "sentence_repetition", "navigation_text", "mixed_topics", "cross_doc_duplicate")), F.col("too_short"))
    rate = lambda a, b: F.round(a / F.greatest(F.lit(1), b) * 100, 1)
    one = F.lit(1).alias("__j")
    row = s.select("*", one).join(F.broadcast(content.select("*", one)), "__j").join(F.broadcast(chunks.select("*", one)), "__j")
    row = row.select(
        F.greatest(F.lit(0), 100 - F.col("errors") / F.greatest(F.lit(1), F.col("n")) * 100).alias("a"), F.greatest(F.lit(0), 100 - rate(issues, F.col("total"))).alias("b"),
        F.greatest(F.lit(0), 100 - (rate(F.col("duplicate_chunks"), F.col("total_chunks")) + rate(F.col("missing_provenance"), F.col("total_chunks")))).alias("c"))
    row = row.withColumn("total_score", F.round(F.col("a") * 0.40 + F.col("b") * 0.35 + F.col("c") * 0.25, 1))
    verdict = F.when(F.col("total_score") >= 80, "GO").when(F.col("total_score") >= 60, "WARN").otherwise("NO-GO")
    return row.select(F.round("a", 1).alias("schema_score"), F.round("b", 1).alias("content_score"), F.round("c", 1).alias("chunk_score"), "total_score", verdict.alias("verdict"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row for each key; combined on the map side."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def unique_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids made unique by ``_1``, ``_2`` behind later arrivals."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn("unique_id", F.when(F.col("__n") == 0, F.col(id_col)).otherwise(F.concat_ws("_", id_col, "__n"))).drop("__n")
