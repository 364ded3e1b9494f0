"""Sinks and publication: every write is one job and atomic by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, overwriting."""
    df.write.mode("overwrite").json(path)


def manifest(df: DataFrame, path: str) -> None:
    """A manifest as CSV, overwriting."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def split_folders(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split; rows are gathered by split and salted, so that no split is one task's."""
    df.repartition(F.col(split), F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(16))).write.mode("overwrite").partitionBy(split).parquet(path)


def release_key(source: Column, doc_id: Column, row: Column, kind: str) -> Column:
    """Dedup key of a record: none, doc_id, or source and doc_id; without an id each row is its own."""
    own = F.when(F.trim(T.blank(doc_id)) == "", F.concat(F.lit("row:"), row.cast("string"))).otherwise(F.trim(doc_id))
    if kind == "none":
        return F.concat_ws("\x01", T.blank(source), F.concat(F.lit("row:"), row.cast("string")))
    return own if kind == "doc_id" else F.concat_ws("\x01", T.blank(source), own)


def build_release(parts: dict[str, DataFrame], kind: str = "source_doc_id") -> DataFrame:
    """All sources in order, ``source_id`` filled in, the first row for each key, with ``is_valid``; invalid rows stay.

    Parts have ``doc_id, title, body, source_name, doc_type, audience, trust_tier, source_id`` and a row number ``pos``.
    """
    whole = None
    for i, (source, part) in enumerate(parts.items()):
        part = part.withColumns({"__part": F.lit(i), "source_id": F.coalesce(F.nullif(F.trim(T.blank(F.col("source_id"))), F.lit("")), F.lit(source))})
        whole = part if whole is None else whole.unionByName(part)
    key = release_key(F.col("source_id"), F.col("doc_id"), F.concat_ws(":", "__part", "pos"), kind)
    row = F.struct(*[F.col(f"`{c}`") for c in whole.columns])
    first = whole.groupBy(key.alias("__k")).agg(F.min_by(row, F.struct("__part", "pos")).alias("__r")).select("__r.*")
    c = F.col
    errors = P.record_errors(c("doc_id").cast("string"), c("title"), c("body"), c("source_name"), c("doc_type"), c("audience"), c("trust_tier"))
    return first.withColumn("is_valid", F.size(errors) == 0).drop("__part")


def safe_name(source: Column, path: Column) -> Column:
    """Source, a safe stem of up to 80 signs, ten digits of the path's SHA-1, suffix."""
    name = F.regexp_extract(T.blank(path), r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), r"[^\p{L}\p{N}\-_.]", "_"), r"^[._]+|[._]+$", "")
    stem = F.when(F.char_length(stem) > 80, F.regexp_replace(F.substring(stem, 1, 80), r"[._\-]+$", "")).otherwise(stem)
    return F.concat(source, F.lit("__"), stem, F.lit("__"), F.substring(F.sha1(path), 1, 10), F.when(suffix == "", ".txt").otherwise(suffix))


def upsert(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows after an upsert by key: of new rows with one key the last, and current rows without a new one."""
    row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    last = new.groupBy(key).agg(F.max_by(row, F.col(order)).alias("__r")).select("__r.*")
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def create_table(df: DataFrame, name: str) -> None:
    """An empty table with the rows' schema, if there is none."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.limit(0).write.saveAsTable(name)


def export_checks(chunks: DataFrame, required: list[str], ids: str = "id", text: str = "text") -> DataFrame:
    """K11, H111: one row: chunks, repeated ids, empty texts and missing values for each required column."""
    empty = lambda c: F.trim(T.blank(F.col(c).cast("string"))) == ""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"), (F.count(F.lit(1)) - F.count_distinct(ids)).alias("duplicate_ids"), F.count_if(empty(text)).alias("empty_texts"),
        *[F.count_if(empty(c)).alias(f"missing_{c}") for c in required])


def promote(records: DataFrame, gate: DataFrame, path: str, allow_fail: bool = False) -> bool:
    """Records of sources whose gate passed replace the target; with a failed gate the target is emptied."""
    passed = allow_fail or not gate.where("extract_health_passed").isEmpty()
    (records if passed else records.limit(0)).write.mode("overwrite").parquet(path)
    return passed
