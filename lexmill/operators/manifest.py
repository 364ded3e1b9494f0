"""Manifest operators: an append-only change log read by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume_key(file_url: Column, item_url: Column) -> Column:
    """The file's URL, or else the item's."""
    return F.coalesce(F.nullif(F.trim(file_url), F.lit("")), F.nullif(F.trim(item_url), F.lit("")), F.lit(""))


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row for each key."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def first_by_sha(rows: DataFrame, sha: str, order: list[str], complete: Column) -> DataFrame:
    """The first complete row for each content hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.where(complete).groupBy(sha).agg(F.min_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def changes(rows: DataFrame, key: str, sha: str, order: list[str], ids: str) -> DataFrame:
    """``duplicate_status`` and ``duplicate_of`` of each row.

    New content under a known key is ``updated_asset``; content that another key
    brought first is ``alias_same_source``.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.groupBy(sha).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(ids).alias("i")), F.struct(*order)).alias("__f"))
    at = rows.withColumns({"__psha": F.lag(sha).over(w), "__pid": F.lag(ids).over(w)}).join(first, sha)
    updated = F.col("__psha").isNotNull() & (F.col("__psha") != F.col(sha))
    alias = F.col("__f.k") != F.col(key)
    return at.withColumns({
        "duplicate_status": F.when(updated, "updated_asset").when(alias, "alias_same_source").otherwise(""),
        "duplicate_of": F.when(updated, F.col("__pid")).when(alias, F.col("__f.i")),
    }).drop("__psha", "__pid", "__f")


def without_equivalents(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates (``key``, ``path``, ``sha``) without an equivalent row: equal keys, or equal paths of rows that both have or lack a key, or equal paths and hashes.

    The alternatives are separate anti-joins on equal columns instead of one
    nested loop over an OR.
    """
    keyed = lambda d: d.withColumn("__has", F.col("key") != "")
    c, r = keyed(candidates), keyed(rows)
    c = c.join(r.where("key <> ''").select("key").distinct(), "key", "left_anti")
    c = c.join(r.where("path <> ''").select("path", "__has").distinct(), ["path", "__has"], "left_anti")
    return c.join(r.where("path <> '' and sha <> ''").select("path", "sha").distinct(), ["path", "sha"], "left_anti").drop("__has")


def catalog(rows: DataFrame, path: str, order: list[str], prior: DataFrame | None = None, source: str = "source_id") -> DataFrame:
    """The first row of each path; sources without any row keep their prior catalog rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    found = rows.where(F.col(path) != "").groupBy(path).agg(F.min_by(row, F.struct(*order)).alias("__r")).select("__r.*")
    if prior is None:
        return found
    return found.unionByName(prior.join(rows.select(source).distinct(), source, "left_anti"))


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Assets by extraction status; unknown ones are pending."""
    s = F.trim(F.coalesce("extract_status", F.lit("")))
    known = {"done": "done", "failed": "failed", "deferred": "deferred", "missing_asset": "missing_assets"}
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_assets"), *[F.count_if(s == k).alias(v) for k, v in known.items()], F.count_if(~s.isin(list(known))).alias("pending"))


def missing_breakdown(rows: DataFrame, stem: str, by: list[str]) -> DataFrame:
    """Missing assets whose sibling of one stem is done, and those that need a new crawl."""
    stems = rows.groupBy(*by, stem).agg(
        F.max((F.col("extract_status") == "done").cast("int")).alias("done"), F.count_if(F.col("extract_status") == "missing_asset").alias("missing"))
    return stems.groupBy(*by).agg(
        F.sum(F.when(F.col("done") == 1, F.col("missing")).otherwise(0)).alias("stale_sibling_missing"),
        F.sum(F.when(F.col("done") == 0, F.col("missing")).otherwise(0)).alias("needs_recrawl"))


def extract_gate(counts: DataFrame, max_failed: int | None = None, stale_ok: bool = False, deferred_only_ok: bool = False, unexpected: Column | None = None) -> DataFrame:
    """Health, reason and quality gate from a row of counts (with ``needs_recrawl``, ``processed_files``, ``logical_done``)."""
    unexpected = F.lit(0) if unexpected is None else unexpected
    over = F.lit(False) if max_failed is None else F.col("failed") > max_failed
    stale = (F.col("missing_assets") > 0) & F.lit(stale_ok) & (F.col("needs_recrawl") == 0)
    reason = (
        F.when(F.col("pending") > 0, "pending_assets_remaining").when(stale, "stale_missing_asset_rows_present").when(F.col("missing_assets") > 0, "missing_assets_present")
        .when(unexpected > 0, "unexpected_deferred_assets").when(over, "failed_assets_over_limit").when(F.col("processed_files") != F.col("logical_done"), "processed_manifest_mismatch")
        .when((F.col("done") == 0) & F.lit(deferred_only_ok) & (F.col("deferred") > 0), "backlog_only_deferred_assets").when(F.col("done") == 0, "no_done_assets").otherwise("ok"))
    at = counts.withColumn("extract_health_reason", reason)
    passed = F.col("extract_health_reason").isin("ok", "backlog_only_deferred_assets")
    return at.withColumn("extract_health_passed", passed).withColumn("quality_gate_status", F.when(passed, "go").otherwise("hold"))


def parity(left: DataFrame, right: DataFrame, ids: str) -> DataFrame:
    """One row: sizes of two id sets, what each lacks, and the verdict."""
    a = left.groupBy(ids).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(ids).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, ids, "full").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"), F.count_if(F.col("b").isNull()).alias("missing_right"), F.count_if(F.col("a").isNull()).alias("missing_left"))
    same = (F.col("missing_left") == 0) & (F.col("missing_right") == 0) & (F.col("left_rows") == F.col("right_rows"))
    return both.withColumn("status", F.when(same, "match").otherwise("mismatch"))


def aligned(ids: DataFrame, others: dict[str, DataFrame], key: str, pos: str) -> DataFrame:
    """For each artefact: missing, extra and misplaced ids against the id list."""
    out = None
    base = ids.select(F.col(key).alias("k"), F.col(pos).alias("p"))
    for name, df in others.items():
        o = df.select(F.col(key).alias("k2"), F.col(pos).alias("p2"))
        row = base.join(o, F.col("k") == F.col("k2"), "full").agg(
            F.count_if(F.col("k2").isNull()).alias("missing"), F.count_if(F.col("k").isNull()).alias("extra"), F.count_if(F.col("p") != F.col("p2")).alias("misplaced")).withColumn("artefact", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
