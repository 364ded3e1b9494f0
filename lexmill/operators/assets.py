"""Versions of downloaded assets, and copies of files into a new layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curation import bounded_filename


# ------------------------------------------------------------------ versions
def asset_name(hint: Column, extension: Column, stamp: Column | None = None) -> Column:
    """The file name of a download: its hint with the extension, bounded; with a stamp behind the stem for a later version."""
    ext = F.regexp_extract(hint, r"(?<=[^./])(\.[^./]+)$", 1)
    own = F.when(F.coalesce(extension, F.lit("")) != "", extension).otherwise(ext)
    dotted = F.when((own != "") & ~own.startswith("."), F.concat(F.lit("."), own)).otherwise(own)
    stem = F.when(ext != "", F.left(hint, F.char_length(hint) - F.char_length(ext))).otherwise(hint)
    first = F.concat(stem, dotted)
    if stamp is None:
        return bounded_filename(first)
    end = F.regexp_extract(bounded_filename(first), r"(?<=[^./])(\.[^./]+)$", 1)
    base = F.left(bounded_filename(first), F.char_length(bounded_filename(first)) - F.char_length(end))
    return bounded_filename(F.concat(base, F.lit("__"), F.regexp_replace(stamp, "[-:]", ""), end))


def append_versions(versions: DataFrame, downloads: DataFrame) -> DataFrame:
    """The versions with those of ``downloads`` behind them.

    ``versions(source_id, asset, name, sha256, downloaded_at)``, ``downloads(
    source_id, filename_hint, extension, sha256, downloaded_at)``. An asset's
    first version has its plain name, a later one a name with its time; what is
    there already (asset, time and content) isn't appended again, so a run that
    is repeated changes nothing. Versions are never rewritten. The first version
    is told by a minimum an asset, not by numbering its rows.
    """
    plain = downloads.select("source_id", asset_name(F.col("filename_hint"), F.col("extension")).alias("asset"), asset_name(F.col("filename_hint"), F.col("extension"), F.col("downloaded_at")).alias("stamped"), "sha256", "downloaded_at").distinct()
    key = ["source_id", "asset"]
    new = plain.join(versions.select(*key, "sha256", "downloaded_at"), [*key, "sha256", "downloaded_at"], "left_anti")
    first = versions.groupBy(*key).agg(F.lit(True).alias("known")).join(new.groupBy(*key).agg(F.min(F.struct("downloaded_at", "sha256")).alias("least")), key, "right")
    plainly = F.col("known").isNull() & (F.struct("downloaded_at", "sha256") == F.col("least"))
    named = new.join(first, key).select(*key, F.when(plainly, F.col("asset")).otherwise(F.col("stamped")).alias("name"), "sha256", "downloaded_at")
    return versions.select(*key, "name", "sha256", "downloaded_at").unionByName(named)


def as_of(versions: DataFrame, time: Column) -> DataFrame:
    """The version of each asset that was the last one at a time; assets that came later have none."""
    return versions.where(F.col("downloaded_at") <= time).groupBy("source_id", "asset").agg(F.max_by(F.struct("name", "sha256", "downloaded_at"), F.struct("downloaded_at", "sha256")).alias("v")).select("source_id", "asset", "v.*")


# ------------------------------------------------------------------ copies
def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder of any file system, each read by the task that hashes it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def migration(tasks: DataFrame, files: DataFrame, execute: bool = False, overwrite: bool = False) -> DataFrame:
    """``tasks(source, destination, ...)`` plus what is done with each: ``action``, hashes before and after, bytes.

    ``files(path, bytes, sha256)`` are the files there are, on both sides.
    Action: missing_source, skip_same_hash, conflict (another content is there
    and may not be overwritten), overwrite or copy, with ``would_`` before the
    last two in a dry run.
    """
    a = files.select(F.col("path").alias("source"), F.col("bytes").alias("__bytes"), F.col("sha256").alias("source_sha256"))
    b = files.select(F.col("path").alias("destination"), F.col("sha256").alias("__there"))
    at = tasks.join(a, "source", "left").join(b, "destination", "left")
    have, there = F.col("source_sha256").isNotNull(), F.col("__there").isNotNull()
    act = lambda name: F.lit(name if execute else f"would_{name}")
    action = (F.when(~have, "missing_source").when(there & (F.col("__there") == F.col("source_sha256")), "skip_same_hash")
              .when(there, act("overwrite") if overwrite else F.lit("conflict")).otherwise(act("copy")))
    written = action.isin("copy", "overwrite")
    after = F.when(~have, "").when(written, F.col("source_sha256")).otherwise(F.coalesce("__there", F.lit("")))
    return at.select(*[F.col(f"`{c}`") for c in tasks.columns], action.alias("action"), F.coalesce("source_sha256", F.lit("")).alias("source_sha256"),
                     after.alias("destination_sha256"), F.coalesce("__bytes", F.lit(0)).cast("long").alias("bytes"), (there | written).alias("destination_exists"))


def migrated(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files after a migration's copies: an upsert by path, so the same migration finds nothing more to do."""
    new = done.where(F.col("action").isin("copy", "overwrite")).groupBy(F.col("destination").alias("path")).agg(F.min(F.struct("bytes", F.col("source_sha256").alias("sha256"))).alias("x")).select("path", "x.*")
    return files.join(new.select("path"), "path", "left_anti").unionByName(new)


def migration_summary(done: DataFrame) -> DataFrame:
    """How many tasks met each action, and their bytes."""
    return done.groupBy("action").agg(F.count(F.lit(1)).alias("tasks"), F.sum("bytes").alias("bytes"))
