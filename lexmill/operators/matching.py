"""Manifest rows for processed files: by name or by the long number that names, titles and addresses end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import BAD_TITLES, hex_tail, marker_text, needs_cleanup, title_candidate
from ..functions.curation import processed_stem
from ..functions.text import blank, let
from .extraction import SUFFIXES


def row_url(item_url: Column, file_url: Column, parent_url: Column) -> Column:
    """A manifest row's address: of the item, the file or the parent item."""
    t = lambda c: F.trim(blank(c))
    return F.when(t(item_url) != "", t(item_url)).when(t(file_url) != "", t(file_url)).otherwise(t(parent_url))


def row_score(title: Column, url: Column, status: Column, path: Column, notes: Column) -> Column:
    """How far a manifest row can be trusted for title and address."""
    add = lambda rule, n: F.when(F.coalesce(rule, F.lit(False)), n).otherwise(0)
    other = (add(blank(url) != "", 80) + add(F.trim(blank(status)) == "done", 10) + add(blank(path).startswith("sources/"), 5)
             + add(F.contains(blank(notes), F.lit("bootstrapped_from_existing_raw")), -25) + add(F.contains(blank(notes), F.lit("bootstrapped_from_corpus_catalog")), -15))
    said = lambda h: let(F.struct(needs_cleanup(h).alias("c"), marker_text(h).isin(BAD_TITLES).alias("b")), lambda x: (
        F.when(h == "", 0).when(~x["c"], 60).otherwise(10) + add(x["b"], -50) + add(x["c"], -10)))
    return other + let(title_candidate(title), said)


def manifest_index(manifest: DataFrame) -> DataFrame:
    """(source_id, kind, key, row): each row of a manifest under its stem and its long numbers.

    ``manifest(source_id, position, relative_path, content_class, title_hint,
    item_url, file_url, parent_item_url, extract_status, notes)``; ``row`` holds
    its place, score, title and address. Rows without a path aren't found; a
    number that several fields end with counts once.
    """
    c = F.col
    path = F.trim(blank(c("relative_path")))
    url = row_url(c("item_url"), c("file_url"), c("parent_item_url"))
    row = F.struct(row_score(c("title_hint"), url, c("extract_status"), c("relative_path"), c("notes")).alias("score"), c("position"), title_candidate(c("title_hint")).alias("title"), url.alias("url"))
    stem = processed_stem(path, c("content_class"), SUFFIXES)
    numbers = F.filter(F.array_distinct(F.array(hex_tail(stem), hex_tail(path), hex_tail(c("title_hint")), hex_tail(c("item_url")))), lambda x: x != "")
    keys = F.concat(F.array(F.struct(F.lit("stem").alias("kind"), stem.alias("key"))), F.transform(numbers, lambda x: F.struct(F.lit("number").alias("kind"), x.alias("key"))))
    return manifest.where(path != "").select("source_id", row.alias("row"), keys.alias("ks")).select("source_id", "row", F.explode("ks").alias("k")).select("source_id", "k.kind", "k.key", "row")


def best_manifest_rows(files: DataFrame, index: DataFrame) -> DataFrame:
    """``files(source_id, file, ...)`` plus ``match`` (score, position, title, url) and ``n_candidates``.

    A file's candidates have its stem, or the number that its stem ends with.
    The best has the highest score; of equal ones a match by stem goes first,
    then the row that stands first. Files are distinct; one without a candidate has a null match and 0.
    Two equi-joins and one aggregation that combines before it shuffles.
    """
    stem = F.regexp_replace(F.regexp_extract(blank(F.col("file")), r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")
    both = F.array(F.struct(F.lit("stem").alias("kind"), stem.alias("key")), F.struct(F.lit("number").alias("kind"), hex_tail(stem).alias("key")))
    wanted = files.select("source_id", "file", both.alias("ks")).select("source_id", "file", F.explode("ks").alias("k")).select("source_id", "file", "k.*").where("key <> ''")
    found = wanted.join(index, ["source_id", "kind", "key"]).groupBy("source_id", "file", "row").agg(F.max(F.col("kind") == "stem").alias("by_stem"))
    rank = F.struct(F.col("row.score"), F.col("by_stem"), -F.col("row.position"))
    best = found.groupBy("source_id", "file").agg(F.max_by("row", rank).alias("match"), F.count(F.lit(1)).alias("n_candidates"))
    return files.join(best, ["source_id", "file"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
