"""Chunk export as a stream: records from files that arrive, chunked without state, with ids made unique in bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions.predicates import noise_chunk, passes_gate, record_errors
from ..functions.scores import ingest_quality
from ..operators import structure

RECORD = (
    "doc_id string, article_id string, title string, canonical_title string, section_title string, body string, source_name string, source_url string, language string, "
    "doc_type string, audience string, trust_tier int, updated_at string, heading_path string"
)
CHUNK = "id string, doc_id string, article_id string, title string, section_title string, section_type string, chunk_role string, heading_path string, chunk_index int, quality_status string, text string, seen_at timestamp, source_file string"

_NAMES = [c.split()[0] for c in CHUNK.split(", ")]


def record_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Records of JSON lines files that arrive in a folder, with the file's name and time."""
    at = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", per_trigger).json(folder)
    return at.select("*", F.col("_metadata.file_modification_time").alias("seen_at"), F.col("_metadata.file_name").alias("source_file"))


def chunk_records(records: DataFrame, least_status: str = "hold") -> DataFrame:
    """Chunks of valid records that pass the quality gate, without reference chunks; no state, so it serves batches and streams alike.

    The canonical title goes before the title; an article without an id has its
    document's. Invalid records give no row. ``id`` may repeat.
    """
    c = F.col
    good = records.where(F.size(record_errors(c("doc_id"), c("title"), c("body"), c("source_name"), c("doc_type"), c("audience"), c("trust_tier"))) == 0)
    name = lambda x: F.trim(T.blank(c(x)))
    titled = good.withColumn("__title", F.when(name("canonical_title") != "", name("canonical_title")).when(T.blank(c("canonical_title")) != "", c("title")).otherwise(F.when(name("title") != "", name("title")).otherwise(c("title"))))
    article = F.when(name("article_id") != "", name("article_id")).when(name("doc_id") != "", name("doc_id")).otherwise(T.slug(c("__title"), 80))
    sections = structure.sections(c("body"))
    quality = ingest_quality(c("__title"), c("body"), c("source_url"), c("source_name"), c("language"), c("doc_type"), F.size(sections), F.lit(False))
    gated = titled.withColumns({"__article": article, "__status": quality["status"]}).where(passes_gate(c("__status"), least_status))
    parts = structure.chunks(gated, title="__title", updated=c("updated_at"), audience=c("audience"))
    path = c("heading_path")
    named = parts.toDF(*gated.columns, "chunk_index", "__path", "chunk").withColumn(
        "__section", F.when(c("__path") != "", F.trim(F.element_at(F.split(c("__path"), " > "), -1))).otherwise(F.trim(T.blank(c("section_title")))))
    kind = T.section_type(c("__section"))
    kept = named.withColumn("__kind", kind).where(~noise_chunk(c("__kind"), T.strip_context_header(c("chunk"))))
    slug = F.when(c("__section") != "", c("__section")).otherwise(F.when(T.blank(c("section_title")) != "", c("section_title")).otherwise("main"))
    return kept.select(
        T.stable_id(c("source_name"), c("doc_id"), slug, c("chunk_index")).alias("id"), "doc_id", c("__article").alias("article_id"), c("__title").alias("title"), c("__section").alias("section_title"),
        c("__kind").alias("section_type"), T.chunk_role(c("__kind")).alias("chunk_role"), F.when(c("__path") != "", c("__path")).otherwise(path).alias("heading_path"),
        c("chunk_index").cast("int").alias("chunk_index"), c("__status").alias("quality_status"), c("chunk").alias("text"), "seen_at", "source_file")


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one id, the later ones with their number behind it; the state is how many there were. A group may come in several batches; none is held."""
    if state.hasTimedOut:
        state.remove()
        return
    seen, latest = state.get[0] if state.exists else 0, 0
    for rows in batches:
        latest = max(latest, int(rows["__ms"].max()))
        rows = rows[_NAMES].copy()
        rows["id"] = [i if n == 0 else f"{i}_{n}" for n, i in enumerate(rows["id"], seen)]
        seen += len(rows)
        yield rows
    state.update((seen,))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), latest) + _KEPT_MS)


#: How long an id is remembered behind the time it last came at, by the watermark.
_KEPT_MS = 24 * 3600 * 1000


def export_chunks(records: DataFrame, least_status: str = "hold", repeats: str = "number", late: str = "1 day") -> DataFrame:
    """The chunks of a stream of records, each with an id of its own.

    ``repeats``: ``number`` gives an id that came before ``_1``, ``_2`` and so on,
    in the order of arrival; ``drop`` lets only the first through. What is
    remembered of an id is one number, and goes a day after it was last seen
    (``number``) or ``late`` behind the watermark (``drop``), so the state is
    bounded by the ids of that time. Chunks of one micro-batch with one id are
    numbered in no set order.
    """
    chunks = chunk_records(records, least_status).withWatermark("seen_at", late)
    if repeats == "drop":
        return chunks.dropDuplicatesWithinWatermark(["id"])
    if repeats != "number":
        raise ValueError("repeats is number or drop")
    numbered = chunks.withColumns({"__id": F.col("id"), "__ms": F.unix_millis("seen_at")}).groupBy("__id").applyInPandasWithState(_number, CHUNK, "n long", "append", GroupStateTimeout.EventTimeTimeout)
    return numbered
