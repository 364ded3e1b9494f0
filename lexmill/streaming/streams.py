"""Structured Streaming forms of the change log, sessions and request metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import bucket


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Events from files that arrive in a folder; a trigger takes all that are there, or ``per_trigger`` files, if their order is that of the events."""
    reader = spark.readStream.schema(schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def request_metrics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window, type and latency bucket; events later than the watermark are dropped, state is bounded by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type", bucket(F.col("value")).alias("le")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "le", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions, closed once the watermark passes their gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the resume check of a crawl as stateful dedup."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _detect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one key with their change status; the state is the last content hash and its row.

    A key's rows of one trigger come in several frames, in no order, and are put
    in order together.
    """
    if state.hasTimedOut:
        state.remove()
        return
    b = pd.concat([x[["ts", "event_id", "key", "sha"]] for x in batches], ignore_index=True)
    if not len(b):
        return
    b = b.sort_values(["ts", "event_id"], ignore_index=True)
    sha, of = b["sha"].astype("Int64"), b["event_id"].astype("Int64")
    last = state.get if state.exists else (None, None)
    before, row = sha.shift(1), of.shift(1)
    before[0], row[0] = (pd.NA if x is None else x for x in last)
    changed = (before != sha).fillna(False).astype(bool)
    yield pd.DataFrame({"event_id": of, "key": b["key"], "duplicate_status": changed.map({True: "updated_asset", False: ""}), "duplicate_of": row.where(changed)})
    state.update(tuple(None if pd.isna(x) else int(x) for x in (sha.iloc[-1], of.iloc[-1])))


def change_detection(log: DataFrame) -> DataFrame:
    """``log(event_id, ts, key, sha)`` with each row's change status, by keyed state.

    Rows of one trigger are taken in the order of their times, whatever files they come from; triggers in theirs.
    """
    return log.groupBy("key").applyInPandasWithState(
        _detect, "event_id long, key long, duplicate_status string, duplicate_of long", "sha long, event_id long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop; reruns go on behind the checkpoint."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
