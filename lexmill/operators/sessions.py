"""Conversation history, query rewriting and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the latency histogram.
EDGES = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 50.0, 100.0]


def history(turns: DataFrame, n: int = 4) -> DataFrame:
    """The n messages before each one, oldest first, as ``history``."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def rewrite(turns: DataFrame, words: int = 8) -> DataFrame:
    """User messages with the first words of the user's previous message in front."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    hint = F.array_join(F.slice(F.filter(F.split(F.col("__last"), r"\s+"), lambda x: x != ""), 1, words), " ")
    at = turns.withColumn("__last", last).where("role = 'user'")
    return at.withColumn("rewritten", F.when(F.coalesce("__last", F.lit("")) == "", F.col("text")).otherwise(F.concat(F.lit("Regarding "), hint, F.lit(": "), F.col("text")))).drop("__last")


def listing(turns: DataFrame) -> DataFrame:
    """Sessions with their title (start of the first user message), messages and last turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 50)), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(first.alias("title"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


def bucket(value: Column, edges: list[float] = EDGES) -> Column:
    """Least edge that a value doesn't exceed; infinity above all."""
    out = F.lit(float("inf"))
    for e in reversed(edges):
        out = F.when(value <= e, F.lit(e)).otherwise(out)
    return out


def histogram(events: DataFrame, by: list[str], value: str, edges: list[float] = EDGES) -> DataFrame:
    """Counts by latency bucket."""
    return events.groupBy(*by, bucket(F.col(value), edges).alias("le")).agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, width: str, by: list[str]) -> DataFrame:
    """Events and mean value in each window of event time; for batches and streams alike."""
    return events.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).withColumn("start", F.col("window.start")).drop("window")


def user_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, closed by a gap in event time."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
