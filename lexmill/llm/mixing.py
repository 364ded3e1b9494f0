"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by the MD5 of their id; a document's
virtual finish time is the tokens of its source up to its end, divided by the
source's target. A source may be gone through several times, up to a cap. In
the order of virtual finish time all sources advance at their weights, and the
total budget is reached at virtual time 1, so a document is taken if more than
half of it lies before that time; the cut needs no global running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, cut, packed, row_hash

#: No source is gone through more often than this.
MOST_PASSES = 3
#: Shuffle groups of a source: the first hex digits of the order hash.
DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes(__src, source_size)``, a row for each source, plus ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn and share
    the total of all sizes by them. No target exceeds MOST_PASSES times its
    source's size; what is over goes to the rest by weight. With sources sorted
    by cap per weight the level that the others reach is the largest of
    (total - caps before) / (weights from here on).
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("__src").asc_nulls_last())) - 1) % len(weights)) + 1)
    rows = sizes.withColumn("weight", w).withColumn("__cap", F.col("source_size") * MOST_PASSES)
    rows = rows.withColumn("__r", F.col("__cap").cast("double") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("__r", F.col("__src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(upto), F.lit(0))).cast("double")
    over = (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).cast("double")
    rows = rows.withColumn("__level", left / over).withColumn("__level", F.max("__level").over(everything))
    target = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("weight"))
    return rows.select("__src", "source_size", "weight", target.alias("target"))


def _plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], keep: list[str], outputs: tuple[str, ...]) -> DataFrame:
    """(r, i, src, size, source_size, target, passes, start) for each document; ``r`` holds the columns to keep."""
    mine = row_hash(docs)
    base = docs.select(
        packed(keep, outputs), column(id_col).alias("i"), column(source_col).alias("src"), n_words(column(text_col)).alias("size"), mine.alias("o"),
        F.md5(F.coalesce(column(id_col).cast("string"), F.concat(F.lit("null "), mine.cast("string")))).alias("h"),
    ).withColumn("g", F.substring("h", 1, DIGITS))
    if text_col not in keep:
        base = cut(base)  # narrow, and read three times below
    groups = cut(base.groupBy("src", "g").agg(F.sum("size").alias("n")))
    goal = targets(groups.groupBy(F.col("src").alias("__src")).agg(F.sum("n").alias("source_size")), weights)
    before = Window.partitionBy("src").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("src", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    plan = first.join(goal, first["src"].eqNullSafe(goal["__src"])).select(first["src"].alias("s"), first["g"].alias("b"), "first", "source_size", "target")
    within = Window.partitionBy("src", "g").orderBy("h", "size", "o").rowsBetween(Window.unboundedPreceding, 0)
    at = base.withColumn("end", F.sum("size").over(within))
    at = at.join(plan, at["src"].eqNullSafe(plan["s"]) & (at["g"] == plan["b"]))
    start = F.col("first") + F.col("end") - F.col("size")
    taken = [F.when(2 * (F.col("source_size") * e + start) + F.col("size") <= 2 * F.col("target"), 1).otherwise(0) for e in range(MOST_PASSES)]
    return at.select("r", "i", "src", "o", "size", "source_size", "target", F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0).alias("passes"), start.alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (1, 2, 3), carry: list[str] | None = None) -> DataFrame:
    """A row for each document: ``carry`` columns, ``size``, ``source_size``, ``target``, ``passes`` and ``start``.

    ``passes`` is how often the mix takes the document, 0 to MOST_PASSES, always
    whole. A null source is a source of its own; a null id is ordered by the
    row's hash; empty texts have size 0 and a place in the order. Rows equal in
    id and size are ordered by a hash of all their columns, so reruns agree;
    rows equal in everything are told apart by a gapless order and may get
    different passes, which the mix as a whole can't show. A carried column with
    an output's name comes back with ``_input`` behind it. An empty table gives
    an empty result.
    """
    names = ("size", "source_size", "target", "passes", "start")
    return _plan(docs, id_col, source_col, text_col, weights, [id_col] if carry is None else carry, names).select("r.*", *names)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: ``docs`` with each document as often as it is taken, range-sorted by virtual finish time.

    All columns, whatever their names, come back as they were. Nulls, ties,
    repeated rows and empty tables are treated as by ``mix``.
    """
    rows = _plan(docs, id_col, source_col, text_col, weights, docs.columns, ()).where("passes > 0")
    rows = rows.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    finish = (F.col("source_size") * F.col("e") + F.col("start") + F.col("size")) / F.col("target")
    return rows.withColumn("f", finish).orderBy("f", "src", "i", "o").select("r.*")
