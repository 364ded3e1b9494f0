"""Sharding by jump consistent hashing, with gapless slots.

The shard of a key comes from the key and the shard count alone (Lamping and
Veach, "A fast, minimal memory, consistent hash algorithm"): no ring table, and
one more shard takes rows from every other shard only into itself. Everything
is a Spark SQL expression; 64-bit products are built from 32-bit halves, as SQL
arithmetic does not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, key_of, packed, row_hash

#: Multiplier of the generator in the published algorithm.
LCG = 2862933555777941757
_M32 = (1 << 32) - 1
#: Numbering groups in each shard: the first hex digits of an id's MD5.
DIGITS = 3


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of (x * LCG + 1) mod 2**64, from the halves of x."""
    b = [LCG >> 16 * i & 0xFFFF for i in range(4)]
    low = lo * b[0] + F.shiftleft(((lo * b[1]).bitwiseAND(0xFFFF)), 16) + 1
    high = (
        F.shiftright(low, 32) + F.shiftright(lo * b[1], 16) + lo * b[2] + F.shiftleft((lo * b[3]).bitwiseAND(0xFFFF), 16)
        + hi * b[0] + F.shiftleft((hi * b[1]).bitwiseAND(0xFFFF), 16)
    )
    return high.bitwiseAND(_M32), low.bitwiseAND(_M32)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard, 0 to ``shards`` - 1, of a 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def leap(x: Column, _: Column) -> Column:
        hi, lo = _step(x["hi"], x["lo"])
        j = F.floor((x["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(x["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), x["j"].alias("b"), j.alias("j"))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, leap)["b"].cast("int")


def place(df: DataFrame, id_col: str, shards: int, order: list[str] | None = None) -> DataFrame:
    """``df`` plus ``shard``, ``slot`` (0, 1, ... in each shard) and ``grown_shard`` (with one shard more).

    Ids are integers; a null id is the key -2**63. Slots follow the MD5 of the
    id (of the row's hash if the id is null), then the id, ``order`` and the
    row's hash. They are numbered in groups of a shard and the first digits of
    that MD5, whose sizes give each group its first slot; no task sees a whole
    shard. A column that carries an output's name comes back with ``_input``
    behind it. Repeated rows get a slot each. An empty table gives an empty result.
    """
    mine = row_hash(df)
    text = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("null "), mine.cast("string")))
    at = df.select(packed(df.columns, ["shard", "slot", "grown_shard"]), key_of(id_col).alias("k"), F.md5(text).alias("h"),
                   F.struct(*[column(c) for c in order or []], mine.alias("__mine")).alias("o"))
    at = at.withColumns({"shard": jump_hash(F.col("k"), shards), "grown_shard": jump_hash(F.col("k"), shards + 1), "g": F.substring("h", 1, DIGITS)})
    sizes = at.groupBy("shard", "g").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "g").orderBy("h", "k", "o")
    numbered = at.withColumn("i", F.row_number().over(within)).join(first, ["shard", "g"])
    return numbered.select("r.*", "shard", "grown_shard", (F.col("first") + F.col("i") - 1).cast("long").alias("slot"))
