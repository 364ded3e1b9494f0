"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_hit(ranked: DataFrame, by: list[str], hit: str = "hit") -> DataFrame:
    """Rank of the first hit for each query, null without one."""
    return ranked.groupBy(*by).agg(F.min(F.when(F.col(hit), F.col("rank"))).alias("first_rank"))


def hit_metrics(first: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Hit@1, @3, @5 and MRR for each grouping set, in one pass."""
    columns = sorted({c for s in sets for c in s})
    r = F.col("first_rank")
    at = lambda k: F.round(F.avg((F.coalesce(r, F.lit(1 << 30)) <= k).cast("int")) * 100, 4)
    return first.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("queries"), at(1).alias("hit1"), at(3).alias("hit3"), at(5).alias("hit5"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"))


def split_summary(scored: DataFrame, split: str, score: str, passed: str) -> DataFrame:
    """Mean score and pass rate by split and in all."""
    return scored.rollup(split).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(passed).cast("int")), 6).alias("pass_rate"))


def boundary_percentiles(df: DataFrame, column: str) -> DataFrame:
    """Exact tenth, fiftieth and ninetieth percentile."""
    return df.agg(*[F.percentile(column, p / 100).alias(f"p{p}") for p in (10, 50, 90)])


def slowest(df: DataFrame, column: str, ids: str, n: int = 15) -> DataFrame:
    """The n largest, a top-k report."""
    return df.orderBy(F.desc(column), F.asc(ids)).limit(n)


def quota_sample(df: DataFrame, kind: str, target: int, ids: str, most_borderline: float = 0.15, seed: int = 42) -> DataFrame:
    """``target`` rows in hash order: borderline ones up to a share, high ones for the rest, refilled by borderline ones."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ids).cast("string")))
    n = df.where(F.col(kind).isin("high", "borderline")).groupBy(kind).count()
    sizes = {r[kind]: r["count"] for r in n.collect()}
    border = min(int(target * most_borderline), sizes.get("borderline", 0))
    high = target - border
    if high > sizes.get("high", 0):
        high = sizes.get("high", 0)
        border = min(sizes.get("borderline", 0), target - high)
    pick = lambda k, m: df.where(F.col(kind) == k).orderBy(key, ids).limit(m)
    return pick("high", high).unionByName(pick("borderline", border))


def cap_per_group(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def stratified_split(df: DataFrame, strata: list[str], ids: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """L08 at scale: ``split`` by place in hash order within each stratum, so every stratum has the target shares.

    The place is a row number within (stratum, first hash digits) plus that
    group's offset, so that a stratum with most of the rows isn't one task's.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ids).cast("string")))
    at = df.withColumn("__h", key).withColumn("__g", F.substring("__h", 1, 2))
    groups = at.groupBy(*strata, "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*strata, "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.sum("__n").over(Window.partitionBy(*strata)).alias("__all"))
    row = F.row_number().over(Window.partitionBy(*strata, "__g").orderBy("__h", ids)) - 1
    at = at.withColumn("__i", row).join(groups, [*strata, "__g"])
    place = (F.col("__o") + F.col("__i")) * 100 / F.col("__all")
    total, split = 0, None
    for name, share in shares.items():
        total += share
        split = F.when(place < total, name) if split is None else split.when(place < total, name)
    return at.withColumn("split", split).drop("__h", "__g", "__i", "__o", "__all", "__n")


def category_report(df: DataFrame, split: str, categories: list[str]) -> DataFrame:
    """Counts by split and each category, in one pass."""
    sets = [[F.col(split), F.col(c)] for c in categories]
    return df.groupingSets(sets, F.col(split), *[F.col(c) for c in categories]).agg(F.count(F.lit(1)).alias("n"))
