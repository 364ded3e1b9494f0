"""Duplicate grouping, keep-best dedup and blocked title similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GENERIC = ["bookshelf", "general", "reference", ""]


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """A01, exact and near stage: ``is_duplicate_suspect``, ``duplicate_group_id`` and ``duplicate_reason``.

    A row with a body that others have is exact; of the rest, rows whose
    fingerprint others have (exact ones included) are near. The group is named
    by its least id. Both counts come from map-side combined aggregates that are
    joined back, so a huge group doesn't gather in one task. A body has one
    fingerprint, so fingerprints are counted over the distinct bodies.
    """
    body = F.col(body_col)
    exact = df.groupBy(T.body_sha(body).alias("__x")).agg(F.count(F.lit(1)).alias("__xn"), F.min(id_col).alias("__xm"), F.min(T.fingerprint(body)).alias("__f"))
    near = exact.groupBy("__f").agg(F.sum("__xn").alias("__fn"), F.min(F.when(F.col("__xn") == 1, F.col("__xm"))).alias("__fm"))
    at = df.withColumn("__x", T.body_sha(body)).join(exact.join(near, "__f"), "__x")
    x, f = F.col("__xn") > 1, F.col("__fn") > 1
    return at.withColumns({
        "is_duplicate_suspect": x | f,
        "duplicate_group_id": F.when(x, F.concat(F.lit("exact_"), F.col("__xm"))).when(f, F.concat(F.lit("near_"), F.col("__fm"))),
        "duplicate_reason": F.when(x, "exact_body_match").when(f, "fingerprint_match"),
    }).drop("__x", "__f", "__xn", "__xm", "__fn", "__fm")


def duplicate_report(groups: DataFrame) -> DataFrame:
    """Totals, rate and the five per cent gate."""
    rate = F.round(F.count_if("is_duplicate_suspect") / F.greatest(F.lit(1), F.count(F.lit(1))) * 100, 1)
    return groups.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("is_duplicate_suspect").alias("duplicate_suspects"), rate.alias("duplicate_rate"),
        F.count_distinct("duplicate_group_id").alias("duplicate_groups")).withColumn("gate_passed", F.col("duplicate_rate") <= 5)


def richness(*fields: Column) -> Column:
    """Number of fields that say something."""
    return sum((~F.lower(T.blank(f)).isin(GENERIC)).cast("int") for f in fields[1:]) + (~F.lower(T.blank(fields[0])).isin(GENERIC)).cast("int")


def keep_best(df: DataFrame, key: Column, rank: Column, pos: str) -> DataFrame:
    """One row for each key: the best rank, the first of equals.

    ``max_by`` over a struct combines on the map side, where a window would
    gather all copies of a key in one task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(key.alias("__k")).agg(F.max_by(row, F.struct(rank.alias("r"), (-F.col(pos)).alias("p"))).alias("__r"))
    return best.select("__r.*")


def merge_sources(parts: list[DataFrame], key: list[str], pos: str) -> DataFrame:
    """All rows of all parts, the first for each key in order of the parts."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    row = F.struct(*[F.col(f"`{c}`") for c in whole.columns])
    return whole.groupBy(*key).agg(F.min_by(row, F.struct("__part", pos)).alias("__r")).select("__r.*").drop("__part")


def title_pairs(df: DataFrame, id_col: str, title_col: str, least: float = 0.85) -> DataFrame:
    """Pairs of titles with Levenshtein ratio above ``least``, without comparing all pairs.

    With ratio above t the distance is below (1 - t) * longest, so of the
    title cut into that many pieces plus one, one piece occurs unchanged in the
    other title, shifted by no more than the distance. Titles are cut by a
    length class; pieces of every possible place are the join keys. Equal
    titles are joined once.
    """
    t = F.lower(F.trim(T.blank(F.col(title_col))))
    rows = df.select(F.col(id_col).alias("id"), t.alias("t")).where("t <> ''").withColumn("n", F.char_length("t"))
    titles = rows.groupBy("t", "n").agg(F.count(F.lit(1)).alias("c"))
    slack = 1 - least

    def cuts(c: Column, n: Column) -> Column:
        """Pieces (length class, number, text) of a title as the shorter one of a pair."""
        d = F.floor(n * slack / least).cast("int") + 1
        return F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substring(c, F.floor(i * n / (d + 1)).cast("int") + 1, F.floor((i + 1) * n / (d + 1)).cast("int") - F.floor(i * n / (d + 1)).cast("int")).alias("p")))

    def places(c: Column, n: Column) -> Column:
        """Every piece that a shorter or equally long title could share with this one."""
        low = F.ceil(n * least).cast("int")

        def of(m: Column) -> Column:
            d = F.floor(m * slack / least).cast("int") + 1

            def piece(i: Column) -> Column:
                at, size = F.floor(i * m / (d + 1)).cast("int"), F.floor((i + 1) * m / (d + 1)).cast("int") - F.floor(i * m / (d + 1)).cast("int")
                return F.transform(F.sequence(F.greatest(F.lit(0), at - d), F.least(n - size, at + d)), lambda s: F.struct(m.alias("n"), i.alias("i"), F.substring(c, s + 1, size).alias("p")))

            usable = F.filter(F.sequence(F.lit(0), d), lambda i: F.floor(i * m / (d + 1)).cast("int") - d <= n - (F.floor((i + 1) * m / (d + 1)).cast("int") - F.floor(i * m / (d + 1)).cast("int")))
            return F.flatten(F.transform(usable, piece))

        return F.flatten(F.transform(F.sequence(low, n), of))

    left = titles.select(F.col("t").alias("a"), F.explode(F.array_distinct(cuts(F.col("t"), F.col("n")))).alias("k"))
    right = titles.select(F.col("t").alias("b"), F.explode(F.array_distinct(places(F.col("t"), F.col("n")))).alias("k"))
    near = left.join(right, "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.withColumn("ratio", T.levenshtein_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") > least)
    same = titles.where("c > 1").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("ratio"))
    return near.unionByName(same)
