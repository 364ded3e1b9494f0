"""Gold set: split quotas, costs and rarity, JSON line summaries, key signatures, joins of releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
SPLITS = {"dev": 64, "test": 20, "holdout": 18}
WEIGHTS = {"query_type": 1.2, "answerability": 1.3, "difficulty": 1.1, "topic": 1.0, "hard_bucket": 2.2}
# ----------------------------------------------------------------------------


def categories() -> Column:
    """Array of (category, value) of a gold row."""
    hard = F.when(F.col("difficulty") == "hard", "hard").otherwise("non_hard")
    return F.array(*[F.struct(F.lit(c).alias("category"), (hard if c == "hard_bucket" else F.col(c)).alias("value")) for c in WEIGHTS])


def _counts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.explode(categories()).alias("x")).groupBy(*more, "x.category", "x.value").agg(F.count(F.lit(1)).alias("n"))


def expected_counts(rows: DataFrame, splits: dict[str, int] | None = None) -> DataFrame:
    """(split, category, value, expected): each category's count times the split's share."""
    sizes = SPLITS if splits is None else splits
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(k).alias("size")) for s, k in sizes.items()]))
    # every row has one value in each category, so a category's counts add up to the number of rows
    total = F.sum("n").over(Window.partitionBy("category"))
    return _counts(rows).withColumn("total", total).select("*", each.alias("s")).select("s.split", "category", "value", (F.col("n") * (F.col("s.size") / F.col("total"))).alias("expected"))


def _weight(category: str = "category") -> Column:
    return F.element_at(F.create_map(*[x for c, w in WEIGHTS.items() for x in (F.lit(c), F.lit(w))]), F.col(category))


def total_penalty(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(penalty): weighted squares of what the splits of ``rows(split, ...)`` hold beside what is expected."""
    seen = _counts(rows, "split")
    both = expected.join(seen, ["split", "category", "value"], "full")
    gap = F.coalesce("n", F.lit(0)) - F.coalesce("expected", F.lit(0.0))
    return both.agg(F.coalesce(F.sum(_weight() * gap * gap), F.lit(0.0)).alias("penalty"))


def split_costs(rows: DataFrame, assigned: DataFrame, expected: DataFrame, splits: dict[str, int] | None = None) -> DataFrame:
    """(query_id, split, cost) of putting each row into each split, given the rows already ``assigned``; a full split costs infinity."""
    sizes = SPLITS if splits is None else splits
    fill = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("held"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(k).alias("size")) for s, k in sizes.items()]))
    at = rows.withColumn("x", F.explode(categories())).withColumn("s", each).select("query_id", "s.split", "s.size", "x.category", "x.value")
    at = at.join(_counts(assigned, "split").withColumnRenamed("n", "now"), ["split", "category", "value"], "left").join(expected, ["split", "category", "value"], "left").join(fill, "split", "left")
    now, want, held = F.coalesce("now", F.lit(0)), F.coalesce("expected", F.lit(0.0)), F.coalesce("held", F.lit(0))
    step = _weight() * ((now + 1 - want) * (now + 1 - want) - (now - want) * (now - want))
    cost = at.groupBy("query_id", "split").agg(F.sum(step).alias("c"), F.max(held).alias("held"), F.max("size").alias("size"))
    return cost.select("query_id", "split", F.when(F.col("held") >= F.col("size"), float("inf")).otherwise(F.col("held") / F.col("size") * 0.15 + F.col("c")).alias("cost"))


def rarity(rows: DataFrame) -> DataFrame:
    """Each row with how often its combination, topic, difficulty, answerability and hard bucket occur; joins of counts, no window over a hot value."""
    hard = F.when(F.col("difficulty") == "hard", "hard").otherwise("non_hard")
    at = rows.withColumn("hard_bucket", hard)
    for name, keys in {"combo_n": ["query_type", "answerability", "difficulty", "topic"], "topic_n": ["topic"], "difficulty_n": ["difficulty"], "answerability_n": ["answerability"], "hard_n": ["hard_bucket"]}.items():
        at = at.join(at.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
    return at.select("query_id", "combo_n", "topic_n", "difficulty_n", "answerability_n", "hard_n")


def summarize_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: records, lines that are no JSON, distinct and repeated document ids of a JSON lines file."""
    at = lines.where(F.trim(F.col(line)) != "").select(F.try_parse_json(line).alias("v"))
    at = at.select(F.col("v").isNull().alias("bad"), F.trim(F.coalesce(F.try_variant_get("v", "$.doc_id", "string"), F.lit(""))).alias("d"))
    ids = at.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    named = F.col("d") != ""
    return ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_json_lines"),
                   F.count(F.when(named, 1)).alias("doc_id_count"), F.coalesce(F.sum(F.when(named, F.col("n") - 1)), F.lit(0)).alias("duplicate_doc_ids"))


def key_signatures(records: DataFrame, json_col: str) -> DataFrame:
    """(keys, n): the distinct sorted key sets of JSON objects."""
    keys = F.array_join(F.array_sort(F.json_object_keys(json_col)), ",")
    return records.where(F.json_object_keys(json_col).isNotNull()).groupBy(keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def merge_releases(parts: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """The union of releases; fails where an id occurs twice, without collecting ids."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    once = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    return out.withColumn("__ok", F.assert_true(once, F.lit("an id occurs twice"))).where("__ok IS NULL").drop("__ok")


def selected(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """J04, H112: the chunks whose title or document id is among ``keys(title, doc_id)``; two semi-joins, each chunk once."""
    titles = keys.where("title <> ''").select(F.col("title").alias("__t")).distinct()
    docs = keys.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__d")).distinct()
    by_title = chunks.join(titles, chunks["title"] == F.col("__t"), "left_semi")
    rest = chunks.join(titles, F.coalesce(chunks["title"], F.lit("")) == F.col("__t"), "left_anti").join(docs, chunks["doc_id"] == F.col("__d"), "left_semi")
    return by_title.unionByName(rest)


def title_index(rows: DataFrame, key: Column) -> DataFrame:
    """(title_key, urls, source_url, specialty, doc_type) per title: distinct addresses and the commonest values, the first seen of equals."""
    at = rows.select(key.alias("title_key"), "pos", "source_url", "specialty", "doc_type").where("title_key <> ''")
    out = at.groupBy("title_key").agg(F.array_sort(F.collect_set(F.when(F.col("source_url") != "", F.col("source_url")))).alias("urls"))
    for c in ("source_url", "specialty", "doc_type"):
        each = at.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy("title_key", c).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
        out = out.join(each.groupBy("title_key").agg(F.max_by(c, F.struct("n", -F.col("p"))).alias(c)), "title_key", "left")
    return out


def backfill_urls(rows: DataFrame, index: DataFrame, key: Column) -> DataFrame:
    """Rows without an address take the one of their title, where the title has exactly one; ``backfilled`` tells which."""
    one = index.where(F.size("urls") == 1).select(F.col("title_key").alias("__k"), F.element_at("urls", 1).alias("__u"))
    at = rows.withColumn("__key", key).join(one, F.col("__key") == F.col("__k"), "left")
    empty = F.coalesce(F.col("source_url"), F.lit("")) == ""
    return at.withColumns({"backfilled": empty & F.col("__u").isNotNull(), "source_url": F.when(empty, F.coalesce("__u", F.lit(""))).otherwise(F.col("source_url"))}).drop("__key", "__k", "__u")


def metric_differences(base: DataFrame, other: DataFrame, key: str = "metric") -> DataFrame:
    """Two runs' metrics side by side with their difference; a metric of one run alone has no difference."""
    return base.select(key, F.col("value").alias("base")).join(other.select(key, F.col("value").alias("candidate")), key, "full").withColumn("difference", F.col("candidate") - F.col("base"))
