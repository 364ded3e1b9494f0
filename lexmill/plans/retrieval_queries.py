"""Retrieval, evaluation, manifest and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import evaluation, manifest, retrieval, sessions
from .registry import REC, records, register, scalar, table
from .text_queries import first_distinct, fold_d, grams, lexical_ordered, quoted, sq, title_norm

_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))"
_DENSE = f"""dense AS (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE score >= 0.25) WHERE rank <= 10)"""


def _dense(spark: SparkSession, sf_dir: str, k: int = 10, threshold: float = 0.25) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_top_k(queries, vectors, k, threshold)


@register("v02_cosine_top_k", f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 9) AS score, rank FROM dense")
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 9))


@register("v06_label_hit_rate", f"""WITH {_DENSE}, h AS (SELECT query_id, min(CASE WHEN a.label = b.label AND a.vec_id <> b.vec_id THEN rank END) AS r FROM dense
  JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = dense.vec_id GROUP BY query_id)
SELECT count(*) AS queries, round(avg((coalesce(r, 999) <= 1)::INT) * 100, 4) AS hit1, round(avg((coalesce(r, 999) <= 3)::INT) * 100, 4) AS hit3,
  round(avg((coalesce(r, 999) <= 5)::INT) * 100, 4) AS hit5, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM h""")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _dense(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    hits = hits.withColumn("hit", (F.col("label") == F.col("want")) & (F.col("vec_id") != F.col("query_id")))
    return evaluation.hit_metrics(evaluation.first_hit(hits, ["query_id"]), [[]])


_LEXQ = lexical_ordered("text")
_HAY = "title || ' ' || source_name || ' ' || left(body, 800)"
_CRIT = quoted(retrieval.CRITICAL_TERMS)
_LEXICAL = f"""q AS (SELECT item_id AS query_id, text, {fold_d('text')} AS q_norm, list_distinct({_LEXQ}) AS qt, {_LEXQ} AS lo,
  list_distinct(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '[A-Z][A-Z0-9]{{1,6}}')), lambda v: lower(v))) AS acr FROM benchmark),
qp AS (SELECT *, ({first_distinct('list_concat(' + ', '.join(grams('lo', n) for n in (5, 4, 3, 2)) + ')')})[:24] AS ph FROM q),
a AS (SELECT doc_id AS article_id, {fold_d(_HAY)} AS h_norm, list_distinct({lexical_ordered(_HAY)}) AS ht, list_distinct({lexical_ordered('title')}) AS tt, {fold_d('title')} AS t_norm FROM rec),
p AS (SELECT *, len(list_intersect(qt, ht)) AS overlap, list_intersect(list_intersect(qt, ht), {_CRIT}) AS cr,
  string_split(regexp_replace(h_norm, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' ') AS hw FROM qp, a WHERE len(list_intersect(qt, ht)) > 0),
lex AS (SELECT query_id, article_id, round((overlap * 0.08 + 0.28 * len(cr) + CASE WHEN list_has_any(cr, {quoted(retrieval.CRITICAL_ENTITY)}) THEN 1.0 ELSE 0 END
  + least(0.06 * len(list_intersect(qt, tt)), 0.36) + coalesce(list_sum(list_transform(ph, lambda x: CASE WHEN contains(h_norm, x) THEN CASE WHEN len(string_split(x, ' ')) >= 3 THEN 0.16 ELSE 0.08 END ELSE 0 END)), 0)
  + CASE WHEN t_norm <> '' AND contains(q_norm, t_norm) THEN 0.8 ELSE 0 END + CASE WHEN len(acr) > 0 THEN 0.24 * len(list_filter(acr, lambda x: list_contains(hw, x))) / len(acr) ELSE 0 END)::DOUBLE, 4) AS score FROM p),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM lex) WHERE rank <= 10)"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.concat_ws(" ", "title", "source_name", F.substring("body", 1, 800))
    return records(spark, sf_dir).select(F.col("doc_id").alias("article_id"), "title", hay.alias("haystack"))


def _lexical(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_top_k(queries, _articles(spark, sf_dir), k)


@register("l01_lexical_top_k", f"WITH {REC}, {_LEXICAL} SELECT query_id, article_id, score, rank FROM top")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


@register("c08_lexical_score_summary", f"WITH {REC}, {_LEXICAL} SELECT query_id, count(*) AS candidates, max(score) AS best FROM lex WHERE score > 0 GROUP BY query_id")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_scores(queries, _articles(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.max("score").alias("best"))


# hits of one query per source: a document's score follows from its id
_HIT = "hits AS (SELECT source_name AS query_id, doc_id, title, body, (doc_id * 37 % 101) / 100.0::DOUBLE AS score, greatest(1, len(body) // 4) AS tokens FROM rec)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("source_name").alias("query_id"), "doc_id", "title", "body", (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("score"), F.greatest(F.lit(1), F.floor(F.char_length("body") / 4)).cast("long").alias("tokens"))


@register("a20_group_articles", f"""WITH {REC}, {_HIT} SELECT query_id, {title_norm('title')} AS title_norm, max(score) AS max_score, round(avg(score), 9) AS avg_score, count(*) AS chunk_count,
  arg_min(title, struct_pack(w := (len(trim(title)) < 15 OR regexp_matches(trim(title), '^\\p{{Ll}}'))::INT, l := -len(title), t := title)) AS title FROM hits GROUP BY 1, 2""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.group_articles(_hits(spark, sf_dir), ["query_id"]).withColumn("avg_score", F.round("avg_score", 9))


_KW = "list_filter(list_distinct(string_split({}, ' ')), lambda v: len(v) > 1)"


@register("l02_rerank_articles", f"""WITH {REC}, {_HIT}, g AS (SELECT query_id, {title_norm('title')} AS tn, max(score) AS s, count(*) AS n, max(title) AS title FROM hits GROUP BY 1, 2)
SELECT query_id, title, round((s + CASE WHEN len({_KW.format(title_norm("'the of and re ' || query_id"))}) > 0 THEN len(list_intersect({_KW.format(title_norm("'the of and re ' || query_id"))}, {_KW.format(title_norm('title'))})) / len({_KW.format(title_norm("'the of and re ' || query_id"))}) ELSE 0 END * 0.06
  + least(n / 10, 1.0) * 0.02 - CASE WHEN len(title) < 20 THEN 0.03 WHEN len(title) < 35 THEN 0.01 ELSE 0 END)::DOUBLE, 6) AS reranked FROM g""")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _hits(spark, sf_dir).groupBy("query_id", T.title_norm(F.col("title")).alias("tn")).agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("chunk_count"), F.max("title").alias("title"))
    return g.select("query_id", "title", F.round(retrieval.rerank(g, F.concat(F.lit("the of and re "), F.col("query_id"))), 6).alias("reranked"))


@register("l05_budget_prefix", f"WITH {REC}, {_HIT} SELECT query_id, doc_id FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS t FROM hits) WHERE t <= 2048")
def l05a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.budget_prefix(_hits(spark, sf_dir), ["query_id"], [F.desc("score"), F.asc("doc_id")], F.col("tokens"), 2048).select("query_id", "doc_id")


@register("l05_budget_greedy", f"""WITH RECURSIVE {REC}, {_HIT}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM hits),
f AS (SELECT query_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT query_id FROM hits)
  UNION ALL SELECT f.query_id, o.rn, CASE WHEN f.used + o.tokens <= 2048 THEN f.used + o.tokens ELSE f.used END, CASE WHEN f.used + o.tokens <= 2048 THEN o.doc_id END FROM f JOIN o ON o.query_id = f.query_id AND o.rn = f.rn + 1)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rn) - 1 AS pos FROM f WHERE doc_id IS NOT NULL""")
def l05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("neg", -F.col("score"))
    return retrieval.budget_greedy(hits, ["query_id"], ["neg"], "doc_id", "tokens", 2048).select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))


@register("u02_first_of_text", f"WITH {REC}, {_HIT} SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(lower({sq('body')})) ORDER BY score DESC, doc_id) AS n FROM hits) WHERE n = 1")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_of_text(_hits(spark, sf_dir), ["query_id"], T.stable_text_hash(F.col("body")), [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id")


@register("u03_fallback_union", f"""WITH {REC}, {_HIT}, f AS (SELECT * FROM hits WHERE score >= 0.97), ok AS (SELECT query_id FROM f GROUP BY 1 HAVING count(*) >= 2)
SELECT query_id, doc_id, false AS widened FROM f UNION ALL SELECT query_id, doc_id, true FROM hits WHERE query_id NOT IN (SELECT query_id FROM ok) AND score < 0.97""")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).select("query_id", "doc_id", "score")
    return retrieval.widen(hits.where("score >= 0.97"), hits, "query_id", "doc_id").select("query_id", "doc_id", "widened")


_TN = title_norm("title")
_TB = title_norm("substring(body, 1, 90)")
scalar("j19_title_contains", {"value": (lambda: retrieval.title_contains(T.title_norm(F.col("title")), T.title_norm(F.substring("body", 1, 90))),
    f"""{_TN} <> '' AND {_TB} <> '' AND ({_TN} = {_TB} OR (len({_TN}) >= 15 AND contains({_TB}, {_TN})) OR (len({_TB}) >= 15 AND contains({_TN}, {_TB}))
  OR (len(list_distinct(string_split({_TN}, ' '))) >= 3 AND len(list_distinct(string_split({_TB}, ' '))) >= 3 AND len(list_intersect(list_distinct(string_split({_TN}, ' ')), list_distinct(string_split({_TB}, ' ')))) / least(len(list_distinct(string_split({_TN}, ' '))), len(list_distinct(string_split({_TB}, ' ')))) >= 0.7))""")})

# ------------------------------------------------------------------ evaluation
_FIRST = f"WITH {REC}, {_HIT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits), e AS (SELECT query_id, min(CASE WHEN quality = 0 THEN rank END) AS f FROM r LEFT JOIN labels USING (doc_id) GROUP BY query_id), g AS (SELECT *, left(query_id, 4) AS grp, len(query_id) AS difficulty FROM e)"
_METRICS = "count(*) AS queries, round(avg((coalesce(f, 999999) <= 1)::INT) * 100, 4) AS hit1, round(avg((coalesce(f, 999999) <= 3)::INT) * 100, 4) AS hit3, round(avg((coalesce(f, 999999) <= 5)::INT) * 100, 4) AS hit5, round(avg(coalesce(1 / f, 0)), 6) AS mrr"


@register("a24_gate_metrics", f"{_FIRST} SELECT difficulty, grp, {_METRICS} FROM g GROUP BY GROUPING SETS ((), (difficulty), (grp))")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.ranked(_hits(spark, sf_dir), ["query_id"], [F.desc("score"), F.asc("doc_id")], 1 << 30)
    hits = hits.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("hit", F.col("quality") == 0)
    first = evaluation.first_hit(hits, ["query_id"]).withColumns({"grp": F.substring("query_id", 1, 4), "difficulty": F.char_length("query_id")})
    return evaluation.hit_metrics(first, [[], ["difficulty"], ["grp"]])


@register("a29_split_summary", "SELECT split, count(*) AS rows, round(avg(score), 6) AS mean_score, round(avg((score >= 0.6)::INT), 6) AS pass_rate FROM (SELECT lang AS split, (doc_id % 97) / 97.0::DOUBLE AS score FROM documents) GROUP BY ROLLUP (split)")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), (F.col("doc_id") % 97 / F.lit(97.0)).alias("score")).withColumn("ok", F.col("score") >= 0.6)
    return evaluation.split_summary(scored, "split", "score", "ok")


@register("a26_verdict", "SELECT l_orderkey AS k, CASE WHEN h < 80 OR g > 0 OR h < b - 5 THEN 'ROLLBACK' WHEN h >= b - 3 AND m >= 0.47 AND h >= 85 THEN 'PROMOTE' ELSE 'MANUAL_REVIEW' END AS verdict FROM (SELECT l_orderkey, l_quantity + 55 AS h, l_quantity + 50 + l_linenumber AS b, l_discount * 6 AS m, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS g FROM lineitem)")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    hit = F.col("l_quantity") + 55
    v = S.verdict(F.col("l_quantity") + 50 + F.col("l_linenumber"), hit, F.lit(0.5), F.col("l_discount") * 6, F.when(F.col("l_tax") > 0.07, 1).otherwise(0))
    return x.select(F.col("l_orderkey").alias("k"), v.alias("verdict"))


@register("a38_boundary_percentiles", "SELECT quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM documents")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.boundary_percentiles(table(spark, sf_dir, "documents"), "n_chars")


@register("w16_longest_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.slowest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


_KINDS = "(SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'borderline' WHEN c_acctbal > 0 THEN 'high' ELSE 'reject' END AS kind, md5('42:' || c_custkey) AS h FROM customer)"


@register("l06_quota_sample", f"SELECT c_custkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, c_custkey) AS rn FROM {_KINDS}) WHERE (kind = 'high' AND rn <= 170) OR (kind = 'borderline' AND rn <= 30)")
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_acctbal") > 5000, "borderline").when(F.col("c_acctbal") > 0, "high").otherwise("reject")
    return evaluation.quota_sample(table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind")), "kind", 200, "c_custkey")


@register("l08_stratified_split", """SELECT c_custkey, c_mktsegment, CASE WHEN p < 64 THEN 'dev' WHEN p < 84 THEN 'test' ELSE 'holdout' END AS split FROM
  (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) - 1) * 100 / count(*) OVER (PARTITION BY c_mktsegment) AS p FROM customer)""")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return evaluation.stratified_split(rows, ["c_mktsegment"], "c_custkey", {"dev": 64, "test": 20, "holdout": 16})


@register("l13_cap_per_topic", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 15")
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 15)


@register("a35_category_report", "SELECT c_mktsegment, c_nationkey, c_custkey % 3 AS split, count(*) AS n FROM customer GROUP BY GROUPING SETS ((split, c_mktsegment), (split, c_nationkey))")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.category_report(table(spark, sf_dir, "customer").withColumn("split", F.col("c_custkey") % 3), "split", ["c_mktsegment", "c_nationkey"])


# -------------------------------------------- manifest: events are its log
_LOG = "log AS (SELECT event_id, ts, user_id AS key, floor(value * 10)::BIGINT % 200 AS sha, CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'deferred' WHEN 'signup' THEN 'missing_asset' ELSE '' END AS extract_status, user_id % 40 AS stem, user_id % 5 AS source_id FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "done").when(kind == "click", "failed").when(kind == "purchase", "deferred").when(kind == "signup", "missing_asset").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), (F.floor(F.col("value") * 10).cast("long") % 200).alias("sha"), status.alias("extract_status"), (F.col("user_id") % 40).alias("stem"), (F.col("user_id") % 5).alias("source_id"))


@register("j10_latest_by_key", f"WITH {_LOG} SELECT key, event_id, extract_status FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.latest_by_key(_log(spark, sf_dir), "key", ["ts", "event_id"]).select("key", "event_id", "extract_status")


@register("j11_first_by_sha", f"WITH {_LOG} SELECT sha, event_id FROM log WHERE extract_status = 'done' QUALIFY row_number() OVER (PARTITION BY sha ORDER BY ts, event_id) = 1")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.first_by_sha(_log(spark, sf_dir), "sha", ["ts", "event_id"], F.col("extract_status") == "done").select("sha", "event_id")


@register("z03_change_detection", f"""WITH {_LOG}, l AS (SELECT *, lag(sha) OVER k AS psha, lag(event_id) OVER k AS pid, first_value(key) OVER s AS fk, first_value(event_id) OVER s AS fi FROM log
  WINDOW k AS (PARTITION BY key ORDER BY ts, event_id), s AS (PARTITION BY sha ORDER BY ts, event_id))
SELECT event_id, CASE WHEN psha <> sha THEN 'updated_asset' WHEN fk <> key THEN 'alias_same_source' ELSE '' END AS duplicate_status,
  CASE WHEN psha <> sha THEN pid WHEN fk <> key THEN fi END AS duplicate_of FROM l""")
def z03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.changes(_log(spark, sf_dir), "key", "sha", ["ts", "event_id"], "event_id").select("event_id", "duplicate_status", "duplicate_of")


_CAND = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'k' || o_custkey END AS key, 'p' || (o_orderkey % 900) AS path, 's' || (o_custkey % 50) AS sha FROM orders"
_ROWS = "SELECT CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'k' || c_custkey END AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'p' || (c_custkey % 700) END AS path, 's' || (c_custkey % 60) AS sha FROM customer"


@register("j12_without_equivalents", f"""WITH c AS ({_CAND}), r AS ({_ROWS}) SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE (c.key <> '' AND c.key = r.key)
  OR (c.path <> '' AND c.path = r.path AND (c.key <> '') = (r.key <> '')) OR (c.sha <> '' AND c.sha = r.sha AND c.path <> '' AND c.path = r.path))""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cand = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("k"), "o_custkey")).alias("key"), F.concat(F.lit("p"), F.col("o_orderkey") % 900).alias("path"), F.concat(F.lit("s"), F.col("o_custkey") % 50).alias("sha"))
    rows = c.select(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("k"), "c_custkey")).alias("key"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.col("c_custkey") % 700)).alias("path"), F.concat(F.lit("s"), F.col("c_custkey") % 60).alias("sha"))
    return manifest.without_equivalents(cand, rows).select("id")


@register("k03_catalog", f"WITH {_LOG} SELECT stem, event_id, source_id FROM log QUALIFY row_number() OVER (PARTITION BY stem ORDER BY ts, event_id) = 1")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.catalog(_log(spark, sf_dir).withColumn("path", F.col("stem").cast("string")), "path", ["ts", "event_id"]).select("stem", "event_id", "source_id")


_LAST = f"{_LOG}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)"
_COUNTS = "count(*) AS unique_assets, count_if(extract_status = 'done') AS done, count_if(extract_status = 'failed') AS failed, count_if(extract_status = 'deferred') AS deferred, count_if(extract_status = 'missing_asset') AS missing_assets, count_if(extract_status = '') AS pending"


@register("a12_status_counts", f"WITH {_LAST} SELECT source_id, {_COUNTS} FROM last GROUP BY source_id")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.status_counts(manifest.latest_by_key(_log(spark, sf_dir), "key", ["ts", "event_id"]), ["source_id"])


_MISS = "stems AS (SELECT source_id, stem, max((extract_status = 'done')::INT) AS d, count_if(extract_status = 'missing_asset') AS m FROM last GROUP BY 1, 2), broken AS (SELECT source_id, sum(CASE WHEN d = 1 THEN m ELSE 0 END)::BIGINT AS stale_sibling_missing, sum(CASE WHEN d = 0 THEN m ELSE 0 END)::BIGINT AS needs_recrawl FROM stems GROUP BY 1)"


@register("a14_missing_breakdown", f"WITH {_LAST}, {_MISS} SELECT * FROM broken")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.missing_breakdown(manifest.latest_by_key(_log(spark, sf_dir), "key", ["ts", "event_id"]), "stem", ["source_id"])


@register("a15_extract_gate", f"""WITH {_LAST}, {_MISS}, c AS (SELECT source_id, {_COUNTS} FROM last GROUP BY 1)
SELECT source_id, CASE WHEN pending > 30 THEN 'pending_assets_remaining' WHEN missing_assets > 0 AND needs_recrawl = 0 THEN 'stale_missing_asset_rows_present' WHEN missing_assets > 6 THEN 'missing_assets_present'
  WHEN failed > 5 THEN 'failed_assets_over_limit' WHEN done = 0 THEN 'no_done_assets' ELSE 'ok' END AS extract_health_reason FROM c JOIN broken USING (source_id)""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = manifest.latest_by_key(_log(spark, sf_dir), "key", ["ts", "event_id"])
    counts = manifest.status_counts(last, ["source_id"]).join(manifest.missing_breakdown(last, "stem", ["source_id"]), "source_id")
    # tolerances of this test: 30 pending assets, six missing ones
    counts = counts.withColumns({"pending": F.greatest(F.lit(0), F.col("pending") - 30), "processed_files": F.lit(0), "logical_done": F.lit(0)})
    counts = counts.withColumn("missing_assets", F.when((F.col("missing_assets") > 0) & ((F.col("needs_recrawl") == 0) | (F.col("missing_assets") > 6)), F.col("missing_assets")).otherwise(0))
    return manifest.extract_gate(counts, max_failed=5, stale_ok=True).select("source_id", "extract_health_reason")


@register("j09_parity", "WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT coalesce(sum(a.n), 0)::BIGINT AS left_rows, coalesce(sum(b.n), 0)::BIGINT AS right_rows, count_if(b.doc_id IS NULL) AS missing_right, count_if(a.doc_id IS NULL) AS missing_left, 'mismatch' AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.parity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# ------------------------------------------------------------------- sessions
@register("z11_history", "SELECT conv_id, turn, len(h) AS n, array_to_string(list_transform(coalesce(h, []), lambda x: x.role), ',') AS roles FROM (SELECT conv_id, turn, list({'role': role}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM conversations)".replace("len(h)", "len(coalesce(h, []))"))
def z11(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sessions.history(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda x: x["role"]), ",").alias("roles"))


_HINT = r"array_to_string((list_filter(regexp_split_to_array(prev, '\s+'), lambda w: w <> ''))[:8], ' ')"


@register("c26_rewrite", f"WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations) SELECT conv_id, turn, md5(CASE WHEN coalesce(prev, '') = '' THEN text ELSE 'Regarding ' || {_HINT} || ': ' || text END) AS rewritten FROM p WHERE role = 'user'")
def c26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rewrite(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("rewritten").alias("rewritten"))


@register("h38_session_listing", "SELECT conv_id, arg_min(left(text, 50), turn) FILTER (WHERE role = 'user') AS title, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def h38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.listing(table(spark, sf_dir, "conversations"))


@register("z12_latency_histogram", "SELECT event_type, CASE " + " ".join(f"WHEN value <= {e} THEN {e}" for e in sessions.EDGES) + " ELSE 'inf'::DOUBLE END::DOUBLE AS le, count(*) AS n FROM events GROUP BY ALL")
def z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.histogram(table(spark, sf_dir, "events"), ["event_type"], "value")


@register("z12_tumbling_windows", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start FROM events GROUP BY event_type, start")
def z12w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]).withColumn("start", F.unix_timestamp("start"))


@register("z10_user_sessions", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def z10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.user_sessions(table(spark, sf_dir, "events"), "30 minutes").withColumns({"start": F.unix_timestamp("start"), "end": F.unix_timestamp("end")})
