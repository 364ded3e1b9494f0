"""Bonuses and composite scores of question and article pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as K

from .registry import REC, records, register
from .text_queries import first_distinct, fold, grams, quoted, terms, title_norm

MODES = ["article_centric", "topic_summary", "mechanistic_synthesis"]
TYPES = ["study_result_extraction", "comparative_synthesis", "guideline_comparison", "teaching_explainer", "fact_extraction"]
KINDS = ["guideline", "textbook", "reference", "review", "patient_education", "journal_article", "case_report"]
TITLES = ["Journal of X issue 3", "Tap chi y hoc so dac biet", "plain%20name", "Kết quả nghiên cứu"]
SOURCES = ["kcb_moh", "who", "vmj"]


def _pick(values: list[str], n: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))


def _sql(values: list[str], n: int) -> str:
    return f"{quoted(values)}[(doc_id // {n} % {len(values)} + 1)::INT]"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with a question made of its own words, so that terms and phrases are shared."""
    title = F.when(F.col("doc_id") % 5 == 0, _pick(TITLES, 1)).otherwise(F.col("title"))
    source = F.when(F.col("doc_id") % 4 == 0, _pick(SOURCES, 1)).otherwise(F.col("source_name"))
    query = F.concat(F.substring("body", 20, 60), F.when(F.col("doc_id") % 3 == 0, " MRI HER2").otherwise(""))
    at = records(spark, sf_dir).select("doc_id", title.alias("title"), source.alias("source_name"), "body", "trust_tier", query.alias("query"), _pick(KINDS, 2).alias("doc_type"), _pick(TYPES, 3).alias("query_type"), _pick(MODES, 7).alias("mode"))
    return at.withColumn("meta", K.metadata_text(F.col("title"), F.col("doc_type"), F.col("source_name"), F.when(F.col("doc_id") % 6 == 0, "HER2 panel")))


_P = f"""p0 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {_sql(TITLES, 1)} ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN {_sql(SOURCES, 1)} ELSE source_name END AS source_name, body, trust_tier,
  substring(body, 20, 60) || CASE WHEN doc_id % 3 = 0 THEN ' MRI HER2' ELSE '' END AS query, {_sql(KINDS, 2)} AS doc_type, {_sql(TYPES, 3)} AS query_type, {_sql(MODES, 7)} AS mode FROM rec),
p1 AS (SELECT *, array_to_string(list_filter([title, doc_type, source_name, CASE WHEN doc_id % 6 = 0 THEN 'HER2 panel' ELSE '' END], lambda x: trim(x) <> ''), ' ') AS meta FROM p0),
p2 AS (SELECT *, {terms('query')} AS qt, CASE WHEN doc_id % 3 = 0 THEN list_concat(list_filter(regexp_extract_all(substring(body, 20, 60), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '[A-Z][A-Z0-9]{{1,6}}')), ['MRI', 'HER2']) ELSE list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '[A-Z][A-Z0-9]{{1,6}}')) END AS ac0, {fold('meta')} AS mf, left({fold('body')}, 1800) AS tf FROM p1),
p AS (SELECT *, list_distinct(list_transform(ac0, lambda v: lower(v))) AS ac, string_split(regexp_replace(mf, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' ') AS mw, string_split(regexp_replace(tf, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' ') AS tw FROM p2)"""
_TT, _MT = terms("title"), terms("meta")


@register("c04_query_bonus", f"""WITH {REC}, {_P} SELECT doc_id, round((least(len(list_intersect(qt, {_MT})) * 0.015, 0.09) + least(len(list_intersect(qt, {_TT})) * CASE WHEN mode = 'article_centric' THEN 0.02 ELSE 0.015 END, 0.06)
  + CASE WHEN len(ac) > 0 THEN len(list_filter(ac, lambda a: list_contains(mw, a))) / len(ac) ELSE 0 END * CASE WHEN mode = 'article_centric' THEN 0.08 ELSE 0.05 END)::DOUBLE, 4) AS bonus FROM p""")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", K.query_bonus(F.col("query"), F.col("title"), F.col("meta"), F.col("mode")).alias("bonus"))


_PH = f"({first_distinct('list_concat(' + grams('qt', 3) + ', ' + grams('qt', 2) + ')')})[:12]"
_COVER = "(len(list_filter(ac, lambda a: list_contains(mw, a) OR list_contains(tw, a))) / nullif(len(ac), 0))"


@register("c05_content_bonus", f"""WITH {REC}, {_P} SELECT doc_id, round((least(len(list_filter(qt, lambda t: list_contains(tw, t))) * 0.02, 0.16) + least(len(list_filter(qt, lambda t: list_contains(mw, t))) * 0.025, 0.12)
  - CASE WHEN len(qt) >= 2 AND len(list_filter(qt, lambda t: list_contains(tw, t) OR list_contains(mw, t))) = 0 THEN 0.08 ELSE 0 END
  + coalesce(list_sum(list_transform({_PH}, lambda x: CASE WHEN contains(tf, x) THEN CASE WHEN len(string_split(x, ' ')) >= 3 THEN 0.05 ELSE 0.03 END WHEN contains(mf, x) THEN CASE WHEN len(string_split(x, ' ')) >= 3 THEN 0.04 ELSE 0.02 END ELSE 0 END)), 0)
  + CASE WHEN len(ac) = 0 THEN 0 WHEN {_COVER} > 0 THEN {_COVER} * CASE WHEN mode = 'article_centric' THEN 0.12 ELSE 0.08 END ELSE -0.06 END)::DOUBLE, 4) AS bonus FROM p""")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", K.content_bonus(F.col("query"), F.col("body"), F.col("meta"), F.col("mode")).alias("bonus"))


def _any(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


_KIND_IN = ", ".join(f"'{t}'" for t in K.JOURNAL_TYPES)
_J = f"(doc_type IN ({_KIND_IN}) OR {_any(fold('source_name'), K.JOURNAL_MARKS)} OR {_any(fold('title'), K.JOURNAL_MARKS)})"
_B = rf"(regexp_matches({fold('title')}, '\btap chi\b.*\bso\b') OR regexp_matches({fold('title')}, '\bjournal\b.*\bissue\b') OR {_any(fold('title'), ['dac biet', 'special issue', 'phu ban'])})"


def _add(c: str, v: float) -> str:
    return f"CASE WHEN {c} THEN {v} ELSE 0 END"


@register("c06_source_bonus", f"""WITH {REC}, {_P} SELECT doc_id, round(({_add("regexp_matches(lower(title), '%[0-9a-f]{2}')", -0.10)} + CASE
  WHEN query_type IN ('study_result_extraction', 'research_appraisal') THEN {_add(_J, 0.06)} + {_add(_B, -0.14)} + {_add("doc_type IN ('reference', 'patient_education')", -0.12)} + {_add("mode = 'article_centric' AND doc_type = 'guideline'", -0.05)} + {_add(_any(fold('source_name'), K.AGENCY_MARKS), -0.14)}
  WHEN query_type = 'comparative_synthesis' AND mode = 'article_centric' THEN {_add(_J, 0.04)} + {_add(_B, -0.10)} + {_add("doc_type = 'patient_education'", -0.05)}
  WHEN query_type = 'guideline_comparison' THEN {_add("doc_type = 'guideline'", 0.07)} + {_add("doc_type = 'reference'", 0.03)} WHEN query_type = 'teaching_explainer' THEN {_add("doc_type IN ('textbook', 'reference')", 0.04)} ELSE 0 END)::DOUBLE, 4) AS bonus FROM p1""")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _pairs(spark, sf_dir).select("doc_id", K.source_bonus(c("query_type"), c("mode"), F.lit("exact"), c("doc_type"), c("source_name"), c("title")).alias("bonus"))


@register("h03_h04_journal_and_bundle", f"WITH {REC}, {_P} SELECT doc_id, {_J} AS journal, {_B} AS bundle FROM p1")
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", K.journal(F.col("doc_type"), F.col("source_name"), F.col("title")).alias("journal"), K.issue_bundle(F.col("title")).alias("bundle"))


_KW = "list_filter(list_distinct(string_split({}, ' ')), lambda v: len(v) > 1)"
_QK, _MK, _SK = _KW.format(title_norm("query")), _KW.format(title_norm("meta")), _KW.format(title_norm("support"))
_AL = f"""al AS (SELECT *, {_QK} AS qk, {_MK} AS mk, meta || ' ' || left(body, 500) AS support, string_split(regexp_replace({title_norm('meta')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' ') AS mtw FROM p),
a2 AS (SELECT *, CASE WHEN len(qk) > 0 AND len(mk) > 0 THEN len(list_intersect(qk, mk)) / len(qk) ELSE 0 END AS kw, len(list_filter(list_intersect(qk, mk), lambda v: len(v) >= 4)) AS specific,
  CASE WHEN len(ac) > 0 THEN len(list_filter(ac, lambda a: list_contains(mtw, a))) / len(ac) ELSE 0 END AS acr, len(list_intersect(qk, {_SK})) AS sup FROM al)"""


@register("c10_query_alignment", f"WITH {REC}, {_P}, {_AL} SELECT doc_id, round(kw, 6) AS kw, specific, round(acr, 6) AS acronym FROM a2")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pairs(spark, sf_dir).withColumn("a", K.alignment(F.col("query"), F.col("meta")))
    return a.select("doc_id", F.round("a.kw", 6).alias("kw"), F.col("a.specific").alias("specific"), F.round("a.acronym", 6).alias("acronym"))


def _tab(c: str, values: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {repr(k)} THEN {v}" for k, v in values.items()) + " ELSE 0 END"


_FOC = f"list_filter(string_split({title_norm('query')}, ' '), lambda v: len(v) >= 3)"
_IDP = f"({first_distinct('list_concat(' + ', '.join(grams('foc', n) for n in (5, 4, 3, 2)) + ')')})[:12]"
_SCORE = f"""s0 AS (SELECT *, {_FOC} AS foc, {title_norm('title')} AS tn, {title_norm('support')} AS sn, (doc_id * 37 % 101) / 100.0::DOUBLE AS mx, (doc_id * 17 % 53) / 100.0::DOUBLE AS av, doc_id % 9 + 1 AS cc, doc_id % 4 AS nc FROM a2),
s1 AS (SELECT *, {_IDP} AS idp FROM s0),
s2 AS (SELECT *, least(round(coalesce(list_sum(list_transform(idp, lambda x: CASE WHEN contains(tn, x) THEN CASE WHEN len(string_split(x, ' ')) >= 3 THEN 0.12 ELSE 0.08 END WHEN contains(sn, x) THEN CASE WHEN len(string_split(x, ' ')) >= 3 THEN 0.08 ELSE 0.05 END ELSE 0 END)), 0)::DOUBLE, 4), 0.42) AS ident FROM s1),
sc AS (SELECT doc_id, query, mode, doc_id % 25 AS query_id, kw, specific, acr, sup, ac, mx, av, cc, round((0.35 * mx + 0.20 * av + 0.15 * least(cc / 6.0, 1.0) + 0.15 * least(nc / greatest(cc, 1), 1.0) + 0.15 * kw + least(specific * 0.03, 0.12) + 0.16 * acr
  - CASE WHEN len(ac) > 0 THEN 0.16 * (1.0 - acr) ELSE 0 END + 0.12 * least(sup / greatest(len(qk), 1), 1.0) - CASE WHEN len(qk) >= 2 AND sup = 0 THEN 0.14 ELSE 0 END
  + {_tab('trust_tier', K.TIER_BOOST)} + {_tab('doc_type', K.TYPE_BOOST)} + CASE query_type {" ".join(f"WHEN '{k}' THEN {_tab('doc_type', v)}" for k, v in K.TYPE_FIT.items())} ELSE 0 END
  + CASE WHEN query_type IN ('study_result_extraction', 'research_appraisal') THEN {_add(_J, 0.04)} + {_add("doc_type = 'patient_education'", -0.04)} WHEN query_type = 'comparative_synthesis' AND mode = 'article_centric' THEN {_add(_J, 0.03)} + {_add("doc_type = 'patient_education'", -0.03)}
    WHEN query_type IN ('teaching_explainer', 'professional_explainer') THEN {_add("doc_type IN ('textbook', 'reference')", 0.03)} WHEN query_type = 'guideline_comparison' THEN {_add(_any(title_norm('source_name'), K.GUIDELINE_SOURCES), 0.02)} ELSE 0 END
  + ident - CASE WHEN len(trim(title)) < 15 OR regexp_matches(trim(title), '^\\p{{Ll}}') THEN 0.08 ELSE 0 END)::DOUBLE, 4) AS article_score FROM s2)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _pairs(spark, sf_dir).withColumns({
        "support": F.concat_ws(" ", "meta", F.substring("body", 1, 500)), "max_score": F.col("doc_id") * 37 % 101 / F.lit(100.0), "avg_score": F.col("doc_id") * 17 % 53 / F.lit(100.0),
        "chunk_count": F.col("doc_id") % 9 + 1, "numeric_chunks": F.col("doc_id") % 4, "query_id": F.col("doc_id") % 25})
    return K.article_score(at)


@register("c09_article_score", f"WITH {REC}, {_P}, {_AL}, {_SCORE} SELECT doc_id, round(article_score, 3) AS article_score, sup AS support_terms FROM sc")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("article_score", 3).alias("article_score"), F.col("support_term_count").alias("support_terms"))


@register("w02_primary_articles")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mode for each question: that of its least record."""
    scored = _scored(spark, sf_dir)
    first = scored.groupBy("query_id").agg(F.min_by(F.struct("query", "mode"), "doc_id").alias("f"))
    at = scored.drop("query", "mode").join(first, "query_id").withColumns({"query": F.col("f.query"), "mode": F.col("f.mode"), "title_norm": F.col("doc_id")}).drop("f")
    return K.select_articles(at).select("query_id", "doc_id", "role", F.col("rank").cast("int").alias("rank"))


