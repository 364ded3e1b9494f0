"""Routing and answer scoring over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import scores as S
from ..functions import text as T
from .registry import REC, records, register, table
from .retrieval_queries import _lexical
from .text_queries import quoted, tokens

#: Questions that a record's title is asked with, so that each rule is met.
ASKED = [
    "Tỷ lệ tái phát là bao nhiêu ở {}", "So sánh thuốc A với thuốc B cho {}", "Cơ chế bệnh sinh của {} là gì", "Theo guideline nào {} vs {}", "Hạn chế của nghiên cứu này về {}",
    "{} explain why", "what is {}", "{}", "Có thể khẳng định {} vượt trội tuyệt đối", "Các biện pháp dự phòng {} bao gồm", "theo context, AUC của {} or HR", "Vai trò của {} khác nhau như thế nào",
]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.element_at(F.array(*[F.lit(a) for a in ASKED]), (F.col("doc_id") % len(ASKED) + 1).cast("int"))
    return records(spark, sf_dir).select("doc_id", F.replace(pattern, F.lit("{}"), F.col("title")).alias("query"))


_Q = f"q0 AS (SELECT doc_id, trim(lower(replace({quoted(ASKED)}[(doc_id % {len(ASKED)} + 1)::INT], '{{}}', title))) AS q FROM rec), q AS (SELECT *, translate(strip_accents(q), 'đĐ', 'dD') AS s FROM q0)"


def _any(phrases: list[str], pad: bool) -> str:
    p = [f" {x} " if pad else x for x in R.both(phrases)]
    return f"(list_bool_or(list_transform({quoted(p)}, lambda p: contains(' ' || q || ' ', p) OR contains(' ' || s || ' ', p))))"


def _rules(x: str, rules: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{r}')" for r in rules) + ")"


_COUNT = ", ".join(f"len(list_filter({quoted(R.both(d))}, lambda p: contains(q, p) OR contains(s, p))) AS {n}" for n, d in R.DICTIONARIES.items())
_WORDS = r"len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> ''))"
_SIG = f"""x AS (SELECT *, {_any(R.COMPARISON_MARKS, True)} OR {_rules('s', R.COMPARISON_RULES)} AS cmp, {_any(R.SINGLE_DOCUMENT, False)} AS single,
  {_any(R.DIRECT_FACT_MARKS, True)} OR {_rules('q', R.DIRECT_FACT_RULES)} OR {_rules('s', R.DIRECT_FACT_RULES)} AS fact, {_any(R.NUMERIC_MARKS, True)} OR regexp_matches(s, '{R.NUMERIC_RULE}') AS num,
  {_any(R.BOUNDED, False)} AS bounded, {_any(R.SUMMARY_MARKS, True)} OR contains(' ' || q || ' ', ' {R.SUMMARY_ACCENTED} ') AS summ, {_any(R.EXPLAINER_MARKS, True)} AS expl, {_COUNT}, {_WORDS} AS words FROM q)"""
_TOP = "greatest(" + ", ".join(R.DICTIONARIES) + ")"
_KIND = f"""k AS (SELECT *, CASE WHEN NOT single AND NOT num AND expl AND guideline_comparison = 0 AND comparative_synthesis = 0 THEN 'professional_explainer'
  WHEN cmp THEN CASE WHEN guideline_comparison > 0 THEN 'guideline_comparison' ELSE 'comparative_synthesis' END
  WHEN fact AND research_appraisal = 0 AND comparative_synthesis = 0 AND guideline_comparison = 0 AND teaching_explainer = 0 THEN 'fact_extraction'
  WHEN {_TOP} = 0 THEN CASE WHEN words > 25 THEN 'research_appraisal' WHEN words > 15 THEN 'study_result_extraction' ELSE 'fact_extraction' END
  ELSE CASE {" ".join(f"WHEN {n} = {_TOP} THEN '{n}'" for n in R.DICTIONARIES)} END END AS query_type FROM x)"""
_STYLE = """st AS (SELECT *, CASE WHEN bounded THEN 'bounded_partial' WHEN query_type = 'research_appraisal' THEN 'appraisal'
  WHEN query_type IN ('fact_extraction', 'study_result_extraction') THEN CASE WHEN summ AND NOT num THEN 'summary' WHEN fact OR num THEN 'exact' WHEN single THEN 'summary' ELSE 'exact' END ELSE 'summary' END AS answer_style,
  NOT single AND NOT (query_type = 'study_result_extraction' AND num) AS opened FROM k)"""


@register("c22_route_query", f"""WITH {REC}, {_Q}, {_SIG}, {_KIND}, {_STYLE} SELECT doc_id, query_type, answer_style, CASE WHEN opened THEN 'open_enriched' ELSE 'strict_rag' END AS answer_policy,
  CASE WHEN single THEN 'article_centric' WHEN opened AND query_type IN ('teaching_explainer', 'professional_explainer') THEN 'mechanistic_synthesis' WHEN opened THEN 'topic_summary' ELSE 'article_centric' END AS retrieval_mode FROM st""")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).withColumn("r", R.route(F.col("query"))).select("doc_id", "r.query_type", "r.answer_style", "r.answer_policy", "r.retrieval_mode")


@register("h13_keyword_counts", f"WITH {REC}, {_Q} SELECT doc_id, {_COUNT} FROM q")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.trim(F.lower(F.col("query")))
    return _questions(spark, sf_dir).select("doc_id", *[R.count_matches(q, T.strip_diacritics(q), d).alias(n) for n, d in R.DICTIONARIES.items()])


@register("h14_h20_query_signals", f"WITH {REC}, {_Q}, {_SIG} SELECT doc_id, cmp, single, fact, num, bounded, summ, expl FROM x")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.trim(F.lower(F.col("query")))
    tests = {"cmp": R.explicit_comparison, "single": R.single_document, "fact": R.direct_fact, "num": R.numeric, "bounded": R.bounded_partial, "summ": R.summary_request, "expl": R.explainer_intent}
    return _questions(spark, sf_dir).select("doc_id", *[f(q, T.strip_diacritics(q)).alias(n) for n, f in tests.items()])


@register("c25_decompose")
def c25(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("body", r"\s+", " ")
    return records(spark, sf_dir).select("doc_id", F.posexplode(R.decompose(text)).alias("pos", "subquery"))


# answers: what follows a document's first signs answers for the concept that its title gives
_COV = f"(CASE WHEN len(list_filter(list_distinct({tokens('title')}), lambda v: len(v) > 1 AND NOT list_contains({quoted([*T.VI_STOPWORDS, *T.EN_STOPWORDS])}, v))) = 0 THEN 0.0 ELSE len(list_intersect(list_filter(list_distinct({tokens('title')}), lambda v: len(v) > 1 AND NOT list_contains({quoted([*T.VI_STOPWORDS, *T.EN_STOPWORDS])}, v)), list_distinct({tokens('substring(body, 50, 600)')}))) / len(list_filter(list_distinct({tokens('title')}), lambda v: len(v) > 1 AND NOT list_contains({quoted([*T.VI_STOPWORDS, *T.EN_STOPWORDS])}, v))) END)"


@register("c15_token_coverage", f"WITH {REC} SELECT doc_id, {_COV} AS coverage FROM rec")
def c15t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", S.token_coverage(F.substring("body", 50, 600), F.col("title")).alias("coverage"))


@register("c15_t68_t70_coverage_whole")
def coverage_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, T68 and T70 of the title in all that follows its start; held against brute force in tests."""
    rest = F.expr("substring(body, 50)")
    return records(spark, sf_dir).select(
        "doc_id", S.token_coverage(rest, F.col("title")).alias("coverage"), T.phrase_present(F.col("title"), rest).alias("present"), T.lexical_coverage(F.col("title"), rest).alias("lexical"))


@register("c15_concept_overlap")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.round(S.concept_overlap(F.expr("substring(body, 50)"), F.col("title")), 3).alias("overlap"))


@register("c16_best_sentence")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.round(S.best_sentence_similarity(F.expr("substring(body, 50)"), F.col("title")), 6).alias("best"))


@register("c18_semantic_lite")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows from the benchmark: each item's first and last words are concepts, its text the truth; the best lexical hit among all documents answers, with its whole text; an item without a hit has no answer."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ground_truth"))
    best = _lexical(spark, sf_dir, 1).select(F.col("query_id").alias("id"), F.col("article_id").alias("doc_id"))
    # two ids an item go to the bodies, which aren't shuffled
    answers = records(spark, sf_dir).select("doc_id", F.col("body").alias("answer")).join(F.broadcast(best), "doc_id").drop("doc_id")
    rows = items.join(answers, "id", "left").select("id", "answer", "ground_truth", F.array(F.substring("ground_truth", 1, 20), F.substring("ground_truth", 30, 15)).alias("must_have"), F.array(F.lit("không có tác dụng")).alias("must_not"))
    return S.semantic_lite(rows).select("id", "must_have_soft_coverage", "reference_similarity", "semantic_lite_score", "semantic_lite_pass")
