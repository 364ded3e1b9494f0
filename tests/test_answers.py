"""Routing, ranking, evidence and answer scoring."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import evidence as V
from lexmill.functions import ranking as K
from lexmill.functions import routing as R
from lexmill.functions import scores as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("query", "kind", "style", "mode", "policy"), [
    ("Tỷ lệ tái phát là bao nhiêu?", "study_result_extraction", "exact", "article_centric", "strict_rag"),
    ("So sánh thuốc A với thuốc B", "comparative_synthesis", "summary", "topic_summary", "open_enriched"),
    ("Cơ chế bệnh sinh của suy tim là gì", "professional_explainer", "summary", "mechanistic_synthesis", "open_enriched"),
    ("theo nghiên cứu này hạn chế là gì", "research_appraisal", "appraisal", "article_centric", "strict_rag"),
    ("aspirin", "fact_extraction", "exact", "topic_summary", "open_enriched"),
    ("", "fact_extraction", "exact", "topic_summary", "open_enriched"),
])
def test_route(spark, query, kind, style, mode, policy):
    r = one(spark, R.route(F.lit(query)))
    assert (r.query_type, r.answer_style, r.retrieval_mode, r.answer_policy) == (kind, style, mode, policy)


def test_decompose(spark):
    long = "the first question about one thing here, and the second question about another thing there, the first question about one thing"
    assert one(spark, R.decompose(F.lit("short question"))) == ["short question"]
    got = one(spark, R.decompose(F.lit(long)))
    assert len(got) == 2 and got[0] == "the first question about one thing here"


def test_numbers_and_verification(spark):
    got = [(x.metric, x.value) for x in one(spark, V.numbers(F.lit("n = 146, AUC: 0.91; p<0.05, 12,5 %")))]
    assert got == [("sample_size", "146"), ("AUC", "0.91"), ("percentage", "12,5 %"), ("p-value", "0.05")]
    check = lambda a, policy="strict_rag": one(spark, V.verify(F.lit(a), F.lit(2), F.array(F.lit("E1")), F.lit(policy), F.lit(True)))
    assert check("said [1] [E1]").status == "pass" and check("AUC 0.9").status == "revise" and len(check("[3] [E9]").issues) == 2
    assert check("short [1]", "open_enriched").issues == ["answer too short"]


def test_polarity_and_conflicts(spark):
    assert one(spark, V.polarity(F.lit("Thuốc CẢI THIỆN rõ"))) == "POSITIVE_OUTCOME" and one(spark, V.polarity(F.lit(None).cast("string"))) is None
    tags = lambda *t: F.array(*[F.lit(x) for x in t])
    got = one(spark, V.conflicts(tags("POSITIVE_OUTCOME"), tags("NEGATIVE_OUTCOME", "NEUTRAL_OUTCOME"), F.lit(False), F.lit(True)))
    assert got == ["opposite_outcome"]
    assert one(spark, V.conflicts(tags("STRONG_RECOMMENDATION"), tags("NEUTRAL_OUTCOME"), F.lit(True), F.lit(True))) == ["strong_recommendation_contradicted"]


def test_filters(spark):
    f = one(spark, V.detect_filters(F.lit("WHO guideline for flu")))
    assert (f.source_name, f.audience, f.trust_tier, f.doc_type) == ("WHO", "clinician", 1, "guideline")
    assert one(spark, V.detect_filters(F.lit(None).cast("string"))).source_name is None


def _group(**k):
    base = {"query_id": 1, "query": "alpha beta", "mode": "article_centric", "title_norm": "t", "article_score": 0.5, "max_score": 0.5, "chunk_count": 1, "avg_score": 0.5,
            "support_term_count": 1, "acronym_coverage": 0.0, "kw_score": 0.5, "specific_overlap": 2}
    return base | k


@pytest.mark.parametrize(("anchor", "want"), [({}, "b"), ({"support_term_count": 0}, "a"), ({"kw_score": 0.05}, "a"), ({"article_score": 0.3, "support_term_count": 0}, "a")])
def test_primary_anchor_and_its_vetoes(spark, anchor, want):
    rows = [_group(title_norm="a", article_score=0.6), _group(title_norm="b", max_score=0.9, article_score=0.58, **{k: v for k, v in anchor.items() if k != "article_score"}) | anchor]
    got = K.select_articles(spark.createDataFrame(rows)).collect()
    assert [(r.title_norm, r.role) for r in got] == [(want, "primary")]


def test_secondaries_follow_the_mode(spark):
    rows = [_group(title_norm=c, mode="topic_summary", article_score=s, specific_overlap=o) for c, s, o in (("a", 1.0, 2), ("b", 0.8, 2), ("c", 0.76, 1), ("d", 0.5, 3), ("e", 0.9, 2), ("f", 0.85, 2), ("g", 0.84, 2))]
    got = K.select_articles(spark.createDataFrame(rows)).collect()
    assert sorted((r.role, r.title_norm) for r in got) == [("primary", "a"), ("secondary", "e"), ("secondary", "f"), ("secondary", "g")]


def test_semantic_lite(spark):
    rows = [(1, "The dose is 5 mg daily.", "The dose is 5 mg daily.", ["5 mg"], ["10 mg"], True), (2, "không có thông tin", "The dose is 5 mg.", ["5 mg"], [], False), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, answer string, ground_truth string, must_have array<string>, must_not array<string>, top1_title_hit boolean")
    got = {r.id: r for r in S.semantic_lite(df).collect()}
    assert got[1].semantic_lite_score == 1.0 and got[1].semantic_lite_pass and not got[2].semantic_lite_pass and got[3].semantic_lite_score == 0.0


def test_filter_chunks(spark):
    from lexmill.operators import retrieval

    good = "Patients in this clinical study got the treatment and the outcome was good. " * 3
    rows = [(1, good, "Results", "A long enough title here", 0.8), (2, good, "References", "A long enough title here", 0.9), (3, "10.1234/a 10.5678/b", "", "A long enough title here", 0.9), (4, good, None, "x", 0.5)]
    df = spark.createDataFrame(rows, "i int, text string, section_title string, title string, score double")
    got = {r.i: round(r.score, 4) for r in retrieval.filter_chunks(df).collect()}
    assert set(got) == {1, 4} and got[1] == 0.8 and got[4] == round(0.5 * (0.7 + 0.3 * 0.85), 4)


def test_semantic_lite_is_answered_by_the_best_hit(spark, tmp_path):
    from lexmill.plans import load, registry

    load()

    said = "zebra giraffe elephant walks slowly over the wide savanna plain"
    far = "Other words first. " * 100 + said + "."
    spark.createDataFrame([(1, said), (2, "qqqq wwww rrrr")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "nothing of it here at all"), (7, "zebra giraffe elephant savanna notes\n" + far)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r for r in registry.QUERIES["c18_semantic_lite"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1].must_have_soft_coverage == 1.0 and got[1].reference_similarity > 0.95 and got[2].semantic_lite_score == 0.0
