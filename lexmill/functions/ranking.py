"""Bonuses of retrieved chunks and composite scores of article groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import acronyms, blank, fold, let, phrases, query_terms, title_norm

# ---------------------------------------------------------------- fixed values
JOURNAL_TYPES = ["journal_article", "research_article", "original_research", "case_report", "meta_analysis", "review"]
JOURNAL_MARKS = ["journal", "tap chi", "vmj", "y hoc", "nghien cuu"]
AGENCY_MARKS = ["dav_gov", "kcb_moh", "bo y te", "moh", "gov"]
GUIDELINE_SOURCES = ["who", "cdc", "nhs", "uspstf", "nice"]
TIER_BOOST = {1: 0.08, 2: 0.04, 3: 0.0}
TYPE_BOOST = {"guideline": 0.06, "textbook": 0.04, "reference": 0.04, "research_article": 0.04, "journal_article": 0.04, "original_research": 0.05,
              "case_report": 0.03, "meta_analysis": 0.05, "review": 0.02, "patient_education": 0.0}
TYPE_FIT = {
    "guideline_comparison": {"guideline": 0.05, "reference": 0.02},
    "teaching_explainer": {"textbook": 0.05, "reference": 0.04, "guideline": 0.02},
    "professional_explainer": {"textbook": 0.04, "reference": 0.04, "guideline": 0.03, "research_article": 0.02},
    "study_result_extraction": {"research_article": 0.06, "journal_article": 0.05, "original_research": 0.06, "review": 0.03},
    "research_appraisal": {"research_article": 0.06, "journal_article": 0.05, "original_research": 0.06, "review": 0.03},
    "comparative_synthesis": {"research_article": 0.04, "journal_article": 0.04, "review": 0.04, "guideline": 0.03},
    "fact_extraction": {"guideline": 0.03, "textbook": 0.03, "patient_education": 0.02},
}
NUMERIC_CHUNK = r"(?i)[0-9]+[.,]?[0-9]*\s*%|p\s*[<>=]|OR\s*=|HR\s*=|AUC|n\s*="
# mode: secondary articles, least share of the primary score, primary chunks, secondary chunks
MODES = {"mechanistic_synthesis": (5, 0.70, 2, 1), "topic_summary": (3, 0.75, 3, 2), "article_centric": (1, 0.85, 5, 2)}
# ----------------------------------------------------------------------------


def _has(text: Column, marks: list[str]) -> Column:
    return let(text, lambda t: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(t, m)))


def words(text: Column) -> Column:
    """A folded text as `` w w w ``, for whole-word tests without building patterns."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_]+", " "), F.lit(" "))


def _hits(terms: Column, text: Column) -> Column:
    return let(words(text), lambda w: F.size(F.filter(terms, lambda t: F.contains(w, F.concat(F.lit(" "), t, F.lit(" "))))))


def keywords(c: Column) -> Column:
    """Distinct words of a normalised title, of two signs or more."""
    return F.filter(F.array_distinct(F.split(title_norm(c), " ")), lambda x: F.char_length(x) > 1)


def metadata_text(*parts: Column) -> Column:
    """The non-empty metadata of a payload in one text."""
    return F.array_join(F.filter(F.array(*[blank(p) for p in parts]), lambda x: F.trim(x) != ""), " ")


def journal(doc_type: Column, source: Column, title: Column) -> Column:
    """A journal by type, source or title."""
    return F.lower(blank(doc_type)).isin(JOURNAL_TYPES) | _has(fold(source), JOURNAL_MARKS) | _has(fold(title), JOURNAL_MARKS)


def issue_bundle(title: Column) -> Column:
    """A title of a whole issue."""
    t = fold(title)
    return t.rlike(r"\btap chi\b.*\bso\b") | t.rlike(r"\bjournal\b.*\bissue\b") | _has(t, ["dac biet", "special issue", "phu ban"])


def query_bonus(query: Column, title: Column, meta: Column, mode: Column) -> Column:
    """Up to .09 for shared terms, .06 for title terms, .08 for acronyms in the metadata."""
    q, a, centric = query_terms(query), acronyms(query), mode == "article_centric"
    shared = F.size(F.array_intersect(q, query_terms(meta)))
    titled = F.size(F.array_intersect(q, query_terms(title)))
    share = F.when(F.size(a) > 0, _hits(a, fold(meta)) / F.size(a)).otherwise(0.0)
    return F.round(F.least(shared * 0.015, F.lit(0.09)) + F.least(titled * F.when(centric, 0.02).otherwise(0.015), F.lit(0.06)) + share * F.when(centric, 0.08).otherwise(0.05), 4)


def content_bonus(query: Column, text: Column, meta: Column, mode: Column) -> Column:
    """Term, phrase and acronym hits in the first 1800 signs and the metadata, with penalties for none."""
    q, a = query_terms(query), acronyms(query)
    body, head = F.substring(fold(text), 1, 1800), fold(meta)
    said = phrases(q, (3, 2), 12)

    def score(x: Column) -> Column:
        t, m = x["t"], x["m"]
        in_text, in_meta = _hits(q, t), _hits(q, m)
        long = lambda p: F.size(F.split(p, " ")) >= 3
        phrase = F.aggregate(said, F.lit(0.0), lambda s, p: s + F.when(F.contains(t, p), F.when(long(p), 0.05).otherwise(0.03)).when(F.contains(m, p), F.when(long(p), 0.04).otherwise(0.02)).otherwise(0.0))
        cover = let(F.struct(words(t).alias("t"), words(m).alias("m")), lambda w: F.size(F.filter(a, lambda v: F.contains(w["t"], F.concat(F.lit(" "), v, F.lit(" "))) | F.contains(w["m"], F.concat(F.lit(" "), v, F.lit(" ")))))) / F.size(a)
        named = F.when(F.size(a) == 0, 0.0).when(cover > 0, cover * F.when(mode == "article_centric", 0.12).otherwise(0.08)).otherwise(-0.06)
        none = F.when((F.size(q) >= 2) & (in_text == 0) & (in_meta == 0), 0.08).otherwise(0.0)
        return F.round(F.least(in_text * 0.02, F.lit(0.16)) + F.least(in_meta * 0.025, F.lit(0.12)) - none + phrase + named, 4)

    return let(F.struct(body.alias("t"), head.alias("m")), score)


def source_bonus(query_type: Column, mode: Column, style: Column, doc_type: Column, source: Column, title: Column) -> Column:
    """How a chunk's source suits the question's type."""
    kind, study = F.lower(blank(doc_type)), query_type.isin("study_result_extraction", "research_appraisal")
    compared = (query_type == "comparative_synthesis") & (mode == "article_centric")
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    j, b = journal(doc_type, source, title), issue_bundle(title)
    return F.when(query_type.isNull(), 0.0).otherwise(F.round(
        add(F.lower(title).rlike("%[0-9a-f]{2}"), -0.10)
        + F.when(study, add(j, 0.06) + add(b, -0.14) + add(kind.isin("reference", "patient_education"), -0.12) + add((style == "exact") & (mode == "article_centric") & (kind == "guideline"), -0.05) + add(_has(fold(source), AGENCY_MARKS), -0.14))
        .when(compared, add(j, 0.04) + add(b, -0.10) + add(kind == "patient_education", -0.05))
        .when(query_type == "guideline_comparison", add(kind == "guideline", 0.07) + add(kind == "reference", 0.03))
        .when(query_type == "teaching_explainer", add(kind.isin("textbook", "reference"), 0.04)).otherwise(0.0), 4))


def _table(c: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(0.0)


def type_fit(query_type: Column, doc_type: Column) -> Column:
    out = None
    for k, values in TYPE_FIT.items():
        out = F.when(query_type == k, _table(doc_type, values)) if out is None else out.when(query_type == k, _table(doc_type, values))
    return out.otherwise(0.0)


def source_fit(query_type: Column, mode: Column, doc_type: Column, source: Column, title: Column) -> Column:
    """Boost of an article by its source and the question's type."""
    kind, j = F.lower(blank(doc_type)), journal(doc_type, source, title)
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    return (
        F.when(query_type.isin("study_result_extraction", "research_appraisal"), add(j, 0.04) + add(kind == "patient_education", -0.04))
        .when((query_type == "comparative_synthesis") & (mode == "article_centric"), add(j, 0.03) + add(kind == "patient_education", -0.03))
        .when(query_type.isin("teaching_explainer", "professional_explainer"), add(kind.isin("textbook", "reference"), 0.03))
        .when(query_type == "guideline_comparison", add(_has(title_norm(source), GUIDELINE_SOURCES), 0.02)).otherwise(0.0))


def alignment(query: Column, meta: Column) -> Column:
    """struct(kw, specific, acronym): share of query words in the metadata, those of four signs or more, share of acronyms."""
    q, m, a = keywords(query), keywords(meta), acronyms(query)
    shared = F.array_intersect(q, m)
    return F.struct(
        F.when((F.size(q) > 0) & (F.size(m) > 0), F.size(shared) / F.size(q)).otherwise(0.0).alias("kw"), F.size(F.filter(shared, lambda x: F.char_length(x) >= 4)).alias("specific"),
        F.when(F.size(a) > 0, _hits(a, title_norm(meta)) / F.size(a)).otherwise(0.0).alias("acronym"))


def identity_bonus(query: Column, title: Column, support: Column) -> Column:
    """Focus phrases of the query in title or support text; capped at .42."""
    tokens = F.filter(F.split(title_norm(query), " "), lambda x: F.char_length(x) >= 3)
    said = phrases(tokens, (5, 4, 3, 2), 12)

    def score(x: Column) -> Column:
        long = lambda p: F.size(F.split(p, " ")) >= 3
        return F.aggregate(said, F.lit(0.0), lambda s, p: s + F.when(F.contains(x["t"], p), F.when(long(p), 0.12).otherwise(0.08)).when(F.contains(x["s"], p), F.when(long(p), 0.08).otherwise(0.05)).otherwise(0.0))

    return F.least(F.round(let(F.struct(title_norm(title).alias("t"), title_norm(support).alias("s")), score), 4), F.lit(0.42))


def article_score(df: DataFrame) -> DataFrame:
    """``df`` with ``article_score`` and its parts.

    Needs ``query, query_type, mode, title, meta, support, doc_type, source_name,
    trust_tier, max_score, avg_score, chunk_count, numeric_chunks``.
    """
    from .predicates import weak_title

    c = F.col
    at = df.withColumns({"__a": alignment(c("query"), c("meta")), "__q": keywords(c("query")), "__ac": acronyms(c("query"))})
    at = at.withColumn("support_term_count", F.size(F.array_intersect("__q", keywords(c("support")))))
    ratio = F.least(c("support_term_count") / F.greatest(F.size("__q"), F.lit(1)), F.lit(1.0))
    relevance = (
        0.35 * c("max_score") + 0.20 * c("avg_score") + 0.15 * F.least(c("chunk_count") / 6.0, F.lit(1.0)) + 0.15 * F.least(c("numeric_chunks") / F.greatest(c("chunk_count"), F.lit(1)), F.lit(1.0))
        + 0.15 * c("__a.kw") + F.least(c("__a.specific") * 0.03, F.lit(0.12)) + 0.16 * c("__a.acronym") - F.when(F.size("__ac") > 0, 0.16 * (1.0 - c("__a.acronym"))).otherwise(0.0)
        + 0.12 * ratio - F.when((F.size("__q") >= 2) & (c("support_term_count") == 0), 0.14).otherwise(0.0))
    authority = _table(c("trust_tier"), TIER_BOOST) + _table(c("doc_type"), TYPE_BOOST)
    fit = type_fit(c("query_type"), c("doc_type")) + source_fit(c("query_type"), c("mode"), c("doc_type"), c("source_name"), c("title"))
    total = relevance + authority + fit + identity_bonus(c("query"), c("title"), c("support")) - F.when(weak_title(c("title")), 0.08).otherwise(0.0)
    return at.withColumns({"article_score": F.round(total, 4), "kw_score": c("__a.kw"), "specific_overlap": c("__a.specific"), "acronym_coverage": c("__a.acronym")}).drop("__a", "__q", "__ac")


def select_articles(scored: DataFrame, by: str = "query_id", ids: str = "title_norm") -> DataFrame:
    """``role`` primary or secondary of the scored groups that an answer uses.

    The primary is the best score; for article-centric questions the group with
    the best chunk takes its place unless one of four rules speaks against it.
    Secondaries reach the mode's share of the primary's score, match all acronyms
    of the question and enough specific words, up to the mode's number.
    """
    c = F.col
    w = Window.partitionBy(by)
    top = F.struct(c("article_score").alias("s"), *[c(x).alias(x) for x in ("support_term_count", "acronym_coverage", "kw_score")], c(ids).alias("i"))
    at = scored.withColumns({
        "__best": F.max_by(top, F.struct(c("article_score"), c(ids))).over(w),
        "__anchor": F.max_by(top, F.struct("max_score", "chunk_count", "avg_score", ids)).over(w)})
    b, a = c("__best"), c("__anchor")
    keep = ((a["support_term_count"] == 0) & (b["support_term_count"] > 0)) | ((a["acronym_coverage"] == 0) & (b["acronym_coverage"] > 0)) | ((a["kw_score"] < 0.12) & (b["kw_score"] >= 0.2)) | ((b["s"] - a["s"] >= 0.06) & (b["support_term_count"] > a["support_term_count"]))
    chosen = F.when((c("mode") != "article_centric") | keep, b).otherwise(a)
    at = at.withColumn("__p", chosen)
    share = lambda i: F.when(c("mode") == "mechanistic_synthesis", MODES["mechanistic_synthesis"][i]).when(c("mode") == "topic_summary", MODES["topic_summary"][i]).otherwise(MODES["article_centric"][i])
    primary = c(ids) == c("__p.i")
    n = F.size(acronyms(c("query")))
    named = (n == 0) | ((c("acronym_coverage") > 0) & ((n < 2) | (c("acronym_coverage") >= 1.0)))
    fit = ~primary & (c("mode") != "article_centric") & (c("article_score") >= c("__p.s") * share(1)) & named & (c("specific_overlap") >= F.when(c("mode") == "mechanistic_synthesis", 1).otherwise(2))
    at = at.withColumn("role", F.when(primary, "primary").when(fit, "secondary")).where("role is not null")
    rank = F.row_number().over(Window.partitionBy(by, "role").orderBy(F.desc("article_score"), ids))
    return at.withColumn("rank", rank).where((c("role") == "primary") | (c("rank") <= share(0))).drop("__best", "__anchor", "__p")
