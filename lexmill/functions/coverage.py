"""How far the evidence covers a question: scores, what is missing, how sure an answer may be, and in which way it may answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answering import asks_number, concepts, holds, specific_concepts
from .predicates import reasons
from .ranking import keywords
from .text import blank, let

# ---------------------------------------------------------------- fixed values
NUMBER_SEEN = r"(?iu)\d+[.,]?\d*\s*%|p\s*[<>=]|OR|HR|AUC|n\s*="
LIMITS_SEEN = ["hạn chế", "limitation", "bias", "thiếu", "chưa", "cỡ mẫu nhỏ"]
RAW_READ = 4000
# ----------------------------------------------------------------------------


def _has(c: Column) -> Column:
    return blank(c) != ""


def direct_answerability(query: Column, findings: Column, raw: Column) -> Column:
    """The share of the question's keywords that the findings have, or else the first 4,000 signs of the raw text (0.45 at least)."""
    kw = keywords(query)
    share = lambda text: F.size(F.array_intersect(kw, keywords(text))) / F.size(kw)
    none = F.size(kw) == 0
    return (F.when(F.size(findings) > 0, F.when(none, 0.7).otherwise(share(F.array_join(findings, " "))))
            .when(_has(raw), F.when(none, 0.6).otherwise(F.greatest(F.lit(0.45), share(F.substring(raw, 1, RAW_READ))))).otherwise(0.0))


def coverage(query: Column, evidence: Column, router: Column) -> Column:
    """Struct of level, ceiling, mode, scores, missing parts and concepts.

    ``evidence``: title, source_type, raw, findings (texts), numbers (count),
    design, population, sample_size, setting (texts or null), limitations
    (count), extracted (by a model), secondary (their raw texts and findings, in
    order), n_secondary. ``router``: answer_style, query_type, retrieval_mode,
    answer_policy, requires_numbers, requires_limitations. Null texts are empty.
    """
    e, r = evidence, router
    style, kind = blank(r["answer_style"]), blank(r["query_type"])
    raw, numbers = blank(e["raw"]), F.coalesce(e["numbers"], F.lit(0))
    waived = style.isin("exact", "bounded_partial") & ~asks_number(query)
    numeric = (F.when(~r["requires_numbers"] | waived, 1.0).when(numbers >= 2, 1.0).when(numbers > 0, 0.5).when(raw.rlike(NUMBER_SEEN), 0.3).otherwise(0.0))
    methods = sum((F.when(e[f].isNotNull(), 1).otherwise(0) for f in ("design", "population", "sample_size", "setting")), F.lit(0)) / 4.0
    limits = F.when(~r["requires_limitations"] | (e["limitations"] > 0), 1.0).when(holds(F.lower(raw), LIMITS_SEEN), 0.5).otherwise(0.0)
    scores = F.struct(direct_answerability(query, e["findings"], raw).alias("direct"), numeric.alias("numeric"), methods.alias("methods"), limits.alias("limitations"),
                      F.when(e["n_secondary"] > 0, 0.05).otherwise(0.0).alias("conflict"))

    def judge(s: Column) -> Column:
        average = (F.when(style == "exact", (s["direct"] + s["numeric"]) / 2).when(style.isin("summary", "bounded_partial"), (s["direct"] + s["numeric"] + 1.0) / 3)
                   .otherwise((s["direct"] + s["numeric"] + F.when(e["extracted"], s["methods"]).otherwise(0.5) + s["limitations"]) / 4))
        first = F.when((average >= 0.7) & (s["direct"] >= 0.5), "high").when(average >= 0.4, "medium").otherwise("low")
        exact = style == "exact"
        study, appraisal = kind == "study_result_extraction", kind == "research_appraisal"
        absent = lambda f: e[f].isNull()
        guideline = (kind == "guideline_comparison") & _has(e["source_type"]) & ~blank(e["source_type"]).isin("guideline", "meta_analysis")
        missing = reasons(
            (guideline, "guideline_source_preferred"),
            (study & exact & asks_number(query) & (numbers == 0) & ~raw.rlike(r"\d+[.,]?\d*\s*%"), "numeric_findings"), (study & exact & (s["direct"] < 0.35), "direct_answer_span"),
            (((study & ~exact) | appraisal) & absent("design"), "study_design"), (study & ~exact & absent("population"), "study_population"), (study & ~exact & (numbers < 1), "numeric_findings"),
            (appraisal & (F.coalesce(e["limitations"], F.lit(0)) == 0), "limitations"), (appraisal & (s["methods"] < 0.5), "methods_detail"),
            ((kind == "teaching_explainer") & (s["direct"] < 0.3), "topic_content"),
            ((kind == "comparative_synthesis") & (blank(r["retrieval_mode"]) != "article_centric") & (e["n_secondary"] == 0), "comparison_sources"))

        def grade(m: Column) -> Column:
            n = F.size(m)
            ceiling = (F.when(guideline, F.when(first == "high", "moderate").otherwise("high")).when(study & exact, F.when(n >= 2, "low").when(n >= 1, "moderate").otherwise("high"))
                       .when(study, F.when(n >= 3, "low").when(n >= 2, "moderate").otherwise("high")).when(appraisal, F.when(n >= 2, "moderate").otherwise("high"))
                       .when(kind == "teaching_explainer", F.when(n > 0, "low").otherwise("high")).when(kind == "comparative_synthesis", F.when(n > 0, "moderate").otherwise("high")).otherwise("high"))
            level = F.when(n >= 4, "low").when((n >= 3) & (first == "high"), "medium").otherwise(first)
            said = F.lower(F.array_join(F.filter(F.concat(F.array(raw), e["findings"], e["secondary"]), _has), " "))

            def gaps(c: Column) -> Column:
                held = specific_concepts(F.filter(c["all"], lambda x: F.contains(c["said"], x)))
                open_ = F.slice(specific_concepts(F.filter(c["all"], lambda x: ~F.contains(c["said"], x))), 1, 7)
                return F.struct(held.alias("held"), open_.alias("open"), (F.size(open_) / F.greatest(F.size(c["all"]), F.lit(1))).alias("share"))

            known = F.when(blank(query) != "", concepts(query)).otherwise(F.array().cast("array<string>"))
            return let(let(F.struct(known.alias("all"), said.alias("said")), gaps), lambda g: _verdict(g, level, ceiling, m, s, e, r, style))

        return let(missing, grade)

    def _verdict(g: Column, level: Column, ceiling: Column, missing: Column, s: Column, e: Column, r: Column, style: Column) -> Column:
        gap = (F.size(g["open"]) > 0) & (g["share"] > F.when(style == "bounded_partial", 0.35).otherwise(0.6))
        external = level != "high"
        title, text = _has(e["title"]), _has(e["raw"])
        mode = (F.when(~title & ~text, "retrieval_failed").when((level == "high") & ~gap, "evidence_strong").when(title & text & (s["direct"] >= 0.25), "title_anchored")
                .when((blank(r["answer_policy"]) == "open_enriched") | external, "open_knowledge").otherwise("retrieval_failed"))
        abstain = reasons((s["numeric"] == 0, "numeric_data"), (s["limitations"] == 0, "limitations"))
        return F.struct(
            level.alias("level"), F.when(gap & (ceiling == "high"), "moderate").otherwise(ceiling).alias("ceiling"), mode.alias("mode"), s.alias("scores"), external.alias("allow_external"),
            F.when(level == "high", 0).when(level == "medium", 1).otherwise(2).alias("max_external"), abstain.alias("abstain"), missing.alias("missing"), g["open"].alias("unsupported"), gap.alias("gap"),
            F.array_join(F.slice(g["held"], 1, 10), ", ").alias("scope"))

    return let(scores, judge)
