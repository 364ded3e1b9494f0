"""Query routing: dictionaries and rules that turn a question into its retrieval plan."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, strip_diacritics

# ---------------------------------------------------------------- fixed values
# Each accented phrase counts in its plain form as well.
STUDY_RESULT = [
    "auc", "hr", "or", "rr", "ci", "sensitivity", "specificity", "độ nhạy", "độ đặc hiệu", "p-value", "p value", "p <", "p=", "odds ratio",
    "hazard ratio", "relative risk", "kết quả", "hiệu quả", "tỷ lệ", "trung bình", "mean", "n=", "cỡ mẫu", "sample size", "có liên quan",
    "yếu tố liên quan", "yếu tố nguy cơ", "tiên lượng", "dự báo", "dự đoán", "kết cục", "outcome", "endpoint", "tái phát", "tỷ lệ sống",
]
APPRAISAL = [
    "hạn chế", "limitation", "bias", "nhiễu", "áp dụng", "external validity", "applicability", "thiết kế nghiên cứu", "study design", "đánh giá",
    "phê bình", "appraisal", "critique", "điểm mạnh", "điểm yếu", "strength", "weakness", "generalizability", "confound", "yếu tố gây nhiễu",
    "biến số", "phân tích kỹ", "phân tích thật kỹ", "bối cảnh lâm sàng", "cơ sở sinh học", "ý nghĩa ứng dụng",
]
COMPARATIVE = [
    "so sánh", "compare", "comparison", "khác nhau", "giống nhau", "difference", "versus", "vs", "hay là", "hoặc", "ưu điểm", "nhược điểm",
    "nào tốt hơn", "nào hiệu quả hơn", "đối chiếu",
]
GUIDELINE = [
    "guideline", "hướng dẫn", "khuyến cáo", "consensus", "đồng thuận", "theo who", "theo bộ y tế", "theo aha", "theo esc", "phác đồ", "protocol",
    "tiêu chuẩn chẩn đoán", "tiêu chuẩn điều trị", "theo hiệp hội",
]
TEACHING = [
    "giải thích", "explain", "cơ chế", "mechanism", "pathophysiology", "bệnh sinh", "sinh lý bệnh", "tại sao", "vì sao", "why", "như thế nào",
    "how does", "ý nghĩa lâm sàng", "clinical significance", "cho sinh viên", "cho nội trú", "phân tích cơ chế", "bản chất",
]
FACT = [
    "là gì", "what is", "định nghĩa", "definition", "bao nhiêu", "how many", "how much", "tên gì", "loại nào", "which", "tiêu chuẩn", "criteria",
    "phân loại", "classification", "dấu hiệu", "triệu chứng",
]
BOUNDED = [
    "có thể kết luận", "có thể khẳng định", "chưa thể khẳng định", "không thể khẳng định", "vượt trội tuyệt đối", "ở mọi khía cạnh", "điều gì và chưa thể",
]
COMPARISON_MARKS = ["hay", "hoặc", "so với", "vs", "versus", "vượt trội", "tốt hơn", "hiệu quả hơn", "khác nhau", "giống nhau"]
COMPARISON_RULES = [
    r"\b[\w/+.-]{2,}\s+(hay|hoac|vs|versus)\s+[\w/+.-]{2,}\b", r"\b[\w/+.-]{2,}\s+so voi\s+[\w/+.-]{2,}\b",
    r"\b[\w/+.-]{2,}\s+vuot troi(?: tuyet doi)?\s+so voi\s+[\w/+.-]{2,}\b", r"\bco the ket luan\s+[\w/+.-]{2,}.*\s+so voi\s+[\w/+.-]{2,}\b",
]
DIRECT_FACT_MARKS = ["bao nhiêu", "là gì", "tên gì", "loại nào", "như thế nào", "yếu tố nào", "những nhóm yếu tố nào", "nhom yeu to nao"]
DIRECT_FACT_RULES = [r"bao\s+nhi", r"l[aà]\s+g[iì]", r"nh[uư]\s+th[ếe]\s+n[aà]o", r"y[ếe]u\s+t[ốo]\s+n[aà]o"]
NUMERIC_MARKS = ["bao nhiêu", "tỷ lệ", "phần trăm", "hr", "or", "auc", "karnofsky", "điểm"]
NUMERIC_RULE = r"\b(hr|or|auc|rr|ci)\b"
SUMMARY_MARKS = ["những biện pháp", "các biện pháp", "gồm những", "vai trò", "khác nhau như thế nào", "những nhóm yếu tố nào", "yếu tố nào"]
SUMMARY_ACCENTED = "bao gồm"
EXPLAINER_MARKS = ["là gì", "định nghĩa", "giải thích", "vì sao", "tại sao", "cơ chế", "bệnh sinh", "ý nghĩa lâm sàng", "tổng quan"]
SINGLE_DOCUMENT = ["theo context", "từ phần tổng quan này", "theo tổng quan này", "trong nghiên cứu này", "nghiên cứu này", "theo nghiên cứu này", "bài này"]
# query type: depth, numbers, limitations, comparison, profile, extractor, mode
TYPES = {
    "study_result_extraction": ("high", True, False, False, "standard", True, "article_centric"),
    "research_appraisal": ("high", True, True, False, "deep", True, "article_centric"),
    "comparative_synthesis": ("high", True, False, True, "deep", True, "topic_summary"),
    "guideline_comparison": ("medium", False, False, True, "standard", False, "topic_summary"),
    "teaching_explainer": ("medium", False, False, False, "standard", False, "mechanistic_synthesis"),
    "fact_extraction": ("low", False, False, False, "light", False, "mechanistic_synthesis"),
    "professional_explainer": ("medium", False, False, False, "standard", True, "mechanistic_synthesis"),
}
# ----------------------------------------------------------------------------
DICTIONARIES = {"study_result_extraction": STUDY_RESULT, "research_appraisal": APPRAISAL, "comparative_synthesis": COMPARATIVE,
                "guideline_comparison": GUIDELINE, "teaching_explainer": TEACHING, "fact_extraction": FACT}


def plain(phrase: str) -> str:
    d = "".join(c for c in unicodedata.normalize("NFKD", phrase) if not unicodedata.combining(c))
    return d.replace("đ", "d").replace("Đ", "D")


def both(phrases: list[str]) -> list[str]:
    """Phrases and their plain forms, each once."""
    return list(dict.fromkeys(x for p in phrases for x in (p, plain(p))))


def _any(texts: list[Column], phrases: list[str]) -> Column:
    listed = F.array(*[F.lit(p) for p in phrases])
    out = F.lit(False)
    for t in texts:
        out = out | _holds(listed, t)
    return out


def _holds(listed: Column, text: Column) -> Column:
    return let(text, lambda t: F.exists(listed, lambda p: F.contains(t, p)))  # the text is computed once, not for each phrase


def count_matches(q: Column, s: Column, phrases: list[str]) -> Column:
    """Phrases that the text (as is or plain) holds."""
    listed = F.array(*[F.lit(p) for p in both(phrases)])
    return let(F.struct(q.alias("q"), s.alias("s")), lambda x: F.size(F.filter(listed, lambda p: F.contains(x["q"], p) | F.contains(x["s"], p))))


def _marked(q: Column, s: Column, marks: list[str]) -> Column:
    padded = [f" {m} " for m in both(marks)]
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return _any([pad(q), pad(s)], padded)


def _ruled(c: Column, rules: list[str]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | c.rlike(r)
    return out


def explicit_comparison(q: Column, s: Column) -> Column:
    """H14."""
    return _marked(q, s, COMPARISON_MARKS) | _ruled(s, COMPARISON_RULES)


def direct_fact(q: Column, s: Column) -> Column:
    """H15."""
    return _marked(q, s, DIRECT_FACT_MARKS) | _ruled(q, DIRECT_FACT_RULES) | _ruled(s, DIRECT_FACT_RULES)


def numeric(q: Column, s: Column) -> Column:
    """H16; the English word "or" counts."""
    return _marked(q, s, NUMERIC_MARKS) | s.rlike(NUMERIC_RULE)


def bounded_partial(q: Column, s: Column) -> Column:
    """H17."""
    return _any([q, s], both(BOUNDED))


def summary_request(q: Column, s: Column) -> Column:
    """H18."""
    return _marked(q, s, SUMMARY_MARKS) | F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.lit(f" {SUMMARY_ACCENTED} "))


def explainer_intent(q: Column, s: Column) -> Column:
    """H19."""
    return _marked(q, s, EXPLAINER_MARKS)


def single_document(q: Column, s: Column) -> Column:
    """H20."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return _any([pad(q), pad(s)], both(SINGLE_DOCUMENT))


def _pick(kind: Column, at: int) -> Column:
    out = None
    for name, row in TYPES.items():
        out = F.when(kind == name, F.lit(row[at])) if out is None else out.when(kind == name, F.lit(row[at]))
    return out


def route(query: Column) -> Column:
    """Struct of a question's type and its ten control fields."""
    q = F.trim(F.lower(blank(query)))
    return let(q, lambda q: let(strip_diacritics(q), lambda s: let(_signals(q, s), lambda x: let(_kind(q, x), lambda k: _plan(x, k)))))


def _signals(q: Column, s: Column) -> Column:
    tests = {"compare": explicit_comparison, "single": single_document, "fact": direct_fact, "numeric": numeric, "bounded": bounded_partial, "summary": summary_request, "explain": explainer_intent}
    return F.struct(*[f(q, s).alias(n) for n, f in tests.items()], *[count_matches(q, s, d).alias(n) for n, d in DICTIONARIES.items()], F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")).alias("words"))


def _kind(q: Column, x: Column) -> Column:
    names = list(DICTIONARIES)
    top = F.greatest(*[x[n] for n in names])
    best = None
    for n in names:
        best = F.when(x[n] == top, F.lit(n)) if best is None else best.when(x[n] == top, F.lit(n))
    none = F.when(x["words"] > 25, "research_appraisal").when(x["words"] > 15, "study_result_extraction").otherwise("fact_extraction")
    quiet = lambda *ns: F.forall(F.array(*[x[n] for n in ns]), lambda c: c == 0)
    return (
        F.when(~x["single"] & ~x["numeric"] & x["explain"] & quiet("guideline_comparison", "comparative_synthesis"), "professional_explainer")
        .when(x["compare"], F.when(x["guideline_comparison"] > 0, "guideline_comparison").otherwise("comparative_synthesis"))
        .when(x["fact"] & quiet("research_appraisal", "comparative_synthesis", "guideline_comparison", "teaching_explainer"), "fact_extraction")
        .when(top == 0, none).otherwise(best))


def _plan(x: Column, k: Column) -> Column:
    style = (
        F.when(x["bounded"], "bounded_partial").when(k == "research_appraisal", "appraisal")
        .when(k.isin("fact_extraction", "study_result_extraction"), F.when(x["summary"] & ~x["numeric"], "summary").when(x["fact"] | x["numeric"], "exact").otherwise(F.when(x["single"], "summary").otherwise("exact")))
        .otherwise("summary"))

    def settle(style: Column) -> Column:
        opened = ~x["single"] & ~((k == "study_result_extraction") & x["numeric"])
        heavy = k.isin("study_result_extraction", "research_appraisal", "comparative_synthesis")
        numbers = _pick(k, 1) & ~((style == "exact") & ~x["numeric"]) & ~(opened & (k == "study_result_extraction") & ~x["numeric"])
        extractor = F.when(opened & heavy, True).when(style.isin("exact", "summary", "bounded_partial") & ~k.isin("research_appraisal", "professional_explainer"), False).otherwise(_pick(k, 5))
        mode = F.when(x["single"], "article_centric").when(opened & k.isin("teaching_explainer", "professional_explainer"), "mechanistic_synthesis").when(opened, "topic_summary").otherwise(_pick(k, 6))
        base = _pick(k, 4)
        profile = (
            F.when(x["single"], F.when(heavy | (base == "light"), "standard").otherwise(base)).when(opened & heavy, "deep")
            .when(opened & k.isin("fact_extraction", "guideline_comparison"), "standard").otherwise(base))
        return F.struct(
            k.alias("query_type"), _pick(k, 0).alias("depth"), numbers.alias("requires_numbers"), _pick(k, 2).alias("requires_limitations"), _pick(k, 3).alias("requires_comparison"),
            style.alias("answer_style"), profile.alias("retrieval_profile"), extractor.alias("needs_extractor"), mode.alias("retrieval_mode"), F.when(opened, "open_enriched").otherwise("strict_rag").alias("answer_policy"))

    return let(style, settle)


def decompose(query: Column, most: int = 3) -> Column:
    """Sub-questions between conjunctions: three words or more, cut at twelve, without those that share over 70 % of their words with an earlier one; short questions stay whole."""
    words = lambda c: F.filter(F.split(F.trim(blank(c)), r"\s+"), lambda w: w != "")
    parts = F.transform(F.split(blank(query), SPLITTERS), lambda p: F.trim(p))
    long = F.transform(F.filter(parts, lambda p: F.size(words(p)) >= 3), lambda p: F.when(F.size(words(p)) > 12, F.array_join(F.slice(words(p), 1, 12), " ")).otherwise(p))

    def add(acc: Column, p: Column) -> Column:
        mine = F.array_distinct(words(F.lower(p)))
        known = F.exists(acc, lambda e: F.size(F.array_intersect(mine, words(F.lower(e)))) / F.greatest(F.size(mine), F.lit(1)) > 0.7)
        return F.when(known | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.slice(F.aggregate(long, F.array().cast("array<string>"), add), 1, most)
    return F.when((F.size(words(query)) <= 10) | (F.size(long) == 0), F.array(query)).otherwise(kept)


#: What separates sub-questions.
SPLITTERS = r"(?iu)\s+(?:và|and|hoặc|or|cũng như|as well as|đồng thời)\s+|[,;?]\s+"
