"""Answer chain: sentence scores, concepts, evidence windows, decisions on planning, checking and wording, fallback answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import nfc
from .evidence import RISKY, extractive, sentence_candidate
from .ranking import keywords, words
from .text import acronyms, blank, fold, let, phrases, query_terms, title_norm

# ---------------------------------------------------------------- fixed values
ALIAS_HINTS = [
    (["cea", "cas"], "hep dong mach canh ngoai so carotid endarterectomy carotid artery stenting"),
    (["pieb", "cei"], "gay te ngoai mang cung chuyen da epidural labor analgesia"),
    (["thoai hoa khop"], "osteoarthritis elderly early intervention symptom relief disease progression"),
]
STUDY_DESIGN_ASKED = ["thiet ke", "doi tuong", "phuong phap", "co mau", "chon mau", "study design", "sample size", "materials and methods", "methods"]
GROUP_FACTORS_ASKED = ["dua tren", "nhom yeu to", "quyet dinh", "theo doi"]
DESIGN_TEXT = [
    "mo ta cat ngang", "nghien cuu mo ta", "tien cuu", "hoi cuu", "chon mau", "co mau", "phuong phap chon mau", "doi tuong va phuong phap",
    "materials and methods", "study design", "cross-sectional", "cohort", "case control",
]
DESIGN_SENTENCE = [
    "mo ta cat ngang", "nghien cuu mo ta", "tien cuu", "hoi cuu", "chon mau", "co mau", "phuong phap chon mau", "cross-sectional",
    "cohort", "case control", "thu nghiem", "ngau nhien",
]
DESIGN_SECTION = ["doi tuong", "phuong phap", "materials and methods", "methods", "subjects and methods"]
FRAGMENT_MARKERS = ["title:", "source:", "audience:", "body:", "keywords:"]
EVIDENCE_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "trong", "theo", "cua", "của", "mot", "một", "sau", "bao", "nhieu", "nhiêu",
    "la", "là", "nao", "nào", "duoc", "được", "nhu", "như", "thế", "co", "có", "gi", "gì",
]
FALLBACK_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "trong", "nhung", "những", "theo", "giua", "giữa", "cua", "của",
    "mot", "một", "khong", "không", "dua", "dựa", "tren", "trên", "nghien", "nghiên", "cuu", "cứu", "benh", "bệnh", "nhan", "nhân",
]
COMPOUNDS = [
    "xơ vữa", "động mạch", "đái tháo", "tháo đường", "bệnh thận", "thận mạn", "ung thư", "suy tim", "suy thận", "suy gan",
    "viêm mạn", "viêm cấp", "miễn dịch", "tự miễn", "nhiễm trùng", "nhiễm khuẩn", "vi tuần", "tuần hoàn", "nội tiết", "chuyển hoá",
    "thần kinh", "tế bào", "kháng thể", "kháng sinh", "cytokine", "đông máu", "huyết áp", "tim mạch", "đột quỵ", "nhồi máu",
    "tiểu đường", "gan nhiễm", "phổi tắc", "xơ hoá", "nội mô", "dự trữ", "sinh lý", "sửa chữa", "chẩn đoán", "điều trị",
    "can thiệp", "phát hiện", "tiên lượng", "dịch tễ", "lâm sàng", "cơ chế", "bệnh sinh", "yếu tố", "nguy cơ", "tỷ lệ",
    "overdiagnosis", "overtreatment", "checkpoint", "frailty", "burnout", "sepsis", "vaccine", "apoptosis",
    "sa sút", "trầm cảm", "lo âu", "kiệt quệ", "suy kiệt", "hội tụ", "bệnh mạn", "mạn tính", "cấp tính",
    "kiểm soát", "chất lượng", "vệ sinh", "thời gian",
]
TRIPLES = [
    "đái tháo đường", "xơ vữa động", "vữa động mạch", "bệnh thận mạn", "suy đa tạng", "viêm mạn tính", "suy đa cơ", "bệnh tim bẩm",
    "tim bẩm sinh", "nhiễm trùng kéo", "kiểm soát nhiễm", "miễn dịch ung", "ức chế miễn", "điểm kiểm soát", "chất lượng xét",
    "vi sinh vật", "sinh vật chí", "phát hiện sớm", "can thiệp sớm", "chẩn đoán sớm",
]
LOANWORDS = ["sepsis", "overdiagnosis", "overtreatment", "checkpoint", "frailty", "burnout", "vaccine", "apoptosis", "cytokine", "biomarker", "pathway"]
GENERIC_CONCEPTS = ["can thiệp", "yếu tố", "quyết định", "theo dõi", "điều trị", "chẩn đoán", "kết quả", "thời gian", "kiểm soát", "chất lượng"]
NUMERIC_ASKED = ["bao nhiêu", "bao nhieu", "tỷ lệ", "ty le", "phần trăm", "phan tram", "karnofsky", "auc", " hr ", " or ", " rr ", " ci ", " điểm ", " diem "]
EXTERNAL_MARKERS = [
    "guideline", "hướng dẫn", "huong dan", "khuyến cáo", "khuyen cao", "liều", "lieu", "phác đồ", "phac do", "protocol", "regimen",
    "tỷ lệ", "ty le", "%", "auc", "or", "hr", "rr", "ci", "tiêu chuẩn", "tieu chuan", "chẩn đoán", "chan doan",
]
TRUSTED_DOMAINS = [
    "who.int", "ncbi.nlm.nih.gov", "nih.gov", "cdc.gov", "msdmanuals.com", "mayoclinic.org", "nice.org.uk", "escardio.org", "heart.org", "moh.gov.vn", "kcb.vn",
]
REFERENTS = ["it", "this", "that", "those", "they", "them", "its", "their", "what about", "how about", "and", "also", "too", "else", "more", "the same", "similar"]
WHY_ASKED = ["vì sao", "vi sao", "tại sao", "tai sao", "dựa trên", "dua tren", "nhóm yếu tố", "nhom yeu to", "quyết định", "quyet dinh"]
FOCUSED_ASKED = [*WHY_ASKED, "chỉ số", "chi so", "tiêu chí", "tieu chi"]
METHODS_ASKED = ["thiết kế", "thiet ke", "đối tượng", "doi tuong", "phương pháp", "phuong phap", "cỡ mẫu", "co mau", "chọn mẫu", "chon mau"]
PLAN_SECTIONS = ["Kết luận trực tiếp", "Giải thích nền tảng", "Phân tích chuyên sâu", "Bằng chứng từ tài liệu truy hồi", "Ý nghĩa thực hành và lưu ý an toàn"]
INSTITUTIONS = [r"benh vien [a-z0-9 ]{4,80}", r"truong dai hoc [a-z0-9 ]{4,80}", r"dai hoc y(?: khoa| duoc)? [a-z0-9 ]{2,80}"]
CUTOFFS = [" tap trung", " nghien cuu", " danh gia", " su dung", " de ", " nhung ", " ket qua", " hieu qua"]
PAYLOAD_KEYS = [
    "source_name", "source_id", "doc_type", "specialty", "audience", "trust_tier", "language", "title", "canonical_title", "section_title",
    "source_url", "updated_at", "heading_path", "tags", "doc_id", "article_id", "institution", "chunk_index",
]
SECONDARY_TYPES = ["comparative_synthesis", "guideline_comparison", "teaching_explainer", "professional_explainer"]
FALLBACK_OPENING = "Hệ thống sinh câu trả lời đang bị giới hạn tốc độ từ nhà cung cấp mô hình, nên dưới đây là tóm tắt trích xuất trực tiếp từ tài liệu chính đã truy hồi."
FALLBACK_EMPTY = "Yêu cầu không bị mất, nhưng chưa thể tổng hợp câu trả lời đầy đủ ở lượt này."
# ----------------------------------------------------------------------------
_NONE = "array<string>"


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def holds(text: Column, marks: list[str]) -> Column:
    return let(text, lambda t: F.exists(_list(marks), lambda m: F.contains(t, m)))  # the text is computed once, not for each mark


def _add(*rules: tuple[Column, float]) -> Column:
    """The sum of the points whose rule holds."""
    return sum((F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0.0) for rule, points in rules), F.lit(0.0))


def _word_hits(terms: Column, text: Column) -> Column:
    return let(words(text), lambda w: F.size(F.filter(terms, lambda t: F.contains(w, F.concat(F.lit(" "), t, F.lit(" "))))))


# ------------------------------------------------------------------ the question
def alias_term(query: Column, term: str) -> Column:
    """A folded question has a term: a whole word, or a phrase anywhere."""
    return F.contains(query, F.lit(term)) if " " in term else F.contains(words(query), F.lit(f" {term} "))


def expand_query(query: Column) -> Column:
    """A question with the hints whose terms it has all, in the order of the list."""
    q = F.regexp_replace(blank(query), r"^\s+|\s+$", "")

    def hints(folded: Column) -> Column:
        rules = [F.when(_all([alias_term(folded, t) for t in terms]), F.lit(hint)) for terms, hint in ALIAS_HINTS]
        return F.array_compact(F.array(*rules))

    return F.when(q == "", q).otherwise(let(let(fold(q), hints), lambda h: F.when(F.size(h) > 0, F.concat_ws(" ", q, F.array_join(h, " "))).otherwise(q)))


def _all(rules: list[Column]) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def asks_number(query: Column) -> Column:
    """The question asks for a figure, by the list of the coverage scorer."""
    return holds(F.lower(blank(query)), NUMERIC_ASKED)


def needs_rewriting(message: Column, history: Column) -> Column:
    """a follow-up of five words or fewer, or one that may refer to what was said; ``history``: number of earlier turns."""
    m = F.lower(F.regexp_replace(blank(message), r"^\s+|\s+$", ""))
    n = F.size(F.filter(F.split(m, r"\s+"), lambda w: w != ""))
    return (F.coalesce(history, F.lit(0)) > 0) & ((n <= 5) | holds(m, REFERENTS))


def institutions(text: Column) -> Column:
    """Up to four institutions named in an unaccented question."""
    found = F.concat(*[F.regexp_extract_all(title_norm(text), F.lit(f"({p})"), 1) for p in INSTITUTIONS])

    def cut(p: Column) -> Column:
        p = F.trim(p)
        for mark in CUTOFFS:
            p = F.trim(F.split_part(p, F.lit(mark), F.lit(1)))
        return F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")

    whole = F.filter(F.transform(found, cut), lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")) >= 3)
    return F.slice(F.array_distinct(whole), 1, 4)


def evidence_tokens(text: Column) -> Column:
    """Folded words of three signs or more that aren't stop words; repeats stay."""
    found = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)
    return F.filter(found, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(_list(EVIDENCE_STOPWORDS), w))


def evidence_phrases(query: Column) -> Column:
    """Up to twelve distinct phrases of three and two such words."""
    return phrases(evidence_tokens(query), (3, 2), 12)


def concepts(text: Column) -> Column:
    """C14: known compounds, triples and loan words of a text with composed letters, distinct, in that order."""
    t = nfc(F.lower(F.regexp_replace(blank(text), r"^\s+|\s+$", "")))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[\"'\[\](){}?!,;:…]", " "), r"\s+", " "))

    def grams(w: Column, n: int, known: list[str]) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")), lambda g: F.array_contains(_list(known), g))

    return let(F.split(t, " "), lambda w: F.array_distinct(F.concat(grams(w, 2, COMPOUNDS), grams(w, 3, TRIPLES), F.filter(w, lambda x: F.array_contains(_list(LOANWORDS), x)))))


def specific_concepts(found: Column) -> Column:
    """Concepts without the generic ones; repeats stay."""
    return F.filter(found, lambda c: ~F.array_contains(_list(GENERIC_CONCEPTS), c))


# ------------------------------------------------------------------ scores
def same_article_bonus(query: Column, text: Column, section: Column, meta: Column) -> Column:
    """How well a chunk of the primary article answers the question; ``meta``: the payload's metadata text."""

    def score(x: Column) -> Column:
        q, t, m, s = x["q"], x["t"], x["m"], x["s"]
        terms, short = query_terms(query), acronyms(query)
        by_terms = F.least(_word_hits(terms, t) * 0.18, F.lit(1.1)) + F.least(_word_hits(terms, m) * 0.06, F.lit(0.24))
        by_short = F.when(F.size(short) > 0, 0.45 * _word_hits(short, t) / F.size(short)).otherwise(0.0)
        found = F.filter(phrases(terms, (3, 2), 12), lambda p: F.contains(t, p))
        by_phrase = F.aggregate(found, F.lit(0.0), lambda a, p: a + F.when(F.size(F.split(p, " ")) >= 3, 0.3).otherwise(0.18))
        group, design = holds(q, GROUP_FACTORS_ASKED), holds(q, STUDY_DESIGN_ASKED)
        digits = F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Nd}", ""))
        points = _add(
            (holds(q, ["bao nhieu", "ty le", "phan tram", "diem"]) & (digits > 0), 0.35),
            (F.contains(q, F.lit("karnofsky")) & F.contains(t, F.lit("karnofsky")), 0.9),
            (F.contains(q, F.lit("ghep than")) & holds(t, ["rifampicin", "tacrolimus", "cyclosporine", "thai ghep"]), 2.0),
            (holds(q, ["cea", "cas"]) & holds(t, ["cea", "cas"]), 0.9),
            (F.contains(q, F.lit("chat luong song")) & F.contains(t, F.lit("chat luong song")), 0.6),
            (F.contains(q, F.lit("hoi phuc")) & F.contains(t, F.lit("hoi phuc")), 0.5),
            (F.contains(q, F.lit("van dong")) & F.contains(t, F.lit("van dong")), 0.45),
            (holds(q, ["theo doi", "noi khoa toi uu", "nguy co tim mach"]) & holds(t, ["theo doi", "noi khoa", "nguy co tim mach", "tai hep", "dot quy"]), 1.8),
            (group & holds(t, ["theo doi sau mo", "theo doi", "noi khoa ho tro", "kiem soat huyet ap", "roi loan lipid mau", "tai hep", "dot quy"]), 1.2),
            (holds(s, ["ket qua", "tom tat", "summary"]), 0.15),
            (design & holds(s, DESIGN_SECTION), 1.8), (design & holds(t, DESIGN_TEXT), 1.4), (design & holds(s, ["ket qua", "ban luan", "discussion"]), -0.25),
            (holds(t, ["title:", "source:", "audience:", "keywords:"]), -0.35),
            (group & (digits >= 12) & holds(t, ["rct", "95% ci", "or (", "tv/dq", "nmct"]), -1.8),
        )
        return F.round(by_terms + by_short + by_phrase + points, 4)

    return let(F.struct(fold(query).alias("q"), fold(text).alias("t"), fold(meta).alias("m"), fold(section).alias("s")), score)


def question(query: Column, asks_numeric: Column) -> Column:
    """What ``score_of`` looks at in a question, so that many sentences are scored with one look at it."""
    return let(fold(query), lambda q: F.struct(
        q.alias("q"), keywords(query).alias("words"), evidence_phrases(query).alias("phrases"), holds(q, STUDY_DESIGN_ASKED).alias("design"), asks_numeric.alias("numeric")))


def sentence_score(sentence: Column, query: Column, section: Column, asks_numeric: Column) -> Column:
    """How directly a sentence answers the question; -1 for a fragment of a header."""
    return let(question(query, asks_numeric), lambda a: score_of(sentence, a, section))


def score_of(sentence: Column, asked: Column, section: Column, folded: Column | None = None, folded_section: Column | None = None) -> Column:
    """C12 for a ``question``; with the folded forms of sentence and section, if known."""

    def score(x: Column) -> Column:
        q, t, s = asked["q"], x["t"], x["s"]
        design, asks_numeric = asked["design"], asked["numeric"]
        overlap = F.size(F.array_intersect(asked["words"], keywords(sentence))) * 1.5
        found = F.filter(asked["phrases"], lambda p: F.contains(t, p))
        by_phrase = F.aggregate(found, F.lit(0.0), lambda a, p: a + F.when(F.size(F.split(p, " ")) >= 3, 2.0).otherwise(1.2))
        points = _add(
            (asks_numeric & sentence.rlike(r"\p{Nd}"), 2.0),
            (F.contains(q, F.lit("karnofsky")) & F.contains(t, F.lit("karnofsky")), 3.0), (F.contains(q, F.lit("duy tri")) & F.contains(t, F.lit("duy tri")), 1.5),
            (F.contains(q, F.lit("pho bien nhat")) & F.contains(t, F.lit("pho bien nhat")), 2.0), (design & holds(t, DESIGN_SENTENCE), 3.0),
            (holds(s, ["ket qua", "ket luan", "tom tat"]), 0.8), (design & holds(s, DESIGN_SECTION), 2.2),
        )
        return F.when(holds(t, FRAGMENT_MARKERS), -1.0).otherwise(F.round(overlap + by_phrase + points, 6))

    return let(F.struct((fold(sentence) if folded is None else folded).alias("t"), (fold(section) if folded_section is None else folded_section).alias("s")), score)


# ------------------------------------------------------------------ decisions
def needs_external(query: Column, policy: Column, mode: Column, allowed: Column, most: Column, enabled: bool = False) -> Column:
    """outside sources are wanted: switched on, an open answer, and a risky question or permission."""
    open_ = (policy == "open_enriched") | mode.isin(["open_knowledge", "title_anchored"])
    return F.lit(enabled) & open_ & (holds(F.lower(blank(query)), EXTERNAL_MARKERS) | (allowed & (most > 0)))


def trusted_domain(url: Column) -> Column:
    """the address holds a trusted domain."""
    return holds(F.lower(blank(url)), TRUSTED_DOMAINS)


def needs_check(answer: Column, mode: Column, policy: Column, external_used: Column) -> Column:
    """the answer is to be verified."""
    n = F.size(F.filter(F.split(blank(answer), r"\s+"), lambda w: w != ""))
    return (mode != "evidence_strong") | (policy == "open_enriched") | external_used | (n > 800) | blank(answer).rlike(RISKY)


def needs_plan(policy: Column, mode: Column) -> Column:
    """the answer is to be planned."""
    return (policy == "open_enriched") | mode.isin(["open_knowledge", "title_anchored"])


def answer_plan(query: Column, policy: Column, mode: Column, unsupported: Column) -> Column:
    """O07 without a model: struct(enabled, status, sections, must_cover, open_knowledge_topics)."""
    on, none = needs_plan(policy, mode), F.array().cast(_NONE)
    pick = lambda value: F.when(on, value).otherwise(none)
    return F.struct(on.alias("enabled"), F.when(on, "heuristic").otherwise("skipped").alias("status"), pick(_list(PLAN_SECTIONS)).alias("sections"),
                    pick(F.array(blank(query))).alias("must_cover"), pick(F.coalesce(unsupported, none)).alias("open_knowledge_topics"))


def expands_primary(style: Column, query_type: Column, query: Column) -> Column:
    """the primary article's other chunks are wanted."""
    return (style == "exact") | (query_type == "teaching_explainer") | (style.isin(["summary", "bounded_partial"]) & holds(F.lower(blank(query)), WHY_ASKED))


def expansion_chunks(style: Column, query: Column) -> Column:
    """How many of them."""
    q = F.lower(blank(query))
    return F.when(style == "exact", F.when(holds(q, METHODS_ASKED), 10).otherwise(8)).otherwise(F.when(holds(q, FOCUSED_ASKED), 8).otherwise(6))


def opening_disclaimer(level: Column, abstain: Column, unsupported: Column, scope: Column) -> Column:
    """The answer must open with its limits."""
    return (level == "low") | ((F.size(abstain) > 0) & (level != "high")) | ((F.size(unsupported) > 0) & (blank(scope) == ""))


def includes_secondary(retrieval_mode: Column, query_type: Column) -> Column:
    """Secondary sources are shown."""
    return (retrieval_mode != "article_centric") & query_type.isin(SECONDARY_TYPES)


def coverage_instruction(level: Column, ceiling: Column, abstain: Column, missing: Column) -> Column:
    """What the prompt says of how far the evidence reaches."""
    parts = F.array_join(abstain, ", ")
    base = (F.when(level == "high", "Dữ liệu ĐẦY ĐỦ. Trả lời chi tiết dựa hoàn toàn trên evidence.")
            .when(level == "medium", F.concat(F.lit("Dữ liệu CÓ nhưng THIẾU một số phần."), F.when(F.size(abstain) > 0, F.concat(F.lit(" Nói rõ: '"), parts, F.lit("' không có trong tài liệu."))).otherwise("")))
            .otherwise(F.concat(F.lit("Dữ liệu KHÔNG ĐỦ. Phải nói rõ giới hạn."), F.when(F.size(abstain) > 0, F.concat(F.lit(" Đặc biệt thiếu: "), parts, F.lit("."))).otherwise(""))))
    sure = (F.when(ceiling == "moderate", 'MỨC CHẮC CHẮN: TRUNG BÌNH. Dùng ngôn ngữ thận trọng ("có thể", "gợi ý", "cần thêm nghiên cứu").')
            .when(ceiling == "low", "MỨC CHẮC CHẮN: THẤP. Dùng ngôn ngữ rất dè dặt. Nêu rõ bằng chứng yếu."))
    lacks = F.when(F.size(missing) > 0, F.concat(F.lit("Thiếu: "), F.array_join(missing, ", "), F.lit(". Nói rõ phần nào chưa có trong tài liệu.")))
    return F.concat_ws(" ", base, sure, lacks)


# ------------------------------------------------------------------ evidence
def evidence_text(title: Column, raw: Column, findings: Column, secondary: Column, external: Column) -> Column:
    """All evidence in one text: ``findings`` of (claim, span), ``secondary`` of (title, raw), ``external`` of (title, snippet, url)."""
    def flat(rows: Column, *names: str) -> Column:
        return F.flatten(F.transform(rows, lambda r: F.array(*[blank(r[n]) for n in names])))

    every = F.concat(F.array(blank(title), blank(raw)), flat(findings, "claim", "span"), flat(secondary, "title", "raw"), flat(external, "title", "snippet", "url"))
    return F.array_join(F.filter(every, lambda x: x != ""), "\n")


def source_count(title: Column, raw: Column, secondary: Column) -> Column:
    """The primary source, if there is any, and the secondary ones."""
    return F.when((blank(title) != "") | (blank(raw) != ""), 1).otherwise(0) + F.size(secondary)


def payload_metadata(payload: Column, nested: Column) -> Column:
    """the known keys of a payload; the nested metadata where it has none of them."""
    return let(F.map_filter(payload, lambda k, _: k.isin(PAYLOAD_KEYS)), lambda own: F.when(F.size(own) > 0, own).otherwise(F.coalesce(nested, own)))


def extractive_terms(text: Column) -> Column:
    """Distinct words of four signs or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(blank(text)), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)
    return F.filter(F.array_distinct(found), lambda w: (F.char_length(w) >= 4) & ~F.array_contains(_list(FALLBACK_STOPWORDS), w))


def answer_windows(text: Column) -> Column:
    """Sentences of up to 320 signs, then pairs of neighbours of 80 to 420 that read as sentences; else up to four spans of 260 signs, each 220 on."""

    def windows(clean: Column) -> Column:
        def pick(s: Column) -> Column:
            one = F.filter(s, lambda x: (F.char_length(x) <= 320) & sentence_candidate(x))
            two = F.filter(F.transform(F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
                                       lambda i: F.trim(F.concat_ws(" ", F.element_at(s, i), F.element_at(s, i + 1)))), lambda x: F.char_length(x).between(80, 420) & sentence_candidate(x))
            return F.concat(one, two)

        pieces = F.transform(F.filter(F.split(clean, r"(?<=[.?!;:])\s+"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"^[ \-]+|[ \-]+$", ""))
        spans = F.transform(F.when(F.char_length(clean) > 0, F.sequence(F.lit(0), F.char_length(clean) - 1, F.lit(220))).otherwise(F.array().cast("array<int>")),
                            lambda i: F.trim(F.substring(clean, i + 1, F.lit(260))))
        spare = F.slice(F.filter(spans, lambda x: F.char_length(x) >= 80), 1, 4)
        return let(let(pieces, pick), lambda found: F.when(F.size(found) > 0, found).otherwise(spare))

    return let(extractive(text), windows)


def fallback_answer(question: Column, scope: Column, title: Column, claims: Column, conclusion: Column, raw: Column, windows: Column | None = None) -> Column:
    """The three best sentences by words of the question, figures and length, as the answer that needs no model; ``windows``: those of ``raw``, if known."""
    windows = answer_windows(raw) if windows is None else windows
    terms = extractive_terms(F.concat_ws(" ", blank(question), blank(scope), blank(title)))
    every = F.filter(F.concat(F.transform(F.coalesce(claims, F.array().cast(_NONE)), lambda c: F.trim(c)), F.array(F.trim(blank(conclusion))), windows), lambda x: x != "")

    def rank(x: Column) -> Column:
        # equal texts stand side by side, the first one first: no text is sought among all
        first = F.filter(x["low"], lambda y, j: (j == 0) | (F.get(x["low"], j - 1)["k"] != y["k"]))
        rows = F.transform(first, lambda y: let(F.get(x["every"], y["i"]), lambda c: F.struct(
            (-F.size(F.filter(x["terms"], lambda w: F.contains(y["k"], w)))).alias("o"), F.when(c.rlike(r"(?i)\b[0-9]+\b|%|OR|HR|AUC|n\s*="), -1).otherwise(0).alias("n"),
            (-F.char_length(c)).alias("l"), y["i"].alias("i"), c.alias("c"))))
        return F.transform(F.slice(F.array_sort(rows), 1, 3), lambda r: F.concat(F.lit("- "), r["c"]))

    low = lambda e: F.array_sort(F.transform(e, lambda c, i: F.struct(F.lower(c).alias("k"), i.alias("i"))))
    best = let(let(every, lambda e: F.struct(e.alias("every"), low(e).alias("low"), terms.alias("terms"))), rank)
    body = F.when(F.size(best) > 0, F.concat(F.array(F.lit("Tóm tắt nhanh:")), best)).otherwise(_list([FALLBACK_EMPTY]))
    source = F.when(blank(title) != "", F.array(F.concat(F.lit("Nguồn chính: [1] "), title))).otherwise(F.array().cast(_NONE))
    return F.array_join(F.concat(_list([FALLBACK_OPENING]), body, source), "\n")
