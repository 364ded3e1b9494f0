"""Triage of seed texts: ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, digit_ratio, let, narrative_sentences, special_ratio, squeeze, strip_marks, table_heavy

# ---------------------------------------------------------------- fixed values
LEAST_BODY, LEAST_TITLE, LEAST_SENTENCES, LEAST_SCORE = 400, 15, 3, 85
MOST_DIGITS, MOST_SPECIAL = 0.10, 0.10
REFERENCE_TITLE = (
    r"^[0-9]+\.\s*$|^[0-9]+\.\s*[a-z]*$|\bdoi\b|[0-9]+\([0-9]+\)\s*:\s*[0-9]+|[0-9]{4};\s*[0-9]+\s*:\s*[0-9]+|\btr\.\s*[0-9]+|nhà xuất bản|\bmed ultrason\b"
    r"|\bplast reconstr surg\b|\bjournal\b|mayo clin proc|[a-z0-9]+\.[0-9]{4}\.[0-9]+|^[0-9]+\.\s+[a-z]{1,4}\s+[a-z]{1,2}\.*"
)
TRUNCATED = ["và ", "trong ", "của ", "với ", "tại "]
AUTHOR = r"[A-Za-zÀ-ỹ]+\s+[A-Za-zÀ-ỹ]+\s+[A-Za-zÀ-ỹ]+[0-9]"
REFERENCES = ["tài liệu tham khảo", "references", "bibliography"]
FORM = [
    "phiếu", "biểu mẫu", "bộ công cụ", "checklist", "đúng/không đúng", "không biết", "hoàn thành phần", "stt câu hỏi", "câu hỏi trả lời", "thang đo", "thang điểm",
    "bảng điểm", "trắc nghiệm", "mini-cog", "mmse", "zung", "hachinski", "test ", "pcl-5", "bệnh án ra viện", "người bệnh chuyển khoa", "tổng kết bệnh án",
    "thông tin hành chính", "đánh giá hành vi",
]
ADMIN = [
    "cong hoa xa hoi chu nghia", "kt. bo truong", "kt.bo truong", "ban hanh kem", "quyet dinh so", "uy ban nhan dan", "chu bien", "chu tich hoi dong",
    "danh sach nhan cong van", "van ban > chi dao dieu hanh", "chuyen vien", "phong ke hoach tong hop", "ve nhap vien noi tru", "thong tin kham benh", "cong van",
    "co so kham, chua benh", "truong khoa", "giam doc",
]
CONFERENCE = ["hội nghị khoa học", "kỷ yếu", "kỷ yếu đặc biệt", "chuyên đề:", "hội thảo"]
GENERIC = ["dấu hiệu lâm sàng", "triệu chứng", "chẩn đoán", "điều trị", "theo dõi", "đại cương", "tổng quan", "b. thông tin khám bệnh"]
GENERIC_STARTS = ["nguyên tắc áp dụng", "nguyên tắc xây dựng", "các bước tiến hành", "những sai sót và xử trí", "tiêu chuẩn đánh giá", "nguyên nhân tử vong"]
CLINICAL = [
    "bệnh ", "hội chứng", "viêm ", "ung thư", "suy ", "nhiễm ", "đái tháo đường", "cao huyết áp", "thận", "gan", "phổi", "tim", "chẩn đoán", "điều trị", "phác đồ",
    "triệu chứng", "chỉ định", "chống chỉ định", "lâm sàng", "cận lâm sàng", "thuốc",
]
CASE_REPORT = ["ca lâm sàng", "nhân một trường hợp", "case report"]
# ----------------------------------------------------------------------------


def _has(c: Column, marks: list[str]) -> Column:
    return let(c, lambda t: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(t, m)))


def _starts(c: Column, marks: list[str]) -> Column:
    return let(c, lambda t: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.startswith(t, m)))


def _joined(title: Column, low: Column, n: int | None = None) -> Column:
    return F.concat(F.lower(blank(title)), F.lit(" "), low if n is None else F.substring(low, 1, n))


def _both(title: Column, body: Column, n: int | None = None) -> Column:
    return _joined(title, F.lower(blank(body)), n)


def symbolic_title(c: Column) -> Column:
    """Few letters, or digits and signs alone."""
    t = F.trim(blank(c))
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (t == "") | (letters / F.greatest(F.char_length(t), F.lit(1)) < 0.25) | t.rlike(r"^[0-9\s.\-_/\\()]+$") | t.rlike(r"^[.…•·\s]+$")


def reference_title(c: Column) -> Column:
    """H49."""
    return F.trim(F.lower(blank(c))).rlike(REFERENCE_TITLE)


def author_line(c: Column) -> Column:
    """A name with a digit, or commas and digits."""
    t = F.trim(blank(c))
    return t.rlike(AUTHOR) | (F.contains(t, F.lit(",")) & (F.char_length(F.regexp_replace(t, r"[^\p{Nd}]", "")) >= 2) & (F.char_length(t) < 140))


def equation_title(c: Column) -> Column:
    t = F.lower(blank(c))
    return F.contains(t, F.lit("=")) | t.rlike(r"\bod[a-z0-9\s]*\+")


def form(title: Column, body: Column) -> Column:
    """H51."""
    return _has(_both(title, body), FORM)


def admin(title: Column, body: Column) -> Column:
    """On accent-free text (đ stays) of title and the body's first 700 signs."""
    return _has(strip_marks(_both(title, body, 700)), ADMIN)


def conference(title: Column, body: Column) -> Column:
    """H53."""
    return _has(_both(title, body, 300), CONFERENCE)


def generic_heading(c: Column) -> Column:
    """H54."""
    t = F.trim(F.lower(blank(c)))
    return t.isin(GENERIC) | _starts(t, GENERIC_STARTS) | t.rlike(r"^([0-9]+\.|(i|ii|iii|iv|v|vi|vii|viii)\.)\s") | t.rlike(r"^[a-z]\.\s")


def clinical(title: Column, body: Column) -> Column:
    """H55."""
    return _has(_both(title, body, 1200), CLINICAL)


def triage(title: Column, body: Column, score: Column, journal: Column, hospital: Column) -> Column:
    """struct(quality, reason): reject, borderline or high; ``journal`` and ``hospital`` turn on rules of such sources."""
    return let(F.struct(squeeze(title).alias("t"), squeeze(body).alias("b")), lambda x: let(
        F.struct(F.lower(x["b"]).alias("low"), table_heavy(x["b"]).alias("tables"), digit_ratio(x["b"]).alias("digits")), lambda y: _rules(x["t"], x["b"], score, journal, hospital, y["low"], y["tables"], y["digits"])))


def _rules(t: Column, b: Column, score: Column, journal: Column, hospital: Column, low: Column, tables: Column, digits: Column) -> Column:
    n = F.char_length(b)
    rules = [
        (F.coalesce(score, F.lit(100)) < LEAST_SCORE, "low_quality_score"), (n < LEAST_BODY, "too_short"), (F.char_length(t) < LEAST_TITLE, "weak_title_too_short"),
        (_starts(F.lower(t), TRUNCATED), "truncated_title"), (F.contains(t, F.lit("\\")), "encoding_garbage"), (symbolic_title(t), "numeric_or_symbolic_title"),
        (reference_title(t), "reference_like_title"), (author_line(t), "author_line_title"), (equation_title(t), "equation_lab_fragment"), (_has(low, REFERENCES), "references"),
        (_has(strip_marks(_joined(t, low, 700)), ADMIN), "administrative_cover"), (_has(_joined(t, low, 300), CONFERENCE), "conference_header"), (_has(_joined(t, low), FORM), "questionnaire_form"), (generic_heading(t), "generic_heading"),
        (journal & (F.contains(low, F.lit("doi:")) | low.rlike(r"[0-9]+\([0-9]+\)\s*:\s*[0-9]+")), "bibliographic_fragment"),
        (hospital & (F.lower(t).rlike(r"test\s*[0-9]+\s*:") | F.substring(low, 1, 300).rlike(r"test\s*[0-9]+\s*:")), "non_medical_test"),
        (hospital & ~_has(_joined(t, low, 1200), CLINICAL), "lack_of_clinical_signal"), (digits > MOST_DIGITS, "high_digit_ratio"), (special_ratio(b) > MOST_SPECIAL, "high_special_ratio"),
        (narrative_sentences(b) < LEAST_SENTENCES, "lack_of_narrative"), ((tables > 8) & (n < 1200), "table_figure_heavy"),
    ]
    # the first rule that holds, found once; the rules behind it aren't looked at
    first = F.lit(0)
    for i, (c, _) in reversed(list(enumerate(rules, 1))):
        first = F.when(c, i).otherwise(first)
    case, heavy = _has(F.lower(t), CASE_REPORT), (tables > 4) | (digits > 0.07)
    names = F.array(*[F.lit(r) for _, r in rules])

    def verdict(i: Column) -> Column:
        return F.struct(
            F.when(i > 0, "reject").when(case | heavy, "borderline").otherwise("high").alias("quality"),
            F.when(i > 0, F.try_element_at(names, i.cast("int"))).when(case, "case_report").when(heavy, "slightly_heavy_data").otherwise("valid").alias("reason"))

    return let(first, verdict)
