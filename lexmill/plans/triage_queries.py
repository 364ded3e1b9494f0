"""Seed triage over the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import triage as G
from .registry import scalar
from .text_queries import quoted, sq

TITLES = ["và một phần của bài viết", "4. Gedde SJ study of eyes", "Nguyễn Văn An1, Trần Thị B2", "OD1 = x + 2 of the test", "Chẩn đoán", "12345 6789 .... 000 11", "Phiếu khảo sát người bệnh", "case report of a rare thing", "Hội thảo chuyên ngành 2020"]
_T = lambda: F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.floor(F.col("doc_id") / 3) % len(TITLES) + 1).cast("int"))).otherwise(F.col("title"))
_TS = f"(CASE WHEN doc_id % 3 = 0 THEN {quoted(TITLES)}[(doc_id // 3 % {len(TITLES)} + 1)::INT] ELSE title END)"
_B, _ID = (lambda: F.col("body")), (lambda: F.col("doc_id"))
_Q, _QB = sq(_TS), sq("body")


def _has(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


def _starts(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{m}')" for m in marks) + ")"


def _both(n: int | None = None) -> str:
    return f"(lower({_Q}) || ' ' || {f'lower({_QB})' if n is None else f'left(lower({_QB}), {n})'})"


_SYM = rf"({_Q} = '' OR len(regexp_replace({_Q}, '[^\p{{L}}]', '', 'g')) / greatest(len({_Q}), 1) < 0.25 OR regexp_matches({_Q}, '^[0-9\s.\-_/\\()]+$') OR regexp_matches({_Q}, '^[.…•·\s]+$'))"
_REF = f"regexp_matches(lower({_Q}), '{G.REFERENCE_TITLE}')"
_AUT = rf"(regexp_matches({_Q}, '{G.AUTHOR}') OR (contains({_Q}, ',') AND len(regexp_replace({_Q}, '[^\p{{Nd}}]', '', 'g')) >= 2 AND len({_Q}) < 140))"
_EQ = rf"(contains({_Q}, '=') OR regexp_matches(lower({_Q}), '\bod[a-z0-9\s]*\+'))"
_GEN = rf"(lower({_Q}) IN ({', '.join(repr(g) for g in G.GENERIC)}) OR {_starts(f'lower({_Q})', G.GENERIC_STARTS)} OR regexp_matches(lower({_Q}), '^([0-9]+\.|(i|ii|iii|iv|v|vi|vii|viii)\.)\s') OR regexp_matches(lower({_Q}), '^[a-z]\.\s'))"
_ADM, _CONF, _FORM, _CLI = _has(f"strip_accents({_both(700)})", G.ADMIN), _has(_both(300), G.CONFERENCE), _has(_both(), G.FORM), _has(_both(1200), G.CLINICAL)
scalar("h48_symbolic_title", {"value": (lambda: G.symbolic_title(_T()), _SYM.replace(_Q, f"trim({_TS})"))})
scalar("h49_reference_title", {"value": (lambda: G.reference_title(_T()), f"regexp_matches(trim(lower({_TS})), '{G.REFERENCE_TITLE}')")})
scalar("h50_author_line", {"value": (lambda: G.author_line(_T()), _AUT.replace(_Q, f"trim({_TS})"))})
scalar("h51_h53_structures", {
    "form": (lambda: G.form(_T(), _B()), _has(f"(lower({_TS}) || ' ' || lower(body))", G.FORM)), "admin": (lambda: G.admin(_T(), _B()), _has(f"strip_accents(lower({_TS}) || ' ' || left(lower(body), 700))", G.ADMIN)),
    "conference": (lambda: G.conference(_T(), _B()), _has(f"(lower({_TS}) || ' ' || left(lower(body), 300))", G.CONFERENCE))})
scalar("h54_generic_heading", {"value": (lambda: G.generic_heading(_T()), _GEN.replace(_Q, f"trim({_TS})"))})
scalar("h55_clinical_signal", {"value": (lambda: G.clinical(_T(), _B()), _has(f"(lower({_TS}) || ' ' || left(lower(body), 1200))", G.CLINICAL))})
_DIG = rf"(CASE WHEN {_QB} = '' THEN 1.0 ELSE len(regexp_replace({_QB}, '[^\p{{Nd}}]', '', 'g')) / len({_QB}) END)"
_SPE = rf"""(CASE WHEN {_QB} = '' THEN 1.0 ELSE (len({_QB}) - len(regexp_replace({_QB}, '[^\p{{L}}\p{{N}}\s.,;:!?()%/\-+\[\]"''–—]', '', 'g'))) / len({_QB}) END)"""
_NAR = rf"len(list_filter(regexp_split_to_array({_QB}, '[.!?]'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) > 5))"
_TAB = "(" + " + ".join(f"(len(lower({_QB})) - len(replace(lower({_QB}), '{m}', ''))) // {len(m)}" for m in ("bảng ", "biểu đồ ", "figure ", "table ", "n=", "%", "±")) + ")"
_RULES = [
    ("doc_id % 13 = 0", "low_quality_score"), (f"len({_QB}) < 400", "too_short"), (f"len({_Q}) < 15", "weak_title_too_short"), (_starts(f"lower({_Q})", G.TRUNCATED), "truncated_title"), (f"contains({_Q}, '\\')", "encoding_garbage"),
    (_SYM, "numeric_or_symbolic_title"), (_REF, "reference_like_title"), (_AUT, "author_line_title"), (_EQ, "equation_lab_fragment"), (_has(f"lower({_QB})", G.REFERENCES), "references"), (_ADM, "administrative_cover"), (_CONF, "conference_header"),
    (_FORM, "questionnaire_form"), (_GEN, "generic_heading"), (rf"doc_id % 4 = 0 AND (contains(lower({_QB}), 'doi:') OR regexp_matches(lower({_QB}), '[0-9]+\([0-9]+\)\s*:\s*[0-9]+'))", "bibliographic_fragment"),
    (rf"doc_id % 4 = 1 AND (regexp_matches(lower({_Q}), 'test\s*[0-9]+\s*:') OR regexp_matches(left(lower({_QB}), 300), 'test\s*[0-9]+\s*:'))", "non_medical_test"), (f"doc_id % 4 = 1 AND NOT {_CLI}", "lack_of_clinical_signal"),
    (f"{_DIG} > 0.10", "high_digit_ratio"), (f"{_SPE} > 0.10", "high_special_ratio"), (f"{_NAR} < 3", "lack_of_narrative"), (f"{_TAB} > 8 AND len({_QB}) < 1200", "table_figure_heavy"),
]
_CASE, _HEAVY = _has(f"lower({_Q})", G.CASE_REPORT), f"({_TAB} > 4 OR {_DIG} > 0.07)"
_TRIAGE = lambda: G.triage(_T(), _B(), F.when(_ID() % 13 == 0, 80).otherwise(90), _ID() % 4 == 0, _ID() % 4 == 1)
scalar("f31_seed_triage", {
    "quality": (lambda: F.col("__t.quality"), "CASE " + " ".join(f"WHEN {c} THEN 'reject'" for c, _ in _RULES) + f" WHEN {_CASE} OR {_HEAVY} THEN 'borderline' ELSE 'high' END"),
    "reason": (lambda: F.col("__t.reason"), "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in _RULES) + f" WHEN {_CASE} THEN 'case_report' WHEN {_HEAVY} THEN 'slightly_heavy_data' ELSE 'valid' END")}, {"__t": _TRIAGE})
