"""Predicates and quality scores over the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scores as S
from ..functions import text as T
from .registry import scalar
from .text_queries import _CITE, _CITE_SQL, heading, joined, line_ratio, quoted, tokens

_B, _T, _ID = (lambda: F.col("body")), (lambda: F.col("title")), (lambda: F.col("doc_id"))


def sql_text(s: str) -> str:
    return s.replace("'", "''")


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def flags(*pairs: tuple[str, str]) -> str:
    """SQL list of the texts whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


# columns that the tables lack are derived, so that every branch is met
_KIND = lambda: F.when(_ID() % 7 == 0, "poster").otherwise(F.element_at(F.array(*[F.lit(k) for k in P.DOC_TYPES]), (_ID() % 11 + 1).cast("int")))
_KIND_SQL = f"CASE WHEN doc_id % 7 = 0 THEN 'poster' ELSE {quoted(P.DOC_TYPES)}[(doc_id % 11 + 1)::INT] END"
_WHO = lambda: F.when(_ID() % 5 == 0, "robot").otherwise("patient")
_WHO_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'robot' ELSE 'patient' END"
_TIER, _TIER_SQL = (lambda: (_ID() % 4).cast("int")), "(doc_id % 4)::INT"
_NAME = lambda: F.when(_ID() % 6 == 0, " ").otherwise(F.col("source_name"))
_NAME_SQL = "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE source_name END"
scalar("f01_record_errors", {"errors": (lambda: F.array_join(P.record_errors(_ID().cast("string"), _T(), _B(), _NAME(), _KIND(), _WHO(), _TIER()), "; "),
    "array_to_string(" + flags(
        ("trim(doc_id::VARCHAR) = ''", "'doc_id is required'"), ("trim(title) = ''", "'title is required'"), ("trim(body) = ''", "'body is required'"),
        (f"trim({_NAME_SQL}) = ''", "'source_name is required'"), ("doc_id % 7 = 0", "'doc_type ''poster'' is unknown'"),
        ("doc_id % 5 = 0", "'audience ''robot'' is unknown'"), ("doc_id % 4 = 0", "'trust_tier must be one of [1, 2, 3]'")) + ", '; ')")})
_URL = lambda: F.element_at(F.array(F.lit(""), F.lit("https://a.example/x"), F.lit("ftp://a.example/x"), F.lit("http://"), F.lit("HTTP://b.example")), (_ID() % 5 + 1).cast("int"))
_URL_SQL = "['', 'https://a.example/x', 'ftp://a.example/x', 'http://', 'HTTP://b.example'][(doc_id % 5 + 1)::INT]"
scalar("f03_valid_url", {"value": (lambda: P.valid_url(_URL()), f"{_URL_SQL} = '' OR regexp_matches({_URL_SQL}, '(?i)^https?://[^/?#]+')")})
_HTML = lambda: F.concat(_B(), F.when(_ID() % 3 == 0, "<DIV>").when(_ID() % 3 == 1, " class='x'").otherwise(""))
scalar("f04_html_remnants", {"value": (lambda: P.html_remnants(_HTML()), f"""regexp_matches(body || CASE doc_id % 3 WHEN 0 THEN '<DIV>' WHEN 1 THEN ' class=''x''' ELSE '' END, '{sql_text(P.HTML_REMNANTS)}|{sql_text(P.HTML_ATTRIBUTES)}')""")})
_DAY = ["", "2024", "2024-05", "2024-05-06", "5/6/2024", "May 2024"]
scalar("f05_valid_date", {"value": (lambda: P.valid_date(F.element_at(F.array(*[F.lit(d) for d in _DAY]), (_ID() % 6 + 1).cast("int"))), f"({quoted(_DAY)}[(doc_id % 6 + 1)::INT]) = '' OR regexp_matches({quoted(_DAY)}[(doc_id % 6 + 1)::INT], '{P.DATE}')")})
_DROP = ["title_missing_or_bad", "body_very_short"]
_FL = lambda: F.when(_ID() % 4 == 0, F.array(F.lit("body_very_short"), F.lit("x"))).otherwise(F.array(F.lit("x")))
scalar("f06_embed_reasons", {"reasons": (lambda: F.array_join(P.embed_reasons(_T(), _B(), _URL(), F.when(_ID() % 9 == 0, "hold").otherwise("go"), _FL(), _DROP), "; "),
    "array_to_string(list_concat(" + flags(("trim(title) = ''", "'missing_title'"), ("trim(title) <> '' AND lower(title) IN ('pdf', 'document', 'untitled', 'unknown')", "'bad_title'"),
        ("regexp_full_match(trim(title), '(?i)[0-9a-f]{16,}')", "'hex_like_title'"), (f"{bare('body')} = ''", "'missing_body'"), (f"{bare('body')} <> '' AND len({bare('body')}) < 120", "'body_too_short'"),
        (f"trim({_URL_SQL}) = ''", "'missing_source_url'"), ("doc_id % 9 = 0", "'quality_hold'")) + ", CASE WHEN doc_id % 4 = 0 THEN ['flag:body_very_short'] ELSE [] END), '; ')")})
scalar("f08_passes_gate", {"value": (lambda: P.passes_gate(F.when(_ID() % 3 == 0, "GO").when(_ID() % 3 == 1, "review").otherwise("odd"), "review"), "doc_id % 3 IN (0, 1)")})
scalar("f09_noise_chunk", {"value": (lambda: P.noise_chunk(F.lit("body"), _CITE()), f"({line_ratio(_CITE_SQL, T.REFERENCE_LINE)}) >= 0.7")})
_J = lambda: F.when(_ID() % 5 == 0, F.concat(F.lit("References\n2019;156(7):1951-1968 2020;1:2 2021;9:3 "), F.substring(_B(), 1, 100))).when(_ID() % 5 == 1, F.concat(_B(), F.lit(" 10.1234/ab 10.5678/cd"))).otherwise(_B())
_J_SQL = "(CASE doc_id % 5 WHEN 0 THEN 'References' || chr(10) || '2019;156(7):1951-1968 2020;1:2 2021;9:3 ' || left(body, 100) WHEN 1 THEN body || ' 10.1234/ab 10.5678/cd' ELSE body END)"
_X = bare(_J_SQL)


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{sql_text(p)}'))"


scalar("f10_junk_chunk", {"value": (lambda: P.junk_chunk(_J()), f"""len({_X}) = 0 OR (len({_X}) < 30 AND NOT contains({_X}, '.')) OR (regexp_matches({_X}, '{sql_text(P.REFERENCE_MARK)}')
  AND (len({_X}) < 200 OR len(regexp_extract({_X}, '(?s)^(.*?){sql_text(P.REFERENCE_MARK).replace('(?:^|', '(?:' + chr(92) + 'A|').replace('(?i)', '(?i:') + ')'}', 1)) < 50))
  OR ({count(_X, P.BIBLIO_DENSE)} >= 3 AND len({_X}) < 500) OR {count(_X, P.DOI)} >= 2 OR ({count(_X, P.JOURNAL_REF)} >= 2 AND {count(_X, P.BIBLIO_DENSE)} >= 2)
  OR (len({_X}) > 10 AND (len({_X}) - len(regexp_replace({_X}, '{sql_text(P.PUNCTUATION)}', '', 'g'))) / len({_X}) > 0.40)""")})
_NAV = lambda: F.when(_ID() % 3 == 0, F.concat(F.lit("Skip to content | Privacy Policy "), _B())).otherwise(_B())
scalar("f33_navigation_text", {"value": (lambda: P.navigation_text(_NAV()), " + ".join(f"regexp_matches(lower(left(CASE WHEN doc_id % 3 = 0 THEN 'Skip to content | Privacy Policy ' || body ELSE body END, 300)), '{p}')::INT" for p in P.NAVIGATION) + " >= 2")})
_LW = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]{{4,}}'))"
scalar("f34_mixed_topics", {"value": (lambda: P.mixed_topics(_T(), F.substring(_B(), 60, 800)), f"len({_LW.format('title')}) > 0 AND len(list_intersect({_LW.format('title')}, {_LW.format('left(substring(body, 60, 800), 500)')})) / len({_LW.format('title')}) < 0.15")})
_LI = lambda: F.concat(_B(), F.when(_ID() % 4 == 0, "\n- item one").when(_ID() % 4 == 1, "\n2. item (two)").when(_ID() % 4 == 2, "\na | b\nc | d\n").otherwise("\n* x\n3) y"))
_LI_SQL = "(body || CASE doc_id % 4 WHEN 0 THEN chr(10) || '- item one' WHEN 1 THEN chr(10) || '2. item (two)' WHEN 2 THEN chr(10) || 'a | b' || chr(10) || 'c | d' || chr(10) ELSE chr(10) || '* x' || chr(10) || '3) y' END)"
_LAST = f"trim(string_split({bare(_LI_SQL)}, chr(10))[-1])"
scalar("f35_truncated_list", {"value": (lambda: P.truncated_list(_LI()), rf"regexp_matches({_LAST}, '^[-*0-9.]+\s') AND NOT regexp_matches({_LAST}, '[.):]$')")})
_BARS = f"list_filter(string_split({_LI_SQL}, chr(10)), lambda l: contains(l, '|'))"
scalar("f36_truncated_table", {"value": (lambda: P.truncated_table(_LI()), f"len({_BARS}) >= 2 AND NOT ends_with(trim({_BARS}[-1]), '|')")})
scalar("f37_list_items", {"value": (lambda: P.list_items(_LI()), rf"len(list_filter(string_split({_LI_SQL}, chr(10)), lambda l: regexp_matches(l, '^\s*([-*•]|[0-9]+[.)])\s'))) >= 2")})
scalar("h06_weak_title", {"value": (lambda: P.weak_title(_T()), r"len(trim(title)) < 15 OR regexp_matches(trim(title), '^\p{Ll}')")})

_SEC, _SEC_SQL = (lambda: (_ID() % 3).cast("int")), "(doc_id % 3)"
_HT = f"lower({heading('title')})"
_BAD = f"({_HT} = '' OR {_HT} IN ('pdf', 'document', 'untitled'))"
_REF, _TAB = line_ratio(_CITE_SQL, T.REFERENCE_LINE), line_ratio(_CITE_SQL, T.TABLE_LINE)
_N = f"len({bare(_CITE_SQL)})"
_RULES = [
    (_BAD, 45, "title_missing_or_bad"), (f"NOT {_BAD} AND len({heading('title')}) < 20", 10, "title_too_short"),
    (f"NOT {_BAD} AND regexp_matches(title, '{S.TITLE_REFERENCE}')", 30, "title_looks_like_reference"), (f"NOT {_BAD} AND regexp_matches(title, '{S.TITLE_TABLE.replace('(?iu)', '(?i)')}')", 30, "title_looks_like_table_header"),
    (f"{_N} < 200", 45, "body_very_short"), (f"{_N} >= 200 AND {_N} < 500", 20, "body_too_short"), (f"({_REF}) >= 0.55", 40, "reference_heavy_body"),
    (f"({_REF}) >= 0.25 AND ({_REF}) < 0.55", 20, "reference_noise_detected"), (f"({_TAB}) >= 0.65", 20, "table_heavy_body"), (f"trim({_URL_SQL}) = ''", 10, "missing_source_url"),
    (f"trim({_NAME_SQL}) = ''", 10, "missing_source_name"), ("trim(language) = ''", 5, "missing_language"), ("false", 5, "missing_doc_type"),
    ("doc_id % 3 = 0", 10, "no_sections_detected"), (f"doc_id % 3 = 1 AND {_N} > 4000", 10, "single_large_section"),
]
_QUALITY = lambda: S.ingest_quality(_T(), _CITE(), _URL(), _NAME(), F.col("language"), _KIND(), _SEC(), F.lit(False))
_Q = lambda: F.col("__q")
_Q_SQL = "greatest(0, 100 - (" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v, _ in _RULES) + "))"
_ST_SQL = f"CASE WHEN {_Q_SQL} >= 85 THEN 'go' WHEN {_Q_SQL} >= 70 THEN 'review' ELSE 'hold' END"
_FL_SQL = flags(*[(c, f"'{t}'") for c, _, t in _RULES])
scalar("c02_ingest_quality", {"score": (lambda: _Q()["score"], _Q_SQL), "status": (lambda: _Q()["status"], _ST_SQL), "flags": (lambda: F.array_join(_Q()["flags"], ","), f"array_to_string(list_sort({_FL_SQL}), ',')")}, {"__q": lambda: _QUALITY()})
_OLD = lambda: F.when(_ID() % 4 == 0, "hold").when(_ID() % 4 == 1, "go").otherwise(None)
_U = lambda: S.merge_quality(_OLD(), F.when(_ID() % 2 == 0, F.lit(60)).otherwise(F.lit(None)), F.array(F.lit("seen")), _Q())
scalar("u07_merge_quality", {"score": (lambda: _U()["score"], f"CASE WHEN doc_id % 2 = 0 THEN least(60, {_Q_SQL}) ELSE {_Q_SQL} END"), "status": (lambda: _U()["status"], f"CASE WHEN doc_id % 4 = 0 THEN 'hold' ELSE {_ST_SQL} END"),
    "flags": (lambda: F.array_join(_U()["flags"], ","), f"array_to_string(list_sort(list_concat({_FL_SQL}, ['seen'])), ',')")}, {"__q": lambda: _QUALITY()})
_CQ = bare(_J_SQL)
_CW = rf"list_filter(regexp_split_to_array(lower({_CQ}), '\s+'), lambda w: w <> '')"
_SH = lambda p: f"((len({_CQ}) - len(regexp_replace({_CQ}, '{sql_text(p)}', '', 'g'))) / len({_CQ}))"
_HITS = f"len(list_intersect(list_distinct({_CW}), {quoted(S.DOMAIN_TERMS)}))"
_D, _PU = _SH(r"\p{Nd}"), _SH(P.PUNCTUATION)
scalar("c03_chunk_quality", {"value": (lambda: F.round(S.chunk_quality(_J()), 6), f"""round(CASE WHEN len({_CQ}) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0
  - CASE WHEN len({_CQ}) > 20 AND {_D} > 0.35 THEN 0.2 WHEN len({_CQ}) > 20 AND {_D} > 0.25 THEN 0.1 ELSE 0 END
  - CASE WHEN len({_CQ}) > 20 AND {_PU} > 0.30 THEN 0.15 WHEN len({_CQ}) > 20 AND {_PU} > 0.20 THEN 0.05 ELSE 0 END
  - 0.1 * least({count(_CQ, P.CITATION_LINE)}, 3) - 0.1 * least({count(_CQ, P.DOI)}, 2)
  - CASE WHEN len({_CW}) > 5 AND len(list_distinct({_CW})) / len({_CW}) < 0.3 THEN 0.1 ELSE 0 END
  - CASE WHEN NOT contains({_CQ}, '.') AND len({_CQ}) > 50 THEN 0.1 ELSE 0 END - CASE WHEN len({_CQ}) < 80 THEN 0.1 ELSE 0 END
  + CASE WHEN {_HITS} >= 3 THEN 0.05 WHEN {_HITS} = 0 AND len({_CW}) > 10 THEN -0.1 ELSE 0 END)) END::DOUBLE, 6)""")})
scalar("c20_length_score", {"value": (lambda: S.length_score(F.size(T.tokenize(_T())), (_ID() % 12).cast("int")), f"CASE WHEN doc_id % 12 <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, len({tokens('title')}) / (doc_id % 12))) END")})
