"""Text scalars and predicates over the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import scalar

_B, _T = (lambda: F.col("body")), (lambda: F.col("title"))


def sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fold(x: str) -> str:
    return sq(f"lower(strip_accents({x}))")


def fold_d(x: str) -> str:
    return sq(f"lower(translate(strip_accents({x}), 'đĐ', 'dD'))")


def norm(x: str) -> str:
    return sq(f"lower({x})")


def title_norm(x: str) -> str:
    return rf"""regexp_replace({sq(rf"regexp_replace(trim(lower(regexp_replace({x}, '[\[\]\\]', '', 'g'))), '[0-9]{{1,3}}$', '')")}, '^[.,;:\- ]+|[.,;:\- ]+$', '', 'g')"""


def title_key(x: str) -> str:
    return sq(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')")


def slug(x: str, n: int) -> str:
    s = rf"regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce(nullif(CASE WHEN len({s}) > {n} THEN regexp_replace(left({s}, {n}), '_+$', '') ELSE {s} END, ''), 'untitled')"


def heading(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({sq(x)}, '^:+|:+$', '', 'g'), '^[0-9]+(?:\.[0-9]+)*[.)]?\s*', ''))"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({norm(x)}, '[\p{{L}}\p{{M}}\p{{N}}_%.,/-]+')"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def first_distinct(x: str) -> str:
    """Distinct elements of a list in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def full_lines(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\r\n|\r|\n'), lambda l: trim(l)), lambda l: l <> '')"


def line_ratio(x: str, pattern: str) -> str:
    p = "(?i)" + pattern.replace("'", "''")
    return f"CASE WHEN len({full_lines(x)}) = 0 THEN 0.0 ELSE round(len(list_filter({full_lines(x)}, lambda l: regexp_matches(l, '{p}'))) / len({full_lines(x)}), 3) END"


def terms(x: str) -> str:
    w = words(fold(x))
    return f"list_filter({first_distinct(w)}, lambda v: len(v) >= 4 AND NOT list_contains({quoted(T.RETRIEVAL_STOPWORDS)}, v))"


def lexical_ordered(x: str) -> str:
    return f"list_filter({words(fold_d(x))}, lambda v: (len(v) >= 3 OR list_contains({quoted(T.LEXICAL_KEEP)}, v)) AND NOT list_contains({quoted(T.LEXICAL_STOPWORDS)}, v))"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string(({x})[i:i + {n - 1}], ' '))"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def section_type(h: str) -> str:
    return f"""CASE WHEN {h} IN ('tài liệu tham khảo', 'references') THEN 'references' WHEN {h} IN ('tóm tắt', 'abstract', 'summary') THEN 'abstract'
    WHEN {h} IN ('đặt vấn đề', 'giới thiệu', 'mở đầu', 'đại cương') THEN 'introduction'
    WHEN starts_with({h}, 'đối tượng và phương pháp') OR starts_with({h}, 'vật liệu và phương pháp') THEN 'methods' WHEN starts_with({h}, 'kết quả') THEN 'results'
    WHEN {h} = 'bàn luận' THEN 'discussion' WHEN {h} IN ('kết luận', 'kiến nghị') THEN 'conclusion' WHEN {h} IN ('phụ lục', 'appendix') THEN 'appendix'
    WHEN {h} IN ('chỉ định', 'chống chỉ định', 'chuẩn bị', 'theo dõi', 'theo dõi và xử trí tai biến', 'các bước tiến hành', 'tiến hành qtkt') THEN 'procedure' ELSE 'body' END"""


#: Titles as headings: every third record gets a known one, so that each branch is met.
_HEADS = ["TÓM TẮT", "2. Kết quả nghiên cứu:", "References", "Bàn luận", "1.1 Đặt vấn đề", "KẾT LUẬN", "Phụ lục", "chỉ định", "Đối tượng và phương pháp"]
_HEAD = lambda: F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))).otherwise(_T())
_HEAD_SQL = f"(CASE WHEN doc_id % 3 = 0 THEN {quoted(_HEADS)}[(doc_id % {len(_HEADS)} + 1)::INT] ELSE title END)"
_ROLES = {"abstract": "high_signal", "conclusion": "high_signal", "results": "evidence", "discussion": "evidence", "methods": "methods",
          "introduction": "context", "references": "noise", "appendix": "appendix", "procedure": "instruction"}
_CITE = lambda: F.concat(_B(), F.when(F.col("doc_id") % 4 == 0, F.concat_ws("\n", F.lit(""), F.lit("[1] Smith J et al. (2020)"), F.lit("2. Lancet doi: 10.1/x"), F.lit("| a | b |"), F.lit("x  y  z  w"))).otherwise(""))
_CITE_SQL = "(body || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '[1] Smith J et al. (2020)' || chr(10) || '2. Lancet doi: 10.1/x' || chr(10) || '| a | b |' || chr(10) || 'x  y  z  w' ELSE '' END)"

scalar("t01_normalize_whitespace", {"value": (lambda: T.normalize_whitespace(_B()), strip(r"regexp_replace(regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"))})
scalar("t02_slug", {"value": (lambda: T.slug(_T()), slug("title", 60)), "short": (lambda: T.slug(_T(), 20), slug("title", 20))})
scalar("t03_fold", {"value": (lambda: T.fold(_T()), fold("title"))})
scalar("t04_fold_d", {"value": (lambda: T.fold_d(_T()), fold_d("title"))})
scalar("t05_strip_diacritics", {"value": (lambda: T.strip_diacritics(_T()), "translate(strip_accents(title), 'đĐ', 'dD')")})
scalar("t06_title_norm", {"value": (lambda: T.title_norm(_T()), title_norm("title"))})
scalar("t07_title_key", {"value": (lambda: T.title_key(_T()), title_key("title"))})
scalar("t08_normalize_eval", {"value": (lambda: F.md5(T.normalize_eval(_B())), f"md5({norm('body')})")})
scalar("t09_normalize_heading", {"value": (lambda: T.normalize_heading(_HEAD()), heading(_HEAD_SQL))})
scalar("t10_plain_heading", {"value": (lambda: T.plain_heading(_HEAD()), f"""CASE WHEN list_contains({quoted([h.lower() for h in T.MAJOR_HEADINGS])}, lower(trim(regexp_replace({heading(_HEAD_SQL)}, '\\s*:$', '')))) THEN upper(trim(regexp_replace({heading(_HEAD_SQL)}, '\\s*:$', ''))) ELSE '' END""")})
scalar("t12_section_type", {"value": (lambda: T.section_type(_HEAD()), section_type(f"lower({heading(_HEAD_SQL)})"))})
scalar("t13_chunk_role", {"value": (lambda: T.chunk_role(T.section_type(_HEAD())), "CASE " + " ".join(f"WHEN ({section_type(f'lower({heading(_HEAD_SQL)})')}) = '{k}' THEN '{v}'" for k, v in _ROLES.items()) + " ELSE 'body' END")})
scalar("t14_reference_line_ratio", {"value": (lambda: T.reference_line_ratio(_CITE()), line_ratio(_CITE_SQL, T.REFERENCE_LINE))})
scalar("t15_table_line_ratio", {"value": (lambda: T.table_line_ratio(_CITE()), line_ratio(_CITE_SQL, T.TABLE_LINE))})
scalar("t16_context_header", {"value": (lambda: T.context_header(_T(), F.lit(""), F.col("source_name"), F.lit(None).cast("string"), F.col("language")), "CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) ELSE '' END || 'Source: ' || source_name || chr(10) || 'Audience: ' || language || chr(10) || 'Body:' || chr(10)")})
_HEADED = lambda: F.when(F.col("doc_id") % 2 == 0, F.concat(T.context_header(_T(), F.lit(""), F.col("source_name"), F.lit(""), F.lit("")), _B())).otherwise(_B())
scalar("t17_strip_context_header", {"value": (lambda: F.md5(T.strip_context_header(_HEADED())), "md5(body)")})
scalar("t18_stable_id", {"value": (lambda: T.stable_id(F.col("source_name"), F.col("doc_id").cast("string"), _T(), (F.col("doc_id") % 150).cast("int")),
    f"{slug('source_name', 20)} || '_' || {slug('doc_id::VARCHAR', 40)} || '_' || CASE WHEN title = '' THEN 'main' ELSE {slug('title', 30)} END || '_chunk' || CASE WHEN doc_id % 150 < 100 THEN lpad((doc_id % 150)::VARCHAR, 2, '0') ELSE (doc_id % 150)::VARCHAR END")})
scalar("t19_estimate_tokens", {"value": (lambda: T.estimate_tokens(_B()), "CASE WHEN body = '' THEN 0 ELSE greatest(1, len(body) // 4) END")})
scalar("t20_stable_text_hash", {"value": (lambda: T.stable_text_hash(_B()), f"sha256(lower({sq('body')}))")})
scalar("t21_body_hash", {"value": (lambda: T.body_hash(_B()), f"md5(left({sq('lower(body)')}, 500))")})
scalar("t22_body_sha", {"value": (lambda: T.body_sha(_B()), "sha256(body)")})
_PRE = r"regexp_replace(lower(left(body, 500)), '[ \n]', '', 'g')"
scalar("t23_fingerprint", {"value": (lambda: T.fingerprint(_B()), f"CASE WHEN len({_PRE}) < 3 THEN sha256(body) ELSE md5(array_to_string(list_sort(list_distinct(list_transform(range(1, len({_PRE}) - 1), lambda i: substring({_PRE}, i, 3)))), '')) END")})
scalar("t26_tokenize", {"value": (lambda: F.size(T.tokenize(_B())), f"len({tokens('body')})"), "digest": (lambda: F.md5(F.array_join(T.tokenize(_B()), "|")), f"md5({joined(tokens('body'))})")})
_STOPS = quoted([*T.VI_STOPWORDS, *T.EN_STOPWORDS])
scalar("t27_content_tokens", {"value": (lambda: F.size(T.content_tokens(_B())), f"len(list_filter(list_distinct({tokens('body')}), lambda v: len(v) > 1 AND NOT list_contains({_STOPS}, v)))")})
scalar("t28_query_keywords", {"value": (lambda: F.array_join(F.sort_array(T.query_terms(_T())), "|"), joined(f"list_sort({terms('title')})"))})
scalar("t29_query_terms", {"value": (lambda: F.array_join(T.query_terms(_T()), "|"), joined(terms("title")))})
scalar("t30_acronyms", {"value": (lambda: F.array_join(T.acronyms(F.concat(_T(), F.lit(" MRI x HER2 CT"))), "|"), joined(r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title || ' MRI x HER2 CT', '[\p{L}\p{M}\p{N}_]+'), lambda v: regexp_full_match(v, '[A-Z][A-Z0-9]{1,6}')), lambda v: lower(v))))"))})
scalar("t31_title_keywords", {"value": (lambda: F.array_join(F.sort_array(F.filter(F.array_distinct(F.split(T.title_norm(_T()), " ")), lambda x: F.char_length(x) > 1)), "|"), joined(f"list_sort(list_filter(list_distinct(string_split({title_norm('title')}, ' ')), lambda v: len(v) > 1))"))})
scalar("t32_lexical_tokens", {"value": (lambda: F.array_join(F.sort_array(T.lexical_tokens(_T())), "|"), joined(f"list_sort(list_distinct({lexical_ordered('title')}))"))})
scalar("t35_numbers", {"value": (lambda: F.array_join(T.numbers(_B()), "|"), joined(rf"regexp_extract_all({norm('body')}, '[0-9]+(?:[.,][0-9]+)?%?')"))})
scalar("t38_sentence_chunks", {"value": (lambda: F.size(T.sentence_chunks(_B())), r"len(list_filter(regexp_split_to_array(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda s: trim(s) <> ''))")})
scalar("t45_noise_ratio", {"value": (lambda: T.noise_ratio(_B()), r"""CASE WHEN body = '' THEN 0.0 ELSE 1 - len(regexp_replace(body, '[^\p{L}\p{N}\s.,;:!?()\-''/"]', '', 'g')) / len(body) END""")})
_SENT = r"list_filter(list_transform(regexp_split_to_array(body, '[.!?\n]'), lambda s: lower(trim(s))), lambda s: len(s) > 20)"
scalar("t46_sentence_repetition", {"value": (lambda: T.sentence_repetition(_B()), f"CASE WHEN len({_SENT}) < 2 THEN 0.0 ELSE 1 - len(list_distinct({_SENT})) / len({_SENT}) END")})
scalar("t47_character_ratios", {
    "digit": (lambda: T.digit_ratio(_B()), r"CASE WHEN body = '' THEN 1.0 ELSE len(regexp_replace(body, '[^\p{Nd}]', '', 'g')) / len(body) END"),
    "special": (lambda: T.special_ratio(_B()), r"""CASE WHEN body = '' THEN 1.0 ELSE (len(body) - len(regexp_replace(body, '[^\p{L}\p{N}\s.,;:!?()%/\-+\[\]"''–—]', '', 'g'))) / len(body) END""")})
scalar("t48_narrative_sentences", {"value": (lambda: T.narrative_sentences(_B()), r"len(list_filter(regexp_split_to_array(body, '[.!?]'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) > 5))")})
scalar("t49_table_heavy", {"value": (lambda: T.table_heavy(_B()), " + ".join(f"(len(lower(body)) - len(replace(lower(body), '{m}', ''))) // {len(m)}" for m in ("bảng ", "biểu đồ ", "figure ", "table ", "n=", "%", "±")))})
_LET, _VI = r"len(regexp_replace(left(body, 3000), '[^\p{L}]', '', 'g'))", f"len(regexp_replace(left(body, 3000), '[^{T.VI_LETTERS}]', '', 'g'))"
_R = f"({_VI} / nullif({_LET}, 0))"
_LANG = lambda: T.detect_language(_B())
scalar("t50_detect_language", {
    "detected": (lambda: _LANG()["language"], f"CASE WHEN {_LET} = 0 OR {_R} > 0.03 THEN 'vi' WHEN {_R} > 0.005 THEN 'mixed' ELSE 'en' END"),
    "confidence": (lambda: F.round(_LANG()["confidence"], 6), f"round(CASE WHEN {_LET} = 0 THEN 0.0 WHEN {_R} > 0.03 THEN least(1.0, {_R} * 10) WHEN {_R} > 0.005 THEN {_R} * 10 ELSE 1 - {_R} * 100 END, 6)"),
    "mixed": (lambda: _LANG()["mixed"], f"coalesce({_R} > 0.005 AND {_R} < 0.03, false)")})
scalar("t65_strip_references", {"value": (lambda: F.md5(T.strip_references(F.concat(_B(), F.lit("\nREFERENCES \n1. x\nReferences\n2. y")))), "md5(body || chr(10) || 'REFERENCES ' || chr(10) || '1. x')")})
scalar("t68_phrase_present", {"value": (lambda: T.phrase_present(_T(), F.substring(_B(), 30, 400)), f"""({title_key('title')}) = '' OR contains({title_key('substring(body, 30, 400)')}, {title_key('title')})
  OR len(list_filter(string_split({title_key('title')}, ' '), lambda v: len(v) > 1)) = 0
  OR len(list_filter(list_filter(string_split({title_key('title')}, ' '), lambda v: len(v) > 1), lambda v: list_contains(string_split({title_key('substring(body, 30, 400)')}, ' '), v))) / len(list_filter(string_split({title_key('title')}, ' '), lambda v: len(v) > 1)) >= 0.8""")})
scalar("t70_lexical_coverage", {"value": (lambda: T.lexical_coverage(_T(), F.substring(_B(), 40, 2000)), f"CASE WHEN len({tokens('title')}) = 0 THEN 1.0 ELSE len(list_filter({tokens('title')}, lambda v: list_contains({tokens('substring(body, 40, 2000)')}, v))) / len({tokens('title')}) END")})
scalar("t76_item_id", {"value": (lambda: T.item_id(F.col("source_name"), F.col("doc_id").cast("string"), F.lit("")), "left(sha1(source_name || '::' || doc_id || '::'), 20)")})
scalar("t77_doc_id", {"value": (lambda: T.doc_id(F.col("source_name"), F.concat(F.lit("a/b/f"), F.col("doc_id"), F.lit(".v1.txt")), F.lit(3)), "left(md5(source_name || ':' || 'f' || doc_id || '.v1' || ':3'), 16)")})
scalar("t88_negated", {"value": (lambda: T.negated(F.concat(_B(), F.when(F.col("doc_id") % 5 == 0, " Chưa có").otherwise(""))), "list_bool_or(list_transform(" + quoted(T.NEGATION_MARKERS) + f", lambda m: contains({norm('body')} || CASE WHEN doc_id % 5 = 0 THEN ' chưa có' ELSE '' END, m)))")})
scalar("h41_negative_cue", {"value": (lambda: T.negative_cue(F.concat(_B(), F.when(F.col("doc_id") % 5 == 0, " Chưa thể").otherwise(""))), "doc_id % 5 = 0")})
_TERMS = terms("title")
scalar("w08_term_phrases", {"value": (lambda: F.array_join(T.phrases(T.query_terms(_T()), (3, 2), 12), "|"), joined(f"({first_distinct(f'list_concat({grams(_TERMS, 3)}, {grams(_TERMS, 2)})')})[:12]"))})
_LEX = lexical_ordered("title")
scalar("w09_lexical_phrases", {"value": (lambda: F.array_join(T.phrases(T.lexical_ordered(_T()), (5, 4, 3, 2), 24), "|"), joined(f"({first_distinct('list_concat(' + ', '.join(grams(_LEX, n) for n in (5, 4, 3, 2)) + ')')})[:24]"))})
scalar("v05_point_id", {"value": (lambda: T.uuid5_url(F.concat(F.lit("chunk"), F.col("doc_id"))), """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32]
  FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk' || doc_id)) AS h))""")})
