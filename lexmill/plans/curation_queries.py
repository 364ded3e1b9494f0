"""Curation of titles, addresses and texts, the gold set and releases, over the records; the SQL holds its own lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curation as C
from ..functions.text import title_key as key_of_title
from ..operators import goldset as G
from .registry import REC, records, register, scalar
from .text_queries import first_distinct, joined, norm, quoted, sq, strip, title_key

TITLES = [
    "untitled", "2019;156(7):1951-1968", "2021. 5(3) and more", "10.1000/xyz of the paper", "và một phần", "TT Tên hoạt chất thuốc", "1. Smith et al (2020) title of it", "tên bài viết", "12345 678", "....", "MỤC LỤC", "mục lục",
    "SỔ TAY DINH DƯỠNG LÂM SÀNG 2020", "III Chapter on food 12", "Contents ........ 12", "PGS. TS. Nguyễn, viện dinh dưỡng", "Số 12 năm 2020", "12. ab cd.", "Mayo Clin Proc 2001", "a good plain title of a study", "",
]
URLS = ["https://www.who.int/health-topics/flu", "https://www.who.int/news/item.pdf", "http://who.int/mega-menu/publications/x", "https://apps.who.int/vietnam/a", "https://www.who.int/vietnam/news/x", "https://cdn.who.int/media/docs/westernpacific/a.docx",
        "https://www.who.int/fact-sheets/detail/x", "https://example.org/publications/x", "not a url", "https://www.who.int/about"]
PATHS = ["a/b/file.html", "x.tar.gz", "dir/noext", "processed/colorectal-cancer.txt", ".hidden", "a b?c/très long nom de fichier " + "x" * 150 + ".pdf"]
HEADS = ["Tạp chí Y học Việt Nam tập 500", "VIETNAM MEDICAL JOURNAL N2", "TÓM TẮT mục tiêu của bài", "nothing to see", "kết quả so sánh tỷ lệ HR", "Tài liệu tham khảo"]


def _at(values: list[str], n: int = 1):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))


def _sql(values: list[str], n: int = 1) -> str:
    return f"{quoted(values)}[(doc_id // {n} % {len(values)} + 1)::INT]"


def _or(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(x, p.replace("'", "''")) for p in patterns) + ")"


def _has(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


_T = lambda: F.when(F.col("doc_id") % 2 == 0, _at(TITLES, 2)).otherwise(F.col("title"))
_TS = f"(CASE WHEN doc_id % 2 = 0 THEN {_sql(TITLES, 2)} ELSE title END)"
_S = strip(_TS)
_CIT = r"[0-9]{4}\s*;\s*[0-9]+\s*(?:\([0-9]+\))?\s*:\s*(?:e?[0-9]+|[A-Z][0-9]+)"
_LOW = r"^[a-zà-ỹ][^\n]{0,80}$"
_NWORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_NDIG = r"len(regexp_replace({}, '[^\p{{Nd}}]', '', 'g'))"
scalar("f11_f12_titles", {
    "junk": (lambda: C.junk_title(_T()), f"""({_S} <> '' AND ({_or(_S, ['(?i)^(?:tên bài viết|untitled|no title|[.]+)$', r'^[0-9]{4}[\s.;]+[0-9]+\s*\([0-9]+\)', r'^[0-9]{4}\.\s*[0-9]+\([0-9]+\)', r'^[0-9]{4}[\s.;:]+[0-9]+(?:\([0-9]+\))?[:;]\s*[A-Za-z]?[0-9]+'])}
      OR (len({_S}) < 10 AND regexp_matches({_S}, '{_CIT}')) OR ({_NDIG.format(_S)} > 0.25 * len({_S}) AND NOT regexp_matches({_S}, '[A-Za-zÀ-ỹ]{{5,}}')) OR (regexp_matches({_S}, '{_LOW}') AND {_NWORDS.format(_S)} <= 4)))"""),
    "weak": (lambda: C.weak_chunk_title(_T()), f"(len({_S}) < 15 OR {_or(_S, [_LOW, _CIT, r'10[.][0-9]{4,}/'])})")})
_REFS = [r"^[0-9]+\.\s+[A-ZÀ-Ỹa-zà-ỹ].*(?:et al|pp?\.\s*[0-9]|\([0-9]{4}\))", "Pan Afr Med J", r"doi:\s*10\.", r"PMID:\s*[0-9]+", "Lancet|NEJM|BMJ|PLoS", r"J\s+[A-Z][a-z]+\s+[A-Z][a-z]+", r"Am\s+J\s+[A-Z]", r"Int\s+J\s+[A-Z]", r"World\s+J\s+[A-Z]",
         r"Prev\s+Chronic\s+Dis", r"N\s+Engl\s+J\s+Med", r"Cochrane\s+Database", r"ISSN\s+[0-9]", r"[A-Z][a-z]+\s+et\s+al", r"\([0-9]{4}\)\s*[.,]", "https?://", r"pp\.\s*[0-9]+-[0-9]+"]
_HEADS = [r"^TT\s", r"^STT\s", "^Tên hoạt chất", "^Tên thuốc", "^Đường dùng", "^Hàm lượng", "^Đơn vị", "^Số lượng", "^Nồng độ"]
scalar("h102_bad_title", {"value": (lambda: C.bad_title(_T()), f"(len({_S}) < 10 OR lower({_S}) IN ('pdf', '', 'document', 'untitled') OR {_or(_S, _REFS + _HEADS + [r'^,\s*$'])})")})
_SKIP = [r"(?i)^TẠP CHÍ\s*$", r"(?i)^SỐ\s+[0-9]+.*$", r"(?i)^TẠP CHÍ Y\s*.{0,60}(SỐ|TẬP).*$", "(?i)^HUE JOURNAL.*ISSN.*$", "(?i)^VIETNAM MEDICAL JOURNAL.*$", r"(?i)^BÀI NGHIÊN CỨU\s*$", r"^ISSN\s+[0-9]+.*$", "^DOI:.*$", r"(?i)^TẠP CHÍ SỐ\s+[0-9]+.*$"]
_BODY = lambda: F.concat_ws("\n", _T(), _at(HEADS, 3), F.col("body"))
_BS = f"({_TS} || chr(10) || {_sql(HEADS, 3)} || chr(10) || body)"
scalar("h103_h104_generic_title", {"value": (lambda: C.generic_title(_BODY()), f"left(coalesce(list_filter(list_transform((regexp_split_to_array({_BS}, '\\r\\n|\\r|\\n'))[:40], lambda x: {strip('x')}), lambda x: len(x) >= 20 AND NOT {_or('x', _SKIP + _REFS + _HEADS)})[1], ''), 300)")})
_TL = sq(f"lower({_TS})")
scalar("t62_title_points", {"value": (lambda: C.title_points(_T()).cast("long"), f"""(CASE WHEN {_TL} IN ('mục lục', 'contents', 'pdf', 'document', 'tải xuống', 'tai xuong', 'download') THEN -100 WHEN {_or(_TS, [r'[.]{6,}\s*[0-9]+\s*$', r'(?i)^\s*([0-9]+|[IVXLC]+)\s+.+\s+[0-9]+\s*$'])} THEN -80
  WHEN regexp_matches({_TS}, '^[0-9.\\-_/ ]+$') THEN -90 ELSE least({_NWORDS.format(_TS)}, 8) * 5 + CASE WHEN len({_TS}) >= 16 THEN 6 ELSE 0 END + CASE WHEN {_TS} = upper({_TS}) THEN 10 ELSE 0 END - CASE WHEN regexp_matches({_TS}, '\\b[0-9]+\\s*[~\\-]\\s*[0-9]+\\b') THEN 12 ELSE 0 END
  - CASE WHEN regexp_matches({_TL}, '^(số |so |issue |vol )') THEN 16 ELSE 0 END - CASE WHEN {_has(_TL, ['hội đồng biên tập', 'chịu trách nhiệm', 'thư ký', 'ban biên tập'])} THEN 16 ELSE 0 END
  - CASE WHEN {_has(_TL, ['pgs', 'gs', 'ts.', 'bs.', 'ths.'])} THEN 8 ELSE 0 END - CASE WHEN {_has(_TL, ['viện dinh dưỡng', 'bộ y tế', 'trung tâm kiểm soát bệnh tật'])} THEN 6 ELSE 0 END END)::BIGINT""")})
_Q = sq(_TS)
scalar("h46_repaired_title", {"value": (lambda: C.repaired_title(_T()), f"CASE WHEN regexp_matches(lower({_Q}), '^(và |trong |của |với |tại )') THEN 'REJECT_TRUNCATED' WHEN " + _or(f"lower({_Q})", [
    r"^[0-9]+\.\s*$", r"^[0-9]+\.\s*[a-z]*$", r"\bdoi\b", r"[0-9]+\([0-9]+\)\s*:\s*[0-9]+", r"[0-9]{4};\s*[0-9]+\s*:\s*[0-9]+", "mayo clin proc", r"[a-z0-9]+\.[0-9]{4}\.[0-9]+", r"^[0-9]+\.\s+[a-z]{1,4}\s+[a-z]{1,2}[.]*"]) + f" THEN 'REJECT_REFERENCE_TITLE' ELSE {_Q} END")})
_U = lambda: _at(URLS)
_US = f"lower({_sql(URLS)})"
_HOST, _PATH = f"regexp_extract({_US}, '^[a-z]+://([^/?#]*)', 1)", f"regexp_extract({_US}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_FILE = rf"regexp_matches({_PATH}, '[.](pdf|doc|docx|xls|xlsx|ppt|pptx|zip)$')"
scalar("h77_h79_urls", {
    "who": (lambda: C.who_url(_U()), f"({_HOST} IN ('www.who.int', 'who.int', 'cdn.who.int') AND NOT contains({_PATH}, 'mega-menu') AND ({_FILE} OR {_has(_PATH, ['/fact-sheets/detail/', '/health-topics/', '/publications/', '/news-room/'])}))"),
    "vietnam": (lambda: C.who_vietnam_url(_U()), f"({_HOST} IN ('www.who.int', 'who.int', 'cdn.who.int', 'apps.who.int') AND NOT contains({_PATH}, 'mega-menu') AND {_has(_US, ['viet-nam', 'vietnam', 'westernpacific'])} AND ({_FILE} OR {_has(_PATH, ['/vietnam', '/viet-nam', '/westernpacific/', '/publications/', '/news-room/', '/news/'])}))"),
    "kind": (lambda: C.who_item_type(_U()), f"CASE WHEN {_FILE} THEN 'document_asset' WHEN contains({_US}, '/fact-sheets/detail/') THEN 'fact_sheet' WHEN contains({_US}, '/health-topics/') THEN 'health_topic' WHEN contains({_US}, '/publications/') THEN 'publication_page' WHEN {_has(_US, ['/news-room/', '/news/'])} THEN 'news_page' ELSE 'html_page' END")})
_P = lambda: F.concat(_at(PATHS), F.when(F.col("doc_id") % 4 == 0, F.substring("body", 1, 200)).otherwise(""))
_PS = f"({_sql(PATHS)} || CASE WHEN doc_id % 4 = 0 THEN left(body, 200) ELSE '' END)"
_SAFE = f"regexp_replace(regexp_replace({_PS}, '[^A-Za-z0-9._\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"
scalar("h80_bounded_filename", {"value": (lambda: C.bounded_filename(_P(), "pdf"), f"""list_transform([regexp_replace(CASE WHEN {_SAFE} = '' THEN 'asset' ELSE {_SAFE} END, '[.]pdf$', '')], lambda s: CASE WHEN len(s) + 4 <= 140 THEN s || '.pdf'
  ELSE CASE WHEN regexp_replace(left(s, 122), '[._\\-]+$', '') = '' THEN 'asset' ELSE regexp_replace(left(s, 122), '[._\\-]+$', '') END || '__' || left(sha1(s), 12) || '.pdf' END)[1]""")})
SUFFIXES = [".html", ".htm", ".xml", ".pdf", ".txt", ".md"]
scalar("t78_processed_stem", {"value": (lambda: C.processed_stem(_at(PATHS), F.when(F.col("doc_id") % 2 == 0, "html").otherwise(""), SUFFIXES),
                                        f"CASE doc_id % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'x.tar.gz' WHEN 2 THEN 'noext' WHEN 3 THEN 'colorectal-cancer' WHEN 4 THEN '.hidden' ELSE 'très long nom de fichier {'x' * 150}' END")})
scalar("h114_derived_url", {"value": (lambda: C.derived_url(F.when(F.col("doc_id") % 5 == 0, " http://own ").otherwise(""), F.when(F.col("doc_id") % 3 > 0, "uspstf_recommendations").otherwise("x"), _at(PATHS[:4])),
                                      "CASE WHEN doc_id % 5 = 0 THEN 'http://own' WHEN doc_id % 3 > 0 THEN 'https://www.uspreventiveservicestaskforce.org/uspstf/recommendation/' || ['file', 'x.tar', 'noext', 'colorectal-cancer'][(doc_id % 4 + 1)::INT] ELSE '' END")})
_RES = strip("regexp_replace(body || chr(13) || 'Â®', '\\r\\n?', chr(10), 'g')")
scalar("t43_clean_scalar", {"value": (lambda: C.clean_scalar(F.concat(F.regexp_replace("body", "[^\x00-\x7f]", ""), F.lit("\rđ Â® â€“ Â°"))), strip("regexp_replace(body, '[^\\x00-\\x7F]', '', 'g') || chr(10) || 'đ ® – °'").replace("body,", "regexp_replace(body, '\\r\\n?', chr(10), 'g'),"))})
scalar("t64_journal_lines", {"value": (lambda: C.drop_journal_lines(_BODY()), f"array_to_string(list_filter(string_split({_BS}, chr(10)), lambda x: NOT regexp_matches(x, '(?i)(TẠP CHÍ Y|vietnam medical journal)')), chr(10))")})
_TAIL = lambda: F.concat_ws("\n", "body", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Tài liệu tham khảo\n"), F.substring("body", 1, 100))).when(F.col("doc_id") % 3 == 1, "References\n1. x").otherwise(""))
_TAILS = "(body || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Tài liệu tham khảo' || chr(10) || left(body, 100) WHEN 1 THEN 'References' || chr(10) || '1. x' ELSE '' END)"


def _last(m: str) -> str:
    return f"(len(b) - strpos(reverse(lower(b)), reverse('{m}')) - {len(m)} + 1)"


_MARKS = ["tài liệu tham khảo", "references\n", "bibliography\n"]
register("t66_reference_tail", f"WITH {REC}, t AS (SELECT doc_id, {_TAILS} AS b FROM rec) SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(b), '{m}') AND {_last(m)} > len(b) / 2 THEN {strip(f'left(b, {_last(m)})')}" for m in _MARKS) + " ELSE b END AS value, "
         + " OR ".join(f"(contains(lower(b), '{m}') AND {_last(m)} > len(b) / 2)" for m in _MARKS) + " AS cut FROM t")(
    lambda spark, sf_dir: records(spark, sf_dir).select("doc_id", C.reference_tail(_TAIL()).alias("x")).select("doc_id", F.col("x.body").alias("value"), (F.size("x.flags") > 0).alias("cut")))
_N = strip("regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
scalar("h89_body_without_title", {"value": (lambda: C.body_without_title(F.concat(F.lit(" "), "title", F.lit(" \r\n\n\n"), "body"), F.col("title")),
    f"CASE WHEN title = '' OR {_N.format("(' ' || title || ' ' || chr(13) || chr(10) || chr(10) || chr(10) || body)")} = '' THEN {_N.format("(' ' || title || ' ' || chr(13) || chr(10) || chr(10) || chr(10) || body)")} ELSE " + strip(f"""array_to_string(list_filter(list_transform(string_split({_N.format("(' ' || title || ' ' || chr(13) || chr(10) || chr(10) || chr(10) || body)")}, chr(10)), lambda x: {strip('x')}),
      lambda x, i: i > 1 OR lower(x) <> lower({strip('title')})), chr(10))""") + " END")})
_PDF = lambda x: strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '(?m)^\s*[0-9]{{1,3}}\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@register("t85_h113_pdf_text")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T85 and H113 over whole bodies; a look-behind and a pattern per row have no SQL in the oracle, so tests hold them against brute force."""
    title = F.array_join(F.slice(F.split(F.substring("body", 301, 60), r"\s+"), 2, 4), " ")
    return records(spark, sf_dir).select("doc_id", C.rotate_to_title(F.col("body"), title).alias("rotated"), C.clean_journal_pdf(_BODY()).alias("cleaned"))


_CTX = f"lower({_BS})"
scalar("c29_seed_queries", {"value": (lambda: C.seed_queries(_T(), _BODY(), F.when(F.col("doc_id") % 9 == 0, "borderline").otherwise("high")),
    f"CASE WHEN doc_id % 9 = 0 OR {' OR '.join(f'contains(lower({_TS}), {m!r}) OR contains(left({_CTX}, 200), {m!r})' for m in ['ca lâm sàng', 'case report', 'trường hợp', 'báo cáo ca', 'nhân một trường hợp'])} OR "
    + " + ".join(f"contains({_CTX}, '{m}')::INT" for m in ["mục tiêu", "objective", "đối tượng và phương pháp", "kết quả", "results", "kết luận", "conclusion", "yếu tố nguy cơ", "yếu tố liên quan", "so sánh", "OR", "HR", "p<", "p =", "KTC", "CI", "tỷ lệ", "trung bình", "ngưỡng"]) + " < 3 THEN 1 ELSE 2 END")})
_FLAGS = lambda n: F.filter(F.split(F.lower(F.substring("body", 1, n)), " "), lambda x: F.char_length(x) < 6)
_FS = lambda n: f"list_filter(string_split(lower(left(body, {n})), ' '), lambda x: len(x) < 6)"
scalar("u06_merge_flags", {"value": (lambda: F.array_join(C.merge_flags(_FLAGS(40), _FLAGS(200)), "|"), joined(f"list_concat({_FS(40)}, list_filter({first_distinct(_FS(200))}, lambda x: x <> '' AND NOT list_contains({_FS(40)}, x)))"))})

# ------------------------------------------------------------------ hits
GOLD = ["Der Bericht", "  the REPORT  of", "", "le", "study of eyes"]
_GT, _GS = (lambda: F.when(F.col("doc_id") % 3 == 0, F.substring("title", 3, 20)).otherwise(_at(GOLD))), f"(CASE WHEN doc_id % 3 = 0 THEN substring(title, 3, 20) ELSE {_sql(GOLD)} END)"
_WANT, _WS = (lambda: F.when(F.col("doc_id") % 2 == 0, F.substring("source_name", 1, 3)).otherwise("web")), "(CASE WHEN doc_id % 2 = 0 THEN left(source_name, 3) ELSE 'web' END)"
_SH = f"contains(lower(coalesce(source_name, '')), lower(coalesce({_WS}, '')))"
scalar("j20_j22_hits", {
    "title": (lambda: C.title_hit(_GT(), F.col("title")), f"({norm(_GS)} <> '' AND {norm('title')} <> '' AND (contains({norm(_GS)}, {norm('title')}) OR contains({norm('title')}, {norm(_GS)})))"),
    "source": (lambda: C.source_hit(F.col("source_name"), _WANT()), _SH),
    "both": (lambda: C.title_source_hit(F.col("source_name"), F.col("title"), F.col("language"), _WANT(), _GT()), f"({_SH} AND (lower({_GS}) = '' OR contains(lower(title), lower({_GS})) OR contains(lower(coalesce(language, '')), lower({_GS}))))")})
_KEYS = ["the", "der", "DIE  ", "", "zzz", "que"]
scalar("j23_h42_concepts", {
    "rate": (lambda: C.concept_hit_rate(F.col("body"), F.array(*[F.lit(k) for k in _KEYS])), f"CASE WHEN {norm('body')} = '' THEN 0.0 ELSE (contains({norm('body')}, 'the')::INT + contains({norm('body')}, 'der')::INT + contains({norm('body')}, 'die')::INT + contains({norm('body')}, 'zzz')::INT + contains({norm('body')}, 'que')::INT) / 6 END::DOUBLE"),
    "hits": (lambda: F.array_join(C.phrase_hits(F.col("body"), F.array(*[F.lit(k) for k in _KEYS])), "|"), joined(f"list_filter({quoted(['the', 'der', 'DIE  ', 'zzz', 'que'])}, lambda k: contains({norm('body')}, {norm('k')}))"))})


@register("l15_h45_retrieved", f"""WITH {REC}, g AS (SELECT source_name AS s, doc_id // 40 AS b, list(trim(title) ORDER BY doc_id) AS ts, list(title || '|' || left(body, 800) ORDER BY doc_id) AS hs, list(struct_pack(t := title, n := source_name, x := left(body, 800)) ORDER BY doc_id) AS cs FROM rec GROUP BY ALL)
SELECT coalesce(s, '') AS source, b AS block, array_to_string(({first_distinct("list_filter(ts, lambda t: t <> '')")})[:8], '|') AS titles,
  sha256(array_to_string(list_filter(flatten(list_transform(cs, lambda c: [c.t, coalesce(c.n, ''), c.x])), lambda v: v <> ''), ' ')) AS haystack FROM g""")
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.lit("")
    one = F.struct("doc_id", "title", e.alias("canonical_title"), e.alias("section_title"), "source_name", e.alias("doc_type"), e.alias("specialty"), F.col("body").alias("text"))
    at = records(spark, sf_dir).groupBy("source_name", F.floor(F.col("doc_id") / 40).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    return at.select(F.coalesce("source_name", e).alias("source"), "block", F.array_join(C.top_titles(F.transform("c", lambda x: x["title"])), "|").alias("titles"), F.sha2(C.haystack(F.col("c")), 256).alias("haystack"))


# ------------------------------------------------------------------ gold set
def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pick = lambda values, n: _at(values, n)
    return records(spark, sf_dir).select(c("doc_id").alias("query_id"), pick(["fact", "compare", "summary", "explain"], 1).alias("query_type"), pick(["full", "partial"], 3).alias("answerability"), pick(["easy", "medium", "hard"], 2).alias("difficulty"),
                                         F.coalesce("source_name", F.lit("")).alias("topic"), pick(["dev", "dev", "test", "holdout"], 5).alias("split"))


_GOLD = f"""{REC}, gold AS (SELECT doc_id AS query_id, {_sql(['fact', 'compare', 'summary', 'explain'], 1)} AS query_type, {_sql(['full', 'partial'], 3)} AS answerability, {_sql(['easy', 'medium', 'hard'], 2)} AS difficulty, coalesce(source_name, '') AS topic,
  {_sql(['dev', 'dev', 'test', 'holdout'], 5)} AS split FROM rec), cat AS (SELECT query_id, split, unnest([struct_pack(category := 'query_type', value := query_type, w := 1.2), struct_pack(category := 'answerability', value := answerability, w := 1.3),
  struct_pack(category := 'difficulty', value := difficulty, w := 1.1), struct_pack(category := 'topic', value := topic, w := 1.0), struct_pack(category := 'hard_bucket', value := CASE WHEN difficulty = 'hard' THEN 'hard' ELSE 'non_hard' END, w := 2.2)], recursive := true) FROM gold),
sp AS (SELECT unnest(['dev', 'test', 'holdout']) AS split, unnest([64, 20, 18]) AS size), ex AS (SELECT sp.split, category, value, any_value(w) AS w, count(*) * (size::DOUBLE / (SELECT count(*) FROM gold)) AS expected FROM cat, sp GROUP BY sp.split, size, category, value)"""


@register("h56_expected_counts", f"WITH {_GOLD} SELECT split, category, value, round(expected, 6) AS expected FROM ex")
def h56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expected_counts(_gold(spark, sf_dir)).select("split", "category", "value", F.round("expected", 6).alias("expected"))


@register("h57_total_penalty", f"""WITH {_GOLD}, seen AS (SELECT split, category, value, any_value(w) AS w, count(*) AS n FROM cat GROUP BY split, category, value)
SELECT round(sum(coalesce(ex.w, seen.w)::DOUBLE * (coalesce(n, 0) - coalesce(expected, 0)) * (coalesce(n, 0) - coalesce(expected, 0))), 3) AS penalty FROM ex FULL JOIN seen USING (split, category, value)""")
def h57(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold(spark, sf_dir)
    return G.total_penalty(rows, G.expected_counts(rows)).select(F.round("penalty", 3).alias("penalty"))


@register("l10_split_costs", f"""WITH {_GOLD}, done AS (SELECT * FROM gold WHERE query_id % 20 = 0), seen AS (SELECT split, category, value, count(*) AS n FROM cat WHERE query_id % 20 = 0 GROUP BY ALL), held AS (SELECT split, count(*) AS held FROM done GROUP BY split)
SELECT c.query_id, sp.split, CASE WHEN coalesce(any_value(held), 0) >= any_value(size) THEN -1.0 ELSE round(coalesce(any_value(held), 0) / any_value(size) * 0.15 + sum(c.w::DOUBLE * ((coalesce(n, 0) + 1 - coalesce(expected, 0)) * (coalesce(n, 0) + 1 - coalesce(expected, 0)) - (coalesce(n, 0) - coalesce(expected, 0)) * (coalesce(n, 0) - coalesce(expected, 0)))), 3) END::DOUBLE AS cost
FROM cat c CROSS JOIN sp LEFT JOIN ex ON ex.split = sp.split AND ex.category = c.category AND ex.value = c.value LEFT JOIN seen ON seen.split = sp.split AND seen.category = c.category AND seen.value = c.value LEFT JOIN held ON held.split = sp.split GROUP BY c.query_id, sp.split""")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold(spark, sf_dir)
    cost = G.split_costs(rows.drop("split"), rows.where("query_id % 20 = 0"), G.expected_counts(rows))
    return cost.select("query_id", "split", F.when(F.col("cost") == float("inf"), -1.0).otherwise(F.round("cost", 3)).alias("cost"))


@register("l11_rarity", f"""WITH {_GOLD} SELECT query_id, count(*) OVER (PARTITION BY query_type, answerability, difficulty, topic) AS combo_n, count(*) OVER (PARTITION BY topic) AS topic_n, count(*) OVER (PARTITION BY difficulty) AS difficulty_n,
  count(*) OVER (PARTITION BY answerability) AS answerability_n, count(*) OVER (PARTITION BY difficulty = 'hard') AS hard_n FROM gold""")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rarity(_gold(spark, sf_dir))


_LINE = lambda: F.when(F.col("doc_id") % 10 == 3, F.lit("{broken")).when(F.col("doc_id") % 10 == 4, F.lit(" ")).otherwise(F.to_json(F.struct(F.floor(F.col("doc_id") / 2).cast("string").alias("doc_id"), "title", F.when(F.col("doc_id") % 3 == 0, "x").alias("extra"))))


@register("a36_summarize_lines", f"""WITH {REC}, l AS (SELECT doc_id % 10 AS k, doc_id // 2 AS d FROM rec WHERE doc_id % 10 <> 4), i AS (SELECT d, count(*) AS n FROM l WHERE k <> 3 GROUP BY d)
SELECT (SELECT count(*) FROM l) AS record_count, (SELECT count(*) FROM l WHERE k = 3) AS invalid_json_lines, count(*) AS doc_id_count, sum(n - 1)::BIGINT AS duplicate_doc_ids FROM i""")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summarize_lines(records(spark, sf_dir).select(_LINE().alias("value")))


@register("a34_key_signatures", f"WITH {REC} SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc_id,extra,title' ELSE 'doc_id,title' END AS keys, count(*) AS n FROM rec WHERE doc_id % 10 NOT IN (3, 4) GROUP BY 1")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_signatures(records(spark, sf_dir).select(_LINE().alias("value")), "value")


RECORDS = ['{"query_id":"q1","ground_truth":"a","short_answer":"b","must_have_concepts":["x","y"],"must_not_claim":[]}', '{"query_id":1,"ground_truth":" ","must_have_concepts":"x","must_not_claim":[1,"z"]}', "[1]"]


@register("h64_h65_gold_records", f"""WITH {REC} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'missing field: short_answer|query_id must be a string|ground_truth must not be empty|must_have_concepts must be a list|must_not_claim must contain only strings' ELSE 'record is not a JSON object' END AS errors,
  CASE doc_id % 3 WHEN 0 THEN 'query_id=q1|ground_truth=a|short_answer=b|must_have_concepts[0]=x|must_have_concepts[1]=y' WHEN 1 THEN 'ground_truth= |must_not_claim[1]=z' ELSE '' END AS strings FROM rec""")
def h64(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = records(spark, sf_dir).withColumn("v", F.parse_json(_at(RECORDS)))
    return at.select("doc_id", F.array_join(C.gold_errors(F.col("v")), "|").alias("errors"), F.array_join(F.transform(C.gold_strings(F.col("v")), lambda x: F.concat_ws("=", x["field"], x["value"])), "|").alias("strings"))


# ------------------------------------------------------------------ releases
def _release(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return records(spark, sf_dir).select(c("doc_id").alias("chunk_id"), c("doc_id").alias("pos"), F.substring("title", 1, 6).alias("title"), F.floor(c("doc_id") / 4).alias("doc_id"), F.when(c("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://"), F.lower(F.substring("title", 1, 4)))).alias("source_url"),
                                         F.coalesce("source_name", F.lit("")).alias("specialty"), F.coalesce("language", F.lit("")).alias("doc_type"))


_REL = f"{REC}, rel AS (SELECT doc_id AS chunk_id, doc_id AS pos, left(title, 6) AS title, doc_id // 4 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'http://' || lower(left(title, 4)) END AS source_url, coalesce(source_name, '') AS specialty, coalesce(language, '') AS doc_type FROM rec)"


@register("j02_j03_merge", f"WITH {_REL} SELECT count(*) AS n, sum(chunk_id)::BIGINT AS ids FROM rel")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _release(spark, sf_dir)
    return G.merge_releases([at.where("pos % 2 = 0"), at.where("pos % 2 = 1")]).agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"))


@register("j04_h112_selected", f"WITH {_REL} SELECT chunk_id FROM rel WHERE (title <> '' AND title IN (SELECT title FROM rel WHERE chunk_id % 40 = 0)) OR doc_id IN (SELECT doc_id FROM rel WHERE chunk_id % 40 = 0)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _release(spark, sf_dir)
    return G.selected(at, at.where("chunk_id % 40 = 0").select("title", "doc_id")).select("chunk_id")


_TK = title_key("title")


@register("a17_title_index", f"""WITH {_REL}, k AS (SELECT *, {_TK} AS title_key FROM rel), f AS (SELECT * FROM k WHERE title_key <> ''),
u AS (SELECT title_key, source_url AS v FROM (SELECT title_key, source_url, count(*) AS n, min(pos) AS p FROM f WHERE source_url <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY n DESC, p) = 1),
s AS (SELECT title_key, specialty AS v FROM (SELECT title_key, specialty, count(*) AS n, min(pos) AS p FROM f WHERE specialty <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY n DESC, p) = 1),
d AS (SELECT title_key, doc_type AS v FROM (SELECT title_key, doc_type, count(*) AS n, min(pos) AS p FROM f WHERE doc_type <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY n DESC, p) = 1)
SELECT f.title_key, coalesce(array_to_string(list_sort(list(DISTINCT source_url) FILTER (WHERE source_url <> '')), '|'), '') AS urls, any_value(u.v) AS source_url, any_value(s.v) AS specialty, any_value(d.v) AS doc_type FROM f LEFT JOIN u USING (title_key) LEFT JOIN s USING (title_key) LEFT JOIN d USING (title_key) GROUP BY f.title_key""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.title_index(_release(spark, sf_dir), key_of_title(F.col("title"))).withColumn("urls", F.array_join("urls", "|"))


@register("j05_backfill_urls", f"""WITH {_REL}, k AS (SELECT *, {_TK} AS title_key FROM rel), one AS (SELECT title_key, min(source_url) AS u FROM k WHERE title_key <> '' AND source_url <> '' GROUP BY title_key HAVING count(DISTINCT source_url) = 1)
SELECT chunk_id, CASE WHEN source_url = '' THEN coalesce(u, '') ELSE source_url END AS source_url, source_url = '' AND u IS NOT NULL AS backfilled FROM k LEFT JOIN one USING (title_key)""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, key = _release(spark, sf_dir), key_of_title(F.col("title"))
    return G.backfill_urls(at, G.title_index(at, key), key).select("chunk_id", "source_url", "backfilled")


@register("j24_metric_differences", f"""WITH {REC}, b AS (SELECT source_name AS metric, round(avg(len(body)), 3) AS value FROM rec WHERE doc_id % 2 = 0 AND source_name IS NOT NULL GROUP BY 1), c AS (SELECT source_name AS metric, round(avg(len(body)), 3) AS value FROM rec WHERE doc_id % 2 = 1 AND source_name IS NOT NULL GROUP BY 1)
SELECT metric, b.value AS base, c.value AS candidate, round(c.value - b.value, 3) AS difference FROM b FULL JOIN c USING (metric)""")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda k: records(spark, sf_dir).where((F.col("doc_id") % 2 == k) & F.col("source_name").isNotNull()).groupBy(F.col("source_name").alias("metric")).agg(F.round(F.avg(F.char_length("body")), 3).alias("value"))
    return G.metric_differences(run(0), run(1)).withColumn("difference", F.round("difference", 3))
