"""Cleaning, sections and issues over bodies built from the documents' whole texts; the SQL holds its own lists.

The tables hold no Vietnamese journals: lines that the operators look for are
put between the lines of the documents, so that every branch is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as L
from ..functions import quarantine as Q
from ..functions import rewriting as W
from ..operators import sectionizers as S
from .registry import REC, records, register
from .text_queries import quoted

#: Lines put before a body: noise of each kind, and letters in parts.
_LEAD = ["x.kcb_Nguyen Van An_29/10/2025 17:15:41", "TẠP CHÍ Y HỌC VIỆT NAM SỐ 5", " 12 ", "VIETNAM MEDICAL JOURNAL N.2", "BÀI NGHIÊN CỨU", "Độc lập - Tự do - Hạnh phúc", "Tiếng Việt và ngữ nghĩa", "KẾT QUẢ NGHIÊN CỨU", "1. Đặt vấn đề chung"]
_BROKEN = r"((?:[^ \n]+ ){6}[^ \n]+) "


def _broken_body() -> Column:
    """A body whose lines break after every seventh word, behind the lines above."""
    return F.concat(F.lit("\n".join(_LEAD) + "\n"), F.regexp_replace("body", _BROKEN, "$1\n"))


_TRIM = "trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))"
_HEAD = (r"(?i)^((I{1,3}V?|VI{0,3}|IX|X)\.\s+.+|[0-9]+\.\s+[A-ZÀ-Ỹ].{5,}|[A-ZÀ-Ỹ][A-ZÀ-Ỹ\s,()]{15,}|TÓM TẮT|ABSTRACT|SUMMARY|ĐẶT VẤN ĐỀ|GIỚI THIỆU|MỞ ĐẦU|ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP.*|KẾT QUẢ.*|BÀN LUẬN|KẾT LUẬN|KIẾN NGHỊ|TÀI LIỆU THAM KHẢO"
         r"|LỜI NÓI ĐẦU|MỤC LỤC|DANH MỤC.*|ĐẠI CƯƠNG|CHỈ ĐỊNH|CHỐNG CHỈ ĐỊNH|CHUẨN BỊ|CÁC BƯỚC TIẾN HÀNH|THEO DÕI|TAI BIẾN|Chương\s+[0-9]+)$")
_NOISE = [r"^[a-zA-Z0-9_.]+_[A-Za-zÀ-ỹ\s]+_[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}$", r"^\s*[0-9]{1,5}\s*$", r"(?i)^TẠP CHÍ Y\s*.{0,60}(SỐ|TẬP|THÁNG).*$", r"(?i)^HUE JOURNAL OF MEDICINE AND PHARMACY\s+ISSN.*$",
          "(?i)^VIETNAM MEDICAL JOURNAL.*$", r"(?i)^BÀI NGHIÊN CỨU\s*$", r"^(CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM|Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc)\s*$"]
_LAST = "string_split(a, chr(10))[-1]"


@register("x17_clean_text", f"""WITH {REC}, b AS (SELECT doc_id, nfc_normalize(array_to_string({quoted(_LEAD)}, chr(10)) || chr(10) || regexp_replace(body, '{_BROKEN}', '\\1' || chr(10), 'g')) AS t FROM rec),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_TRIM.format('x')}), lambda x: NOT ({' OR '.join(f"regexp_matches(x, '{p}')" for p in _NOISE)})) AS ls FROM b),
m AS (SELECT doc_id, CASE WHEN len(ls) = 0 THEN '' ELSE list_reduce(ls, lambda a, x: CASE WHEN x <> '' AND {_LAST} <> '' AND NOT regexp_matches(x, '{_HEAD}') AND NOT regexp_matches({_LAST}, '{_HEAD}')
  AND right(a, 1) NOT IN ('.', '?', '!', ';', ':', '。', '）', ')') AND len(x) > 5 THEN a || ' ' || x ELSE a || chr(10) || x END) END AS t FROM l)
SELECT doc_id, md5({_TRIM.format("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")}) AS value FROM m""")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.md5(L.clean_text(_broken_body())).alias("value"))


@register("nfc_whole_bodies", f"WITH {REC} SELECT doc_id, md5(nfc_normalize(nfd)) AS value FROM (SELECT doc_id, replace(replace(replace(body, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'a', 'a' || chr(770) || chr(803)) AS nfd FROM rec)")
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.replace(F.replace(F.col("body"), F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")), F.lit("a"), F.lit("ậ"))
    return records(spark, sf_dir).select("doc_id", F.md5(L.nfc(apart)).alias("value"))


# ------------------------------------------------------------------ sections
def _procedures() -> Column:
    """A body under numbered titles: a preamble, two procedures with anchors, one numbered line without, an office line, references."""
    title = F.concat(F.lit("Quy trình kỹ thuật số "), F.col("doc_id").cast("string"))
    return F.concat_ws(
        "\n", F.lit("BỘ Y TẾ\nMục lục ....... 3\n17"), F.concat(F.lit("1. "), title), F.lit("1. ĐẠI CƯƠNG"), F.lit("2. CHỈ ĐỊNH"), F.col("body"), F.lit("Căn cứ Luật\nKý bởi: x"),
        F.concat(F.lit("2. "), title, F.lit(" tiếp theo")), F.lit("một dòng"), F.lit("CHUẨN BỊ dụng cụ"), F.lit("3. AN TOÀN"), F.col("body"), F.lit("3. Một dòng có số nhưng không có mục"), F.lit("TÀI LIỆU THAM KHẢO"), F.lit("1. x"))


def _told(sections: Column) -> Column:
    """Sections as one row each, with digests of their bodies."""
    return F.posexplode(sections).alias("at", "s")


def _sections(df: DataFrame, sections: Column) -> DataFrame:
    return df.select("doc_id", _told(sections)).select("doc_id", F.col("at").cast("long").alias("at"), "s.section_title", "s.heading_path", F.md5("s.body").alias("body_md5"))


@register("w11_x07_procedures")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of whole bodies; the boundaries look ahead and the bodies are cut thrice, so tests hold them against a plain loop."""
    return _sections(records(spark, sf_dir), S.procedure_sections(F.col("title"), _procedures()))


def _table() -> Column:
    """A body as rows of a table: every line is numbered where its place in the body is even, some numbers far off."""
    line = lambda x, i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + F.when(i % 14 == 12, 50).otherwise(1)).cast("string"), F.lit(" "), x)).when(i % 4 == 1, F.concat(F.lit("Tiêm: "), x, F.lit(" Điều trị sốt cao."))).otherwise(x)
    return F.concat(F.lit("STT\nTên hoạt chất\n"), F.array_join(F.transform(F.split("body", "\n"), line), "\n"))


@register("x08_table_rows")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of whole bodies; which number is expected depends on all lines before, so tests hold them against a plain loop."""
    return _sections(records(spark, sf_dir), S.table_sections(F.col("title"), _table()))


_SOURCES = ["who_vietnam", "kcb_moh", "dav_gov", "vmj_ojs", "other"]


@register("x05_x06_x09_sectionize")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way of cutting, by the kind of the source, over whole bodies; tests hold each against a plain loop."""
    pick = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("doc_id") % len(_SOURCES) + 1).cast("int"))
    body = F.concat_ws("\n", F.lit("TÓM TẮT"), "body", F.lit("KẾT QUẢ NGHIÊN CỨU 2"), F.replace(F.col("body"), F.lit("\n"), F.lit("\n\n")), F.lit("REFERENCES"), F.lit("1. x"))
    return _sections(records(spark, sf_dir), S.sectionize(F.col("title"), body, pick))


@register("w10_x10_issue_articles")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of five documents each, with their whole bodies, split again; the look-back is an order fold, so tests hold it against a plain loop."""
    c = F.col
    named = F.concat_ws("\n", F.concat(F.upper(F.concat("title", F.lit(" của nghiên cứu thứ"))), F.lit(" X")), F.lit("Nguyen Van An1, Tran Thi Be2"), F.lit("TÓM TẮT"))
    part = F.concat_ws("\n", F.lit("TẠP CHÍ Y HỌC VIỆT NAM"), F.when(c("doc_id") % 7 > 0, named).otherwise(F.lit("ABSTRACT")), "body")
    issues = records(spark, sf_dir).groupBy(F.floor(c("doc_id") / 5).alias("issue")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    return S.split_issues(issues).select("issue", "article_index", "start", "score", "title", "author", "n_lines", F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ titles and answers
_TITLES = ["pdf", "Skip to main content", "some-slug-of-words", "File_name.v2-final", "0123456789abcdef01234567", "A good plain title", "short", "", "Xem  chi tiết", "Ngữ liệu của đề tài"]
_CLEANED = "trim(regexp_replace(nfc_normalize({}), '\\s+', ' ', 'g'))"


@register("t54_needs_cleanup", f"""WITH {REC}, t AS (SELECT doc_id, {_CLEANED.format(f"CASE WHEN doc_id % 3 = 0 THEN title ELSE {quoted(_TITLES)}[(doc_id % 10 + 1)::INT] END")} AS t FROM rec)
SELECT doc_id, len(t) < 10 OR lower(t) IN ('skip to main content', 'pdf', 'document', 'xem chi tiết', 'xem chi tiet', 'trang ch tin tc gii thiu') OR regexp_matches(t, '(?i)^[0-9a-f]{{24,}}$') OR regexp_matches(lower(t), '^[a-z0-9]+(?:[-_][a-z0-9]+){{2,}}$')
  OR (regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9_.-]{{8,}}$') AND NOT contains(t, ' ')) AS value FROM t""")
def t54(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, F.col("title")).otherwise(F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("doc_id") % 10 + 1).cast("int")))
    return records(spark, sf_dir).select("doc_id", L.needs_cleanup(F.regexp_replace(title, r"\s+", " ")).alias("value"))


@register("t71_h60_short_answers")
def t71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of whole bodies by their own words, and the choice between answers; greedy cover is an order fold, so tests hold it against a plain loop."""
    words = F.filter(F.array_distinct(F.split(F.regexp_replace("body", r"[^\p{L} ]+", " "), " +")), lambda w: F.char_length(w) > 4)
    wanted = F.transform(F.filter(words, lambda w, i: i % 9 == 0), lambda w: w)
    at = records(spark, sf_dir).select("doc_id", "body", "title", F.slice(wanted, 1, 70).alias("concepts")).withColumn("cover", W.greedy_cover(F.col("body"), F.col("concepts")))
    chosen = W.choose_short_answer(F.col("title"), F.col("body"), F.col("concepts"), F.col("doc_id") % 4 > 0, F.col("cover"))
    return at.select("doc_id", F.md5("cover").alias("cover_md5"), chosen.alias("x")).select("doc_id", "cover_md5", F.md5("x.answer").alias("answer_md5"), "x.strategy", "x.before", "x.after")


# ------------------------------------------------------------------ quarantine
_FILES = ["dav_gov", "kcb_moh", "who_vietnam", "vien_dinh_duong", "vmj_ojs", "other"]
_LINKS = ["", "http://x.org/gioi-thieu/a", "http://x.org/news/some-long-slug-of_words.html", "http://x.org/SITE-MAP"]
_MORE = ["", "Tải xuống\n01/02/2020\ndownload\n1/2/2021 10:00:00\nTai xuong\n3/4/2022", "Ký bởi: A\nCơ quan: B\nNgày ký: C", "Phần một ........ 7\nDownload\nDownload\nDownload\n1/1/2020\n1/1/2020\n1/1/2020"]


def _of(values: list[str], n: int) -> str:
    return f"{quoted(values)}[(doc_id // {n} % {len(values)} + 1)::INT]"


def _pick(values: list[str], n: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))


_LN = "list_filter(list_transform((string_split(t, chr(10)))[:80], lambda x: trim(x)), lambda x: x <> '')"


@register("f23_f25_quarantine", f"""WITH {REC}, r AS (SELECT doc_id, {_of(_FILES, 1)} AS s, CASE WHEN doc_id % 5 = 0 THEN 'Xem chi tiết' ELSE title END AS title, {_of(_LINKS, 6)} AS u, {_of(_MORE, 2)} || chr(10) || CASE WHEN doc_id % 3 = 0 THEN body ELSE '' END AS t FROM rec),
l AS (SELECT *, {_LN} AS ls FROM r), x AS (SELECT *, len(list_filter(ls, lambda x: lower(x) IN ('tải xuống', 'tai xuong', 'download'))) >= 3 AND len(list_filter(ls, lambda x: regexp_full_match(x, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}( +[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})?'))) >= 3
  AND len(list_filter(ls, lambda x: regexp_matches(x, '[.]{{6,}}\\s*[0-9]+\\s*$') OR regexp_matches(x, '(?i)^\\s*([0-9]+|[IVXLC]+)\\s+.+\\s+[0-9]+\\s*$'))) = 0 AS listing FROM l)
SELECT doc_id, listing, s IN ('dav_gov', 'kcb_moh') AND len(t) <= 450 AND contains(lower(t), 'ký bởi:')::INT + contains(lower(t), 'cơ quan:')::INT + contains(lower(t), 'ngày ký:')::INT + contains(lower(t), 'sonht.kcb_')::INT + contains(lower(t), 'độc lập - tự do - hạnh phúc')::INT >= 2
  AND len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) <= 18 AS stub, title = 'Xem chi tiết' OR (s IN ('who_vietnam', 'vien_dinh_duong', 'vmj_ojs') AND u = '') OR (s = 'vien_dinh_duong' AND (contains(lower(u), '/gioi-thieu') OR contains(lower(u), '/site-map') OR listing)) AS wrapper FROM x""")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(_pick(_MORE, 2), F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, F.col("body")).otherwise(""))
    title = F.when(F.col("doc_id") % 5 == 0, "Xem chi tiết").otherwise(F.col("title"))
    return records(spark, sf_dir).select("doc_id", Q.download_listing(body).alias("listing"), Q.admin_stub(_pick(_FILES, 1), body).alias("stub"), Q.wrapper_page(_pick(_FILES, 1), title, _pick(_LINKS, 6), body).alias("wrapper"))
