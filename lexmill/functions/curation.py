"""Curation of titles, addresses, file names and texts before they become records; hits of answers against a gold set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import fix_code_page
from .text import blank, let, lines, normalize_eval, squeeze

# ---------------------------------------------------------------- fixed values
CITATION_LINE = r"[0-9]{4}\s*;\s*[0-9]+\s*(?:\([0-9]+\))?\s*:\s*(?:e?[0-9]+|[A-Z][0-9]+)"
DOI = r"10\.[0-9]{4,}/"
JUNK_TITLES = [
    r"(?i)^(?:tên bài viết|untitled|no title|\.+)$",
    r"^[0-9]{4}[\s.;]+[0-9]+\s*\([0-9]+\)",
    r"^[0-9]{4}\.\s*[0-9]+\([0-9]+\)",
    r"^[0-9]{4}[\s.;:]+[0-9]+(?:\([0-9]+\))?[:;]\s*[A-Za-z]?[0-9]+",
]
LOWER_FRAGMENT = r"^[a-zà-ỹ][^\n]{0,80}$"
LONG_WORD = r"[A-Za-zÀ-ỹ]{5,}"
FILE_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip"]
WHO_HOSTS = ["www.who.int", "who.int", "cdn.who.int"]
WHO_PATHS = ["/fact-sheets/detail/", "/health-topics/", "/publications/", "/news-room/"]
WHO_VN_HOSTS = ["www.who.int", "who.int", "cdn.who.int", "apps.who.int"]
WHO_VN_SIGNALS = ["viet-nam", "vietnam", "westernpacific"]
WHO_VN_PATHS = ["/vietnam", "/viet-nam", "/westernpacific/", "/publications/", "/news-room/", "/news/"]
WHO_TYPES = [("/fact-sheets/detail/", "fact_sheet"), ("/health-topics/", "health_topic"), ("/publications/", "publication_page"), ("/news-room/", "news_page"), ("/news/", "news_page")]
MOST_FILENAME = 140
BAD_TITLES = ["pdf", "", "document", "untitled"]
REFERENCE_TITLE_LINE = [
    r"^[0-9]+\.\s+[A-ZÀ-Ỹa-zà-ỹ].*(?:et al|pp?\.\s*[0-9]|\([0-9]{4}\))",
    r"Pan Afr Med J",
    r"doi:\s*10\.",
    r"PMID:\s*[0-9]+",
    r"Lancet|NEJM|BMJ|PLoS",
    r"J\s+[A-Z][a-z]+\s+[A-Z][a-z]+",
    r"Am\s+J\s+[A-Z]",
    r"Int\s+J\s+[A-Z]",
    r"World\s+J\s+[A-Z]",
    r"Prev\s+Chronic\s+Dis",
    r"N\s+Engl\s+J\s+Med",
    r"Cochrane\s+Database",
    r"ISSN\s+[0-9]",
    r"[A-Z][a-z]+\s+et\s+al",
    r"\([0-9]{4}\)\s*[.,]",
    r"https?://",
    r"pp\.\s*[0-9]+-[0-9]+",
]
TABLE_HEADER = [r"^TT\s", r"^STT\s", "^Tên hoạt chất", "^Tên thuốc", "^Đường dùng", "^Hàm lượng", "^Đơn vị", "^Số lượng", "^Nồng độ"]
SKIPPED_LINES = [
    r"(?iu)^TẠP CHÍ\s*$",
    r"(?iu)^SỐ\s+[0-9]+.*$",
    r"(?iu)^TẠP CHÍ Y\s*.{0,60}(SỐ|TẬP).*$",
    r"(?iu)^HUE JOURNAL.*ISSN.*$",
    r"(?iu)^VIETNAM MEDICAL JOURNAL.*$",
    r"(?iu)^BÀI NGHIÊN CỨU\s*$",
    r"^ISSN\s+[0-9]+.*$",
    r"^DOI:.*$",
    r"(?iu)^TẠP CHÍ SỐ\s+[0-9]+.*$",
]
JOURNAL_HEADER = r"(?iu)(TẠP CHÍ Y|vietnam medical journal|VIETNAM MEDICAL)"
PDF_HEADER = r"(?iu)^(vietnam medical journal(?![\p{L}\p{N}_]).*|tạp chí y học việt nam(?![\p{L}\p{N}_]).*)$"
PDF_HEADINGS = [
    r"(TÓM TẮT[0-9]*)", r"(SUMMARY)", r"(ABSTRACT)", r"(I\.\s*ĐẶT VẤN ĐỀ)", r"(I\.\s*INTRODUCTION)",
    r"(II\.\s*ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP NGHIÊN CỨU)", r"(TÀI LIỆU THAM KHẢO)", r"(Từ khóa:)", r"(Keywords:)",
]
TOC_DOTS, TOC_NUMBERED = r"\.{6,}\s*[0-9]+\s*$", r"(?i)^\s*([0-9]+|[IVXLC]+)\s+.+\s+[0-9]+\s*$"
GENERIC_TITLES = ["mục lục", "contents", "pdf", "document", "tải xuống", "tai xuong", "download"]
RESIDUES = [("Â®", "®"), ("Â°", "°"), ("Â ", " "), ("â€“", "–"), ("â€”", "—"), ("â€™", "’"), ("â€œ", "“"), ("â€\u009d", "”")]
USPSTF_URL = "https://www.uspreventiveservicestaskforce.org/uspstf/recommendation/"
TRUNCATED_STARTS = ["và ", "trong ", "của ", "với ", "tại "]
REJECTED_TITLES = [
    r"^[0-9]+\.\s*$",
    r"^[0-9]+\.\s*[a-z]*$",
    r"\bdoi\b",
    r"[0-9]+\([0-9]+\)\s*:\s*[0-9]+",
    r"[0-9]{4};\s*[0-9]+\s*:\s*[0-9]+",
    r"mayo clin proc",
    r"[a-z0-9]+\.[0-9]{4}\.[0-9]+",
    r"^[0-9]+\.\s+[a-z]{1,4}\s+[a-z]{1,2}\.*",
]
REFERENCE_MARKS = ["tài liệu tham khảo", "references\n", "bibliography\n"]
RICH_MARKERS = [
    "mục tiêu", "objective", "đối tượng và phương pháp", "kết quả", "results", "kết luận", "conclusion", "yếu tố nguy cơ", "yếu tố liên quan", "so sánh",
    "OR", "HR", "p<", "p =", "KTC", "CI", "tỷ lệ", "trung bình", "ngưỡng",
]
CASE_REPORTS = ["ca lâm sàng", "case report", "trường hợp", "báo cáo ca", "nhân một trường hợp"]
GOLD_STRINGS = ["query_id", "ground_truth", "short_answer"]
GOLD_LISTS = ["must_have_concepts", "must_not_claim"]
# ----------------------------------------------------------------------------


def _any(c: Column, patterns: list[str]) -> Column:
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return out


def _holds(c: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(c, m))


def strip(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"^\s+|\s+$", "")


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


# ------------------------------------------------------------------ titles
def junk_title(title: Column) -> Column:
    """a placeholder, a citation, mostly digits, or a short lower-case fragment; a missing title isn't junk."""

    def judge(t: Column) -> Column:
        digits = F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Nd}", ""))
        return (t != "") & (_any(t, JUNK_TITLES) | ((F.char_length(t) < 10) & t.rlike(CITATION_LINE)) | ((digits > 0.25 * F.char_length(t)) & ~t.rlike(LONG_WORD))
                            | (t.rlike(LOWER_FRAGMENT) & (_words(t) <= 4)))

    return let(strip(title), judge)


def weak_chunk_title(title: Column) -> Column:
    """missing, short, a lower-case fragment, or with a citation or a DOI."""
    return let(strip(title), lambda t: (F.char_length(t) < 15) | t.rlike(LOWER_FRAGMENT) | t.rlike(CITATION_LINE) | t.rlike(DOI))


def bad_title(title: Column) -> Column:
    """H102: short, a placeholder, a reference, or the head of a table."""
    t = strip(title)
    return (F.char_length(t) < 10) | F.lower(t).isin(BAD_TITLES) | _any(t, REFERENCE_TITLE_LINE) | _any(t, TABLE_HEADER) | t.rlike(r"^,\s*$")


def generic_title(body: Column) -> Column:
    """H103, H104: the first of 40 lines with 20 signs or more that is no journal line, reference or table head, cut at 300 signs; else empty."""
    first = F.transform(F.slice(F.split(blank(body), r"\r\n|\r|\n"), 1, 40), strip)
    good = F.filter(first, lambda x: (F.char_length(x) >= 20) & ~_any(x, SKIPPED_LINES) & ~_any(x, REFERENCE_TITLE_LINE) & ~_any(x, TABLE_HEADER))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, 300)


def title_points(line: Column) -> Column:
    """How well a line would do as a book's title."""

    def score(x: Column) -> Column:
        low = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
        named = F.when(_holds(low, ["hội đồng biên tập", "chịu trách nhiệm", "thư ký", "ban biên tập"]), -16).otherwise(0)
        degree = F.when(_holds(low, ["pgs", "gs", "ts.", "bs.", "ths."]), -8).otherwise(0)
        office = F.when(_holds(low, ["viện dinh dưỡng", "bộ y tế", "trung tâm kiểm soát bệnh tật"]), -6).otherwise(0)
        points = (F.least(_words(x), F.lit(8)) * 5 + F.when(F.char_length(x) >= 16, 6).otherwise(0) + F.when(x == F.upper(x), 10).otherwise(0)
                  + F.when(x.rlike(r"\b[0-9]+\s*[~\-]\s*[0-9]+\b"), -12).otherwise(0) + F.when(low.rlike("^(số |so |issue |vol )"), -16).otherwise(0) + named + degree + office)
        return (F.when(low.isin(GENERIC_TITLES), -100).when(x.rlike(TOC_DOTS) | x.rlike(TOC_NUMBERED), -80).when(x.rlike(r"^[0-9.\-_/ ]+$"), -90).otherwise(points))

    return let(blank(line), score)


def repaired_title(title: Column) -> Column:
    """The title with single blanks, or why it can't be used."""
    t = squeeze(title)
    low = F.lower(t)
    start = F.lit(False)
    for p in TRUNCATED_STARTS:
        start = start | low.startswith(p)
    return F.when(start, "REJECT_TRUNCATED").when(_any(low, REJECTED_TITLES), "REJECT_REFERENCE_TITLE").otherwise(t)


# ------------------------------------------------------------------ addresses and files
def _url(url: Column) -> tuple[Column, Column]:
    """Host and path of an address, lower case."""
    u = F.lower(blank(url))
    rest = F.regexp_extract(u, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)([^?#]*)", 1), F.regexp_extract(u, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)([^?#]*)", 2)
    return rest


def file_asset(url: Column) -> Column:
    """The address ends in the suffix of a document."""
    return F.regexp_extract(_url(url)[1], r"(\.[a-z0-9]+)$", 1).isin(FILE_SUFFIXES)


def who_url(url: Column) -> Column:
    """A page or document of the organisation that is worth keeping."""
    host, path = _url(url)
    return host.isin(WHO_HOSTS) & ~F.contains(path, F.lit("mega-menu")) & (file_asset(url) | _holds(path, WHO_PATHS))


def who_vietnam_url(url: Column) -> Column:
    """The same for its Vietnamese pages."""
    host, path = _url(url)
    return host.isin(WHO_VN_HOSTS) & ~F.contains(path, F.lit("mega-menu")) & _holds(F.lower(blank(url)), WHO_VN_SIGNALS) & (file_asset(url) | _holds(path, WHO_VN_PATHS))


def who_item_type(url: Column) -> Column:
    """What kind of item an address names."""
    u = F.lower(blank(url))
    out = F.when(file_asset(url), "document_asset")
    for mark, kind in WHO_TYPES:
        out = out.when(F.contains(u, F.lit(mark)), kind)
    return out.otherwise("html_page")


def bounded_filename(name: Column, extension: str = "", most: int = MOST_FILENAME) -> Column:
    """A safe file name of ``most`` signs or fewer; a longer one is cut and keeps a digest of the whole."""
    ext = f".{extension}" if extension and not extension.startswith(".") else extension

    def shorten(s: Column) -> Column:
        cut = F.regexp_replace(F.substring(s, 1, max(16, most - len(ext) - 14)), r"[._\-]+$", "")
        short = F.concat(F.when(cut == "", "asset").otherwise(cut), F.lit("__"), F.substring(F.sha1(s), 1, 12), F.lit(ext))
        return F.when(F.char_length(s) + len(ext) <= most, F.concat(s, F.lit(ext))).otherwise(short)

    safe = F.regexp_replace(F.regexp_replace(blank(name), r"[^A-Za-z0-9._\-]+", "_"), r"^[._]+|[._]+$", "")
    safe = F.when(safe == "", "asset").otherwise(safe)
    return let(F.when(safe.endswith(ext), F.substring(safe, F.lit(1), F.char_length(safe) - len(ext))).otherwise(safe) if ext else safe, shorten)


def derived_url(url: Column, source_id: Column, path: Column) -> Column:
    """H114: the address of a record that lacks one, for the one source whose file names are its addresses."""
    stem = F.regexp_replace(F.regexp_extract(clean_scalar(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    own = clean_scalar(url)
    return F.when((own == "") & (clean_scalar(source_id) == "uspstf_recommendations") & (stem != ""), F.concat(F.lit(USPSTF_URL), stem)).otherwise(own)


# ------------------------------------------------------------------ texts
def clean_scalar(c: Column) -> Column:
    """One kind of line end, trimmed, wrong code pages repaired, left-over signs replaced."""
    out = fix_code_page(F.regexp_replace(F.regexp_replace(blank(c), r"\r\n?", "\n"), r"^\s+|\s+$", ""))
    for old, new in RESIDUES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def drop_journal_lines(c: Column) -> Column:
    """A text's lines without journal headers."""
    return F.array_join(F.filter(F.split(blank(c), "\n"), lambda x: ~x.rlike(JOURNAL_HEADER)), "\n")


def pdf_text(c: Column) -> Column:
    """Text of a page without page numbers, runs of blanks and empty lines."""
    t = F.regexp_replace(F.regexp_replace(blank(c), r"[ \t]+", " "), r"(?m)^\s*[0-9]{1,3}\s*$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def rotate_to_title(text: Column, title: Column, least: int = 200) -> Column:
    """Where the title, of three words or more, comes after ``least`` signs, what precedes it goes behind."""

    def turn(pattern: Column) -> Column:
        def move(at: Column) -> Column:
            head, tail = strip(F.substring(text, F.lit(1), at - 1)), strip(F.substring(text, at, F.char_length(text)))
            return F.when((at - 1 > least) & (tail != ""), F.when(head == "", tail).otherwise(F.concat(tail, F.lit("\n\n"), head))).otherwise(text)

        return let(F.regexp_instr(text, pattern), move)

    tokens = F.filter(F.split(pdf_text(title), r"\s+"), lambda w: w != "")
    quoted = F.transform(tokens, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(F.size(tokens) < 3, text).otherwise(let(F.concat(F.lit("(?iu)"), F.array_join(quoted, r"\s+")), turn))


def clean_journal_pdf(c: Column) -> Column:
    """H113: no journal headers, and an empty line before each known heading inside a line."""
    t = F.array_join(F.filter(F.split(blank(c), r"\r\n|\r|\n"), lambda x: ~strip(x).rlike(PDF_HEADER)), "\n")
    for p in PDF_HEADINGS:
        t = F.regexp_replace(t, rf"(?iu)(?<!\n){p}", "\n\n$1")
    return pdf_text(t)


def body_without_title(body: Column, title: Column) -> Column:
    """One kind of line end, at most one empty line, and no first line that repeats the title."""
    t = strip(F.regexp_replace(F.regexp_replace(blank(body), r"\r\n?", "\n"), r"\n{3,}", "\n\n"))

    def cut(rows: Column) -> Column:
        return strip(F.array_join(F.when(F.lower(rows[0]) == F.lower(strip(title)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows), "\n"))

    return F.when((t == "") | (blank(title) == ""), t).otherwise(let(F.transform(F.split(t, "\n"), strip), cut))


def reference_tail(body: Column) -> Column:
    """struct(body, flags): no reference list that starts in the second half; marks are tried in order."""

    def cut(b: Column) -> Column:
        low, out = F.lower(b), None
        for m in REFERENCE_MARKS:
            tail = F.instr(F.reverse(low), m[::-1])
            at = F.char_length(b) - tail - (len(m) - 1)
            hit = (tail > 0) & (at > F.char_length(b) / 2)
            found = F.struct(strip(F.substring(b, F.lit(1), at)).alias("body"), F.array(F.lit("removed_reference_tail")).alias("flags"))
            out = F.when(hit, found) if out is None else out.when(hit, found)
        return out.otherwise(F.struct(b.alias("body"), F.array().cast("array<string>").alias("flags")))

    return let(blank(body), cut)


def merge_flags(own: Column, more: Column) -> Column:
    """Flags with those added that are new and not empty, in order; the own ones stay as they are."""
    return F.concat(own, F.filter(F.array_except(F.array_distinct(more), own), lambda x: F.coalesce(x, F.lit("")) != ""))


def processed_stem(path: Column, content_class: Column, suffixes: list[str]) -> Column:
    """A file's name, without its suffix where that is one of ``suffixes``."""
    name = F.regexp_extract(blank(path), r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    known = F.lower(suffix).isin(suffixes)
    kinds = ["html", "html_book", "xml", "pdf", "txt", "md", "csv", "jsonl", "json"]
    return F.when((suffix != "") & ~known, name).when((suffix == "") & content_class.isin(kinds), name).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))


def seed_queries(title: Column, context: Column, quality: Column) -> Column:
    """How many questions a seed bears: two if it is rich, else one."""
    c, t = F.lower(blank(context)), F.lower(blank(title))
    case = F.exists(F.array(*[F.lit(m) for m in CASE_REPORTS]), lambda m: F.contains(t, m) | F.contains(F.substring(c, 1, 200), m))
    rich = F.size(F.filter(F.array(*[F.lit(m) for m in RICH_MARKERS]), lambda m: F.contains(c, m)))
    return F.when((quality == "borderline") | case | (rich < 3), 1).otherwise(2)


# ------------------------------------------------------------------ gold set
def title_hit(gold: Column, found: Column) -> Column:
    """Equal titles, or one within the other."""
    g, f = normalize_eval(gold), normalize_eval(found)
    return (g != "") & (f != "") & (F.contains(g, f) | F.contains(f, g))


def source_hit(source: Column, wanted: Column) -> Column:
    """The wanted source within the source's name."""
    return F.contains(F.lower(blank(source)), F.lower(blank(wanted)))


def title_source_hit(source: Column, title: Column, heading: Column, wanted_source: Column, wanted_title: Column) -> Column:
    """The source, and the title within title or heading if one is wanted."""
    w = F.lower(blank(wanted_title))
    return source_hit(source, wanted_source) & ((w == "") | F.contains(F.lower(blank(title)), w) | F.contains(F.lower(blank(heading)), w))


def haystack(chunks: Column) -> Column:
    """Metadata and the first 800 signs of each chunk (title, canonical_title, section_title, source_name, doc_type, specialty, text) in one text."""
    fields = ["title", "canonical_title", "section_title", "source_name", "doc_type", "specialty"]
    every = F.flatten(F.transform(chunks, lambda c: F.array(*[blank(c[f]) for f in fields], F.substring(blank(c["text"]), 1, 800))))
    return F.array_join(F.filter(every, lambda x: x != ""), " ")


def concept_hit_rate(text: Column, keywords: Column) -> Column:
    """Share of keywords within a text; null without keywords."""

    def rate(t: Column) -> Column:
        n = F.size(F.filter(keywords, lambda k: (normalize_eval(k) != "") & F.contains(t, normalize_eval(k))))
        return F.when(F.size(keywords) == 0, F.lit(None).cast("double")).when(t == "", 0.0).otherwise(n / F.size(keywords))

    return let(normalize_eval(text), rate)


def top_titles(titles: Column, most: int = 8) -> Column:
    """The first distinct non-empty titles."""
    return F.slice(F.array_distinct(F.filter(F.transform(titles, strip), lambda t: t != "")), 1, most)


def phrase_hits(answer: Column, phrases: Column) -> Column:
    """The phrases that an answer holds, in order."""
    return let(normalize_eval(answer), lambda a: F.filter(phrases, lambda p: (normalize_eval(p) != "") & F.contains(a, normalize_eval(p))))


def gold_errors(record: Column) -> Column:
    """What is wrong with a gold record, a variant."""
    errors = []
    kind = {n: F.schema_of_variant(F.try_variant_get(record, f"$.{n}", "variant")) for n in (*GOLD_STRINGS, *GOLD_LISTS)}
    for n in (*GOLD_STRINGS, *GOLD_LISTS):
        errors.append(F.when(kind[n].isNull(), F.lit(f"missing field: {n}")))
    for n in GOLD_STRINGS:
        empty = strip(F.try_variant_get(record, f"$.{n}", "string")) == ""
        errors.append(F.when(kind[n].isNotNull() & (kind[n] != "STRING"), F.lit(f"{n} must be a string")).when((kind[n] == "STRING") & empty, F.lit(f"{n} must not be empty")))
    for n in GOLD_LISTS:
        other = F.exists(F.try_variant_get(record, f"$.{n}", "array<variant>"), lambda x: F.schema_of_variant(x) != "STRING")
        errors.append(F.when(kind[n].isNotNull() & ~kind[n].startswith("ARRAY"), F.lit(f"{n} must be a list")).when(kind[n].startswith("ARRAY") & other, F.lit(f"{n} must contain only strings")))
    found = F.array_compact(F.array(*errors))
    return F.when(~F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)), F.array(F.lit("record is not a JSON object"))).otherwise(found)


def gold_strings(record: Column) -> Column:
    """Array of (field, value): the strings of a gold record, list items as ``field[i]``."""
    none = F.array().cast("array<struct<field:string,value:string>>")
    out = [none]
    for n in GOLD_STRINGS:
        v = F.try_variant_get(record, f"$.{n}", "variant")
        out.append(F.when(F.schema_of_variant(v) == "STRING", F.array(F.struct(F.lit(n).alias("field"), F.try_variant_get(record, f"$.{n}", "string").alias("value")))).otherwise(none))
    for n in GOLD_LISTS:
        v = F.coalesce(F.try_variant_get(record, f"$.{n}", "array<variant>"), F.array().cast("array<variant>"))
        out.append(F.array_compact(F.transform(v, _item(n))))
    return F.concat(*out)


def _item(name: str):
    """An item of the list of this name that is a string, as (field, value); else null."""

    def item(x: Column, i: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("field"), F.try_variant_get(x, "$", "string").alias("value")))

    return item
