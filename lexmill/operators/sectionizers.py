"""Bodies to sections by the kind of their source: procedures, table rows, articles, publications; and journal issues to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import split_lines, trimmed
from ..functions.evidence import uppercase_title
from ..functions.text import blank, let, strip_references

# ---------------------------------------------------------------- fixed values
SOURCE_MODES = {
    "who_vietnam": "publication",
    "kcb_moh": "procedure",
    "dav_gov": "table_entry",
    "hue_jmp_ojs": "article",
    "mil_med_pharm_journal": "article",
    "trad_med_pharm_journal": "article",
    "cantho_med_journal": "article",
    "vmj_ojs": "article",
}
DROPPED_SECTIONS = ["TÀI LIỆU THAM KHẢO", "REFERENCES"]
ARTICLE_HEADINGS = [
    "TÓM TẮT", "ABSTRACT", "SUMMARY", "ĐẶT VẤN ĐỀ", "GIỚI THIỆU", "MỞ ĐẦU", "ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP.*", "VẬT LIỆU VÀ PHƯƠNG PHÁP.*",
    "KẾT QUẢ.*", "BÀN LUẬN", "KẾT LUẬN", "KIẾN NGHỊ", "TÀI LIỆU THAM KHẢO", "REFERENCES",
]
PROCEDURE_ANCHORS = [
    "ĐẠI CƯƠNG", "CHỈ ĐỊNH", "CHỐNG CHỈ ĐỊNH", "THẬN TRỌNG", "CHUẨN BỊ", "CÁC BƯỚC TIẾN HÀNH", "TIẾN HÀNH QTKT", "THEO DÕI VÀ XỬ TRÍ TAI BIẾN",
    "AN TOÀN", "NHỮNG SAI SÓT VÀ XỬ TRÍ", "TIÊU CHUẨN ĐÁNH GIÁ VÀ ĐẢM BẢO CHẤT LƯỢNG",
]
SUBSECTION_NAMES = [
    *PROCEDURE_ANCHORS, "TIẾN HÀNH", "THEO DÕI", "TAI BIẾN", "TÀI LIỆU THAM KHẢO", "REFERENCES", "NHỮNG SAI SÓT", "TIÊU CHUẨN ĐÁNH GIÁ", "MỤC ĐÍCH", "NGUYÊN LÝ",
]
NUMBERED_ANCHORS = [*PROCEDURE_ANCHORS, "MỤC ĐÍCH"]
ADMIN_LINES = [
    "BỘ Y TẾ", "CỘNG HÒA", "QUYẾT ĐỊNH", r"KT\. BỘ TRƯỞNG", "Nơi nhận", "THỨ TRƯỞNG", r"Điều \d+", "Căn cứ", "Theo đề nghị", "Số:", "Hà Nội",
    "HƯỚNG DẪN QUY TRÌNH", "VỀ HÔ HẤP", "NGUYÊN TẮC XÂY DỰNG", "Chỉ đạo biên soạn", "Chủ biên", "Tham gia biên soạn",
    r"GS\.TS\.", r"PGS\.TS\.", r"TS\.", r"ThS\.", r"BSCKII\.", r"BS\.", "Phó Cục trưởng", "Cục trưởng", "Giám đốc", "Phó Giám đốc",
    "Trưởng khoa", r"STT\s", "Mã liên", "Tên kỹ thuật",
]
SIGNATURES = ["ngoctlv.kcb", "Ký bởi"]
TABLE_HEADS = ["TT", "STT"]
TABLE_HEAD_STARTS = ["Tên hoạt chất", "Đường dùng", "Chỉ định phòng"]
ROUTE = r"(Tiêm|Uống|Dùng ngoài|Nhỏ mắt|Hít):?\s*(.*?)(?:Điều trị|Chỉ định|$)"
INDICATION = r"(?s)(Điều trị|Chỉ định)\s+(.+?)(?:\.\s*(?:Điều trị|Chỉ định)|$)"
ISSUE_ANCHOR = r"(?iu)^\s*(TÓM TẮT|ABSTRACT|I\.\s*ĐẶT VẤN ĐỀ)"
ISSUE_HEADER = r"(?iu)TẠP CHÍ Y|vietnam medical journal"
ISSUE_SECTION = r"(?iu)^\s*(KẾT QUẢ|BÀN LUẬN|KẾT LUẬN|TÀI LIỆU THAM KHẢO|REFERENCES)"
# Two names in a row. A repeated group (``([..]+\s+){2,}.*?\d+``) would recurse for each word of a long line; two in a row before the last digit say the same.
_NAME = "[ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼỀỂẾỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴÝỶỸA-Za-zàáâãèéêìíòóôõùúăđĩũơưạảấầẩẫậắằẳẵặẹẻẽềểếễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"
ISSUE_NAMES = rf"(?iu){_NAME}\s+{_NAME}++\s"
#: Lines behind an anchor that are searched, points that make a boundary, lines within which a second start is the same one.
LOOK_BACK, LEAST_POINTS, SAME_START = 15, 5, 10
#: Lines ahead of a numbered line that are searched for anchors, and how many make it a procedure.
LOOK_AHEAD, LEAST_ANCHORS = 11, 2
# ----------------------------------------------------------------------------
SECTIONS = "array<struct<section_title:string,heading_path:string,body:string>>"
_ARTICLES = "array<struct<article_index:int,start:int,score:int,title:string,author:string,n_lines:int,text:string>>"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _alternatives(patterns: list[str]) -> str:
    return "|".join(patterns)


def _starts_with_any(c: Column, values: list[str]) -> Column:
    return F.exists(_array(values), lambda v: c.startswith(v))


def _places(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def _part(items: Column, start: Column, end: Column) -> Column:
    return F.slice(items, start + 1, F.greatest(end - start, F.lit(0)))


def _section(title: Column, path: Column, body: Column) -> Column:
    return F.struct(title.alias("section_title"), path.alias("heading_path"), body.alias("body"))


def _one(title: Column, body: Column) -> Column:
    return F.array(_section(title, title, body))


def _under(title: Column, name: Column) -> Column:
    return F.concat(title, F.lit(" > "), name)


def _none() -> Column:
    return F.array().cast(SECTIONS)


# ------------------------------------------------------------------ procedures
def anchor_weight(line: Column) -> Column:
    """How many anchor headings a line ahead of a procedure's title stands for: by number, and by name."""
    up = F.upper(line)
    numbered = line.rlike(rf"(?iu)^\d+\.\s*(?:{_alternatives(NUMBERED_ANCHORS)})\s*$")
    return F.when(numbered, 1).otherwise(0) + F.when(_starts_with_any(up, PROCEDURE_ANCHORS), 1).otherwise(0)


def procedure_title(line: Column) -> Column:
    """A numbered line that may name a procedure, as ``number. name``; empty for any other line."""
    number, name = F.regexp_extract(line, r"^(\d{1,3})\.\s+(.+)$", 1), trimmed(F.regexp_extract(line, r"^(\d{1,3})\.\s+(.+)$", 2))
    good = (number != "") & (F.char_length(name) >= 15) & ~_starts_with_any(trimmed(F.upper(name)), SUBSECTION_NAMES)
    return F.when(good, F.concat(number, F.lit(". "), name)).otherwise("")


def procedure_lines(body: Column) -> Column:
    """A body's lines without contents, page numbers and signatures."""
    return F.filter(split_lines(body), lambda x: let(trimmed(x), lambda s: ~s.rlike(r"\.{3,}") & ~s.rlike(r"^\d{1,4}\s*$") & ~F.exists(_array(SIGNATURES), lambda m: F.contains(s, m))))


def procedure_boundaries(lines: Column) -> Column:
    """(place, title) of each numbered line with two anchors or more in the eleven lines behind it."""

    def ahead(stripped: Column) -> Column:
        return let(F.transform(stripped, anchor_weight), lambda w: F.transform(
            stripped, lambda x, i: F.struct(i.alias("at"), F.when(F.aggregate(F.slice(w, i + 2, LOOK_AHEAD), F.lit(0), lambda a, y: a + y) >= LEAST_ANCHORS, procedure_title(x)).otherwise("").alias("title"))))

    return F.filter(let(F.transform(lines, trimmed), ahead), lambda b: b["title"] != "")


def procedure_sections(title: Column, body: Column) -> Column:
    """A section of 200 signs or more for each procedure, without references and office lines; else the whole body, if that is as long."""

    def build(lines: Column) -> Column:
        def cut(marks: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                end = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
                text = strip_references(trimmed(F.array_join(_part(lines, m["at"], end), "\n")))
                clean = F.filter(split_lines(text), lambda x: ~trimmed(x).rlike(rf"(?iu)^(?:{_alternatives(ADMIN_LINES)})"))
                return _section(m["title"], _under(title, m["title"]), trimmed(F.array_join(clean, "\n")))

            return F.filter(F.transform(marks, one), lambda s: F.char_length(s["body"]) >= 200)

        found = let(procedure_boundaries(lines), cut)
        whole = strip_references(trimmed(F.array_join(lines, "\n")))
        rest = let(whole, lambda w: F.when(F.char_length(w) >= 200, _one(title, w)).otherwise(_none()))
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))

    return let(procedure_lines(body), build)


# ------------------------------------------------------------------ table rows
def table_entries(body: Column) -> Column:
    """Rows (number, name, extra) of a table as text: numbered lines within two of the row that comes next, each with the lines behind it.

    A row counts once lines stand behind it, so the number that is expected
    depends on all rows before: one pass over the lines.
    """
    entry = "array<struct<number:bigint,name:string,extra:string>>"
    lines = F.filter(F.transform(split_lines(body), trimmed), lambda x: (x != "") & ~x.isin(TABLE_HEADS) & ~_starts_with_any(x, TABLE_HEAD_STARTS))
    marked = F.transform(lines, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, r"^(\d+)\s+(.+)$", 1).try_cast("bigint").alias("n"), F.regexp_extract(x, r"^(\d+)\s+(.+)$", 2).alias("name")))
    start = F.struct(F.array().cast(entry).alias("done"), F.lit(None).cast("bigint").alias("n"), F.lit("").alias("name"), F.lit(None).cast("string").alias("extra"))

    def closed(a: Column) -> Column:
        now = F.array(F.struct(a["n"].alias("number"), a["name"].alias("name"), a["extra"].alias("extra")))
        return F.when(a["n"].isNotNull() & a["extra"].isNotNull(), F.concat(a["done"], now)).otherwise(a["done"])

    def add(a: Column, y: Column) -> Column:
        near = F.coalesce((F.char_length(y["name"]) >= 3) & (F.abs(y["n"] - (F.size(a["done"]) + 1)) <= 2), F.lit(False))
        more = F.when(a["n"].isNotNull(), F.concat_ws(" ", a["extra"], y["x"])).otherwise(a["extra"])
        return F.when(near, F.struct(closed(a).alias("done"), y["n"].alias("n"), trimmed(y["name"]).alias("name"), F.lit(None).cast("string").alias("extra"))).otherwise(
            F.struct(a["done"].alias("done"), a["n"].alias("n"), a["name"].alias("name"), more.alias("extra")))

    return F.aggregate(marked, start, add, closed)


def table_sections(title: Column, body: Column) -> Column:
    """A section for each row of a table: substance, route and indication, or what else stands there; else the whole body."""

    def one(e: Column) -> Column:
        x, route, why = e["extra"], F.regexp_extract(e["extra"], ROUTE, 1), F.regexp_extract(e["extra"], INDICATION, 1)
        text = F.concat_ws(
            "\n", F.concat(F.lit("Hoạt chất: "), e["name"]),
            F.when(route != "", F.concat(F.lit("Đường dùng: "), route, F.lit(" "), trimmed(F.regexp_extract(x, ROUTE, 2)))),
            F.when(why != "", F.concat(F.lit("Chỉ định: "), why, F.lit(" "), trimmed(F.regexp_extract(x, INDICATION, 2)))).when(x != "", F.concat(F.lit("Thông tin: "), F.substring(x, 1, 500))))
        return _section(F.concat(title, F.lit(" - "), e["name"]), _under(title, e["name"]), text)

    found = F.filter(F.transform(table_entries(body), one), lambda s: F.char_length(s["body"]) >= 30)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(_one(title, trimmed(body))))


# ------------------------------------------------------------------ articles and publications
def article_sections(title: Column, body: Column) -> Column:
    """Sections of 100 signs or more between the major headings, without references; one behind a section below 300 signs joins it."""
    pattern = rf"(?iu)^({_alternatives(ARTICLE_HEADINGS)})\s*\d*$"

    def build(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), trimmed(F.regexp_extract(trimmed(x), pattern, 1)).alias("name"))), lambda m: m["name"] != "")
        every = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("name"))), marks)

        def cut(at: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                text = trimmed(F.array_join(_part(lines, m["at"] + 1, F.coalesce(F.get(at, k + 1)["at"], F.size(lines))), "\n"))
                return F.when(m["name"] == "", _section(title, title, text)).otherwise(_section(m["name"], _under(title, m["name"]), text))

            return F.filter(F.transform(at, one), lambda s: (F.char_length(s["body"]) >= 100) & ~F.upper(s["section_title"]).isin(DROPPED_SECTIONS))

        return let(every, cut)

    def joined(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = _section(last["section_title"], last["heading_path"], F.concat_ws("\n\n", last["body"], s["body"]))
        short = (F.size(acc) > 0) & (F.char_length(last["body"]) < 300)
        return F.when(short, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(acc, F.array(s)))

    def whole(text: Column) -> Column:
        found = F.aggregate(let(split_lines(text), build), _none(), joined)
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(_one(title, trimmed(text))))

    return let(strip_references(body), whole)


def publication_sections(title: Column, body: Column, most: int = 6000, part: int = 5000) -> Column:
    """One section up to ``most`` signs, else paragraphs in order, packed until ``part`` signs are passed."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def add(a: Column, p: Column) -> Column:
        full = a["now"].isNotNull() & (a["n"] + F.char_length(p) > part)
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), p.alias("now"), F.char_length(p).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat_ws("\n\n", a["now"], p).alias("now"), (a["n"] + F.char_length(p)).alias("n")))

    def build(text: Column) -> Column:
        parts = F.aggregate(F.split(text, "\n\n"), start, add, lambda a: F.concat(a["done"], F.array(a["now"])))

        def name(p: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                no = F.concat(F.lit("phần "), (i + 1).cast("string"))
                return _section(F.concat(title, F.lit(" ("), no, F.lit(")")), _under(title, no), trimmed(x))

            return F.when(F.size(p) == 1, _one(title, trimmed(F.get(p, F.lit(0))))).otherwise(F.transform(p, one))

        return F.when(F.char_length(text) <= most, _one(title, trimmed(text))).otherwise(let(parts, name))

    return let(strip_references(body), build)


def generic_sections(title: Column, body: Column) -> Column:
    """One section up to 8,000 signs, else as a publication."""
    return let(strip_references(body), lambda t: F.when(F.char_length(t) <= 8000, _one(title, trimmed(t))).otherwise(publication_sections(title, t)))


def mode_of(source: Column) -> Column:
    """The way in which a source's bodies are cut."""
    mode = F.lit("generic")
    for name, value in SOURCE_MODES.items():
        mode = F.when(source == name, value).otherwise(mode)
    return mode


def sectionize(title: Column, body: Column, source: Column) -> Column:
    """Sections of a body, by the kind of its source; null title and body count as empty."""
    t, b, mode = blank(title), blank(body), mode_of(source)
    return (F.when(mode == "publication", publication_sections(t, b)).when(mode == "article", article_sections(t, b)).when(mode == "procedure", procedure_sections(t, b))
            .when(mode == "table_entry", table_sections(t, b)).otherwise(generic_sections(t, b)))


# ------------------------------------------------------------------ issues
def issue_boundaries(lines: Column) -> Column:
    """(start, anchor, score, title, author) of the articles of an issue.

    From each anchor up to fifteen lines are read backwards: lines in capitals
    make the title, the topmost of them is the start; a line of names with a
    number is the author. Anchor, title and author give points; five and a
    title make a boundary, unless one found before starts within ten lines.
    """
    state = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("titles"), F.lit(-1).alias("top"), F.lit("").alias("author"))

    def back(i: Column) -> Column:
        def look(a: Column, j: Column) -> Column:
            def judge(x: Column) -> Column:
                some, is_title = F.size(a["titles"]) > 0, uppercase_title(x)
                same = lambda stop: F.struct(stop.alias("stop"), a["titles"].alias("titles"), a["top"].alias("top"), a["author"].alias("author"))
                author = (a["author"] == "") & (F.char_length(x) > 10) & ~is_title & F.regexp_extract(x, r"(?s)^(.*)\d", 1).rlike(ISSUE_NAMES)
                return (F.when((x == "") | x.rlike(ISSUE_HEADER), same(some)).when(F.contains(F.upper(x), F.lit("ABSTRACT")) | x.rlike(ISSUE_SECTION), same(F.lit(True)))
                        .when(author, F.struct(F.lit(False).alias("stop"), a["titles"].alias("titles"), a["top"].alias("top"), x.alias("author")))
                        .when(is_title, F.struct(F.lit(False).alias("stop"), F.concat(F.array(x), a["titles"]).alias("titles"), j.alias("top"), a["author"].alias("author")))
                        .otherwise(same(some)))

            return F.when(a["stop"], a).otherwise(let(trimmed(F.get(lines, j)), judge))

        behind = F.when(i > 0, F.sequence(i - 1, F.greatest(i - LOOK_BACK, F.lit(0)), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        first = F.when(F.contains(F.upper(F.regexp_extract(F.get(lines, i), ISSUE_ANCHOR, 1)), F.lit("TÓM TẮT")), 3).otherwise(1)
        return let(F.aggregate(behind, state, look), lambda a: F.struct(
            a["top"].alias("start"), i.alias("anchor"), (first + F.when(a["author"] != "", 2).otherwise(0) + F.when(a["top"] >= 0, 2).otherwise(0)).alias("score"),
            F.array_join(a["titles"], " ").alias("title"), a["author"].alias("author")))

    anchors = F.filter(_places(lines), lambda i: F.get(lines, i).rlike(ISSUE_ANCHOR))
    found = F.filter(F.transform(anchors, back), lambda b: (b["score"] >= LEAST_POINTS) & (b["start"] >= 0))

    def keep(acc: Column, b: Column) -> Column:
        # starts lie less than LOOK_BACK lines before their anchors, so only the last few can be near
        near = F.exists(F.slice(acc, F.greatest(F.size(acc) - 2 * LOOK_BACK, F.lit(1)), 2 * LOOK_BACK + 1), lambda u: F.abs(u["start"] - b["start"]) < SAME_START)
        return F.when((F.size(acc) > 0) & near, acc).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(found, F.array().cast("array<struct<start:int,anchor:int,score:int,title:string,author:string>>"), keep)


def issue_articles(body: Column) -> Column:
    """An issue's articles (article_index, start, score, title, author, n_lines, text), without the journal's header lines.

    One boundary or none makes one article of the whole body (score -1 and no
    title without one); a first boundary within fifty lines takes what stands before it.
    """

    def build(lines: Column) -> Column:
        def cut(b: Column) -> Column:
            none = F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("anchor"), F.lit(-1).alias("score"), F.lit("").alias("title"), F.lit("").alias("author")))
            marks = F.when(F.size(b) > 0, b).otherwise(none)

            def at(m: Column, k: Column) -> Column:
                return F.when((k == 0) & ((F.size(b) <= 1) | (m["start"] < 50)), 0).otherwise(m["start"])

            def one(m: Column, k: Column) -> Column:
                end = F.coalesce(F.get(b, k + 1)["start"], F.size(lines))
                return let(F.filter(_part(lines, at(m, k), end), lambda x: ~x.rlike(ISSUE_HEADER)), lambda part: F.struct(
                    (k + 1).alias("article_index"), at(m, k).alias("start"), m["score"].alias("score"), m["title"].alias("title"), m["author"].alias("author"),
                    F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("text")))

            return F.transform(marks, one)

        return let(issue_boundaries(lines), cut)

    return let(split_lines(body), build).cast(_ARTICLES)


def split_issues(issues: DataFrame, body: str = "body") -> DataFrame:
    """``issues`` without the body, a row for each article of ``issue_articles``; a null or empty body gives one article without lines."""
    names = [c for c in issues.columns if c != body]
    return issues.select(*[F.col(f"`{c}`") for c in names], F.explode(issue_articles(F.col(body))).alias("__a")).select(*[F.col(f"`{c}`") for c in names], "__a.*")
