"""Cleaning of text taken from PDF: composed letters, noise lines, lines that were broken within a sentence; and titles that need cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let

# ---------------------------------------------------------------- fixed values
#: What a line ends with, and what counts as white space.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOISE_LINES = [
    r"^[a-zA-Z0-9_.]+_[A-Za-zÀ-ỹ\s]+_\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}$",
    r"^\s*\d{1,5}\s*$",
    r"(?i)^TẠP CHÍ Y\s*.{0,60}(SỐ|TẬP|THÁNG).*$",
    r"(?i)^HUE JOURNAL OF MEDICINE AND PHARMACY\s+ISSN.*$",
    r"(?i)^VIETNAM MEDICAL JOURNAL.*$",
    r"(?i)^BÀI NGHIÊN CỨU\s*$",
    r"^(CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM|Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc)\s*$",
]
HEADING_LINES = [
    r"(I{1,3}V?|VI{0,3}|IX|X)\.\s+.+",
    r"\d+\.\s+[A-ZÀ-Ỹ].{5,}",
    r"TÓM TẮT|ABSTRACT|SUMMARY",
    r"ĐẶT VẤN ĐỀ|GIỚI THIỆU|MỞ ĐẦU",
    r"ĐỐI TƯỢNG VÀ PHƯƠNG PHÁP.*",
    r"KẾT QUẢ.*|BÀN LUẬN|KẾT LUẬN|KIẾN NGHỊ",
    r"TÀI LIỆU THAM KHẢO",
    r"LỜI NÓI ĐẦU|MỤC LỤC|DANH MỤC.*",
    r"ĐẠI CƯƠNG|CHỈ ĐỊNH|CHỐNG CHỈ ĐỊNH|CHUẨN BỊ",
    r"CÁC BƯỚC TIẾN HÀNH|THEO DÕI|TAI BIẾN",
    r"Chương\s+\d+",
]
#: A line of such signs alone, the first a letter, of sixteen or more is a heading, too; case doesn't count.
LETTERS, LETTER_LINE, LEAST_LETTERS = "[A-ZÀ-Ỹ]", r"[A-ZÀ-Ỹ\s,()]*", 16
SENTENCE_ENDS = ".?!;:。）)"
BAD_TITLES = ["skip to main content", "pdf", "document", "xem chi tiết", "xem chi tiet", "trang ch tin tc gii thiu"]
TITLE_FILENAME = r"^[A-Za-z0-9][A-Za-z0-9_.-]{8,}$"
TITLE_SLUG = r"^[a-z0-9]+(?:[-_][a-z0-9]+){2,}$"
TITLE_HEX = r"(?i)^[0-9a-f]{24,}$"
DATE_LINE = r"^\d{1,2}/\d{1,2}/\d{4}(?:\s+\d{1,2}:\d{2}:\d{2})?$"
CONTENTS_DOTS = r"\.{6,}\s*\d+\s*$"
CONTENTS_NUMBERED = r"(?i)^\s*(\d+|[IVXLC]+)\s+.+\s+\d+\s*$"
# ----------------------------------------------------------------------------

#: Combining marks with a class; the grapheme joiner U+034F has none.
_MARKS = r"[\u0300-\u034e\u0350-\u036f]"


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, int]]:
    """Canonical decompositions to a sign and such marks, compositions of two signs, and the marks' classes, from the Unicode data."""
    order = {chr(n): unicodedata.combining(chr(n)) for n in range(0x300, 0x370) if unicodedata.combining(chr(n))}
    apart, together = {}, {}
    for c in map(chr, [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]):
        d = unicodedata.normalize("NFD", c)
        if d != c and all(x in order for x in d[1:]):
            apart[c] = d
            two = unicodedata.decomposition(c).split()
            if len(two) == 2 and unicodedata.normalize("NFC", c) == c:
                together["".join(chr(int(x, 16)) for x in two)] = c
    return apart, together, order


#: Parts of a table; a look into a map reads its keys one by one.
_PARTS = 128


@cache
def _packed(which: int) -> list[str]:
    """A table's parts by the key's first sign, each as one text: entries between U+0001, key and value between U+0002."""
    out: list[list[str]] = [[] for _ in range(_PARTS)]
    for k, v in _tables()[which].items():
        out[ord(k[0]) % _PARTS].append(f"{k}\x02{v}")
    return ["\x01".join(x) for x in out]


def _lookup(which: int, key: Column) -> Column:
    """A key's value, null without one; the maps are a constant that the optimizer folds."""
    maps = F.array(*[F.str_to_map(F.lit(x), F.lit("\x01"), F.lit("\x02")) for x in _packed(which)])
    return F.try_element_at(F.get(maps, F.ascii(key) % _PARTS), key)


def nfc(c: Column) -> Column:
    """Canonical composition (NFC) of Latin, Greek and Cyrillic letters; texts without a combining mark come back as they are.

    Runs of a sign and its marks of U+0300 to U+036F are taken apart, the marks
    sorted by class and composed pair by pair. Other scripts' marks, and signs
    that stand for another one alone (as U+212B), aren't touched.
    """
    signs = lambda s: F.filter(F.split(s, ""), lambda x: x != "")

    def run(s: Column) -> Column:
        parted = F.flatten(F.transform(signs(s), lambda x: signs(F.coalesce(_lookup(0, x), x))))
        marked = F.transform(parted, lambda x, i: F.struct(F.coalesce(_lookup(2, x).cast("int"), F.lit(0)).alias("k"), i.alias("i"), x.alias("x")))
        # the run begins with its one starter; its marks follow by class, then by place
        placed = F.array_sort(marked)
        start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

        def add(a: Column, m: Column) -> Column:
            both = _lookup(1, F.concat(a["base"], m["x"]))
            free = (a["rest"] == "") | (a["last"] < m["k"])  # no mark of this class stands between
            return (F.when(a["base"] == "", F.struct(m["x"].alias("base"), a["rest"].alias("rest"), m["k"].alias("last")))
                    .when(free & both.isNotNull(), F.struct(both.alias("base"), a["rest"].alias("rest"), a["last"].alias("last")))
                    .otherwise(F.struct(a["base"].alias("base"), F.concat(a["rest"], m["x"]).alias("rest"), m["k"].alias("last"))))

        return F.aggregate(placed, start, add, lambda a: F.concat(a["base"], a["rest"]))

    t = blank(c)
    pieces = F.regexp_extract_all(t, F.lit(rf"(?s)((?:(?!{_MARKS}).(?!{_MARKS}))+|(?:(?!{_MARKS}).)?{_MARKS}+)"), 1)
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"{_MARKS}$"), run(p)).otherwise(p)), "")
    return F.when(t.rlike(_MARKS), whole).otherwise(t)


def trimmed(c: Column) -> Column:
    """A text without white space of any kind at its ends, in linear time."""
    return F.trim(blank(c), F.lit(SPACES))


def split_lines(c: Column) -> Column:
    """The lines of a text; one that ends with a line end has no empty line behind it, an empty text no line."""
    return let(F.split(blank(c), LINE_ENDS), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


_FLAGS = "(?iuU)"


def _known_heading(c: Column) -> Column:
    return c.rlike(f"{_FLAGS}^(?:" + "|".join(HEADING_LINES) + ")$")


def _letters_only(c: Column) -> Column:
    return c.rlike(f"{_FLAGS}^{LETTER_LINE}$")


def heading_line(c: Column) -> Column:
    """Whether a line reads like a heading."""
    return _known_heading(c) | ((F.char_length(c) >= LEAST_LETTERS) & c.rlike(f"{_FLAGS}^{LETTERS}") & _letters_only(c))


def noise_line(c: Column) -> Column:
    """Whether a line is a signature, a page number, or the header of a journal or an office."""
    hit = F.lit(False)
    for p in NOISE_LINES:
        hit = hit | c.rlike("(?uU)" + p)
    return hit


def _at(items: Column, i: Column) -> Column:
    return F.get(items, i)


def _islands(items: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """``items`` cut before each item at which ``starts(items, place)`` holds: array of arrays."""

    def cut(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(items))
        return F.transform(at, lambda a, k: F.slice(items, a + 1, end(k) - a))

    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.filter(places, lambda i: (i == 0) | starts(items, i)), cut)


def merged_lines(lines: Column) -> Column:
    """Trimmed lines with those joined that were broken within a sentence.

    A line is joined to what the lines before it have already become, unless
    either is a heading, that one is empty or ends a sentence, or the line has
    five signs or fewer. Only what has become of the lines can't be told from
    single ones: places where lines surely part cut the text into islands, and
    the fold runs within each, so its work grows with islands, not texts.
    """
    marked = F.transform(lines, lambda x: F.struct(x.alias("x"), heading_line(x).alias("h"), _letters_only(x).alias("p")))

    def parts(a: Column, i: Column) -> Column:
        x, before = _at(a, i), _at(a, i - 1)
        return (x["x"] == "") | x["h"] | (F.char_length(x["x"]) <= 5) | (before["x"] == "") | before["h"] | F.contains(F.lit(SENTENCE_ENDS), F.right(before["x"], F.lit(1)))

    def fold(island: Column) -> Column:
        first = _at(island, F.lit(0))
        start = F.struct(F.lit("").alias("done"), first["x"].alias("last"), first["p"].alias("plain"))
        # whether a joined line is made of letters alone is known from its parts, so it isn't read again at each step
        heading = lambda a: _known_heading(a["last"]) | (a["plain"] & (F.char_length(a["last"]) >= LEAST_LETTERS) & a["last"].rlike(f"{_FLAGS}^{LETTERS}"))

        def add(acc: Column, y: Column) -> Column:
            return F.when(heading(acc), F.struct(F.concat(acc["done"], acc["last"], F.lit("\n")).alias("done"), y["x"].alias("last"), y["p"].alias("plain"))).otherwise(
                F.struct(acc["done"].alias("done"), F.concat(acc["last"], F.lit(" "), y["x"]).alias("last"), (acc["plain"] & y["p"]).alias("plain")))

        folded = F.aggregate(F.slice(island, 2, F.greatest(F.size(island) - 1, F.lit(0))), start, add, lambda a: F.concat(a["done"], a["last"]))
        return F.when(F.size(island) == 1, first["x"]).otherwise(folded)

    return let(marked, lambda m: F.transform(_islands(m, parts), fold))


def clean_text(c: Column) -> Column:
    """A composed text without noise lines, its broken lines joined, one empty line at most between others."""
    kept = F.filter(F.transform(split_lines(nfc(c)), trimmed), lambda x: ~noise_line(x))
    few = lambda m: F.filter(m, lambda x, i: (x != "") | (i == 0) | (_at(m, i - 1) != ""))
    return trimmed(F.array_join(let(let(kept, merged_lines), few), "\n"))


# ------------------------------------------------------------------ titles
def marker_text(c: Column) -> Column:
    """A cleaned text in lower case with single blanks."""
    return trimmed(F.regexp_replace(F.lower(clean_text(c)), r"(?U)\s+", " "))


def title_candidate(c: Column) -> Column:
    """A cleaned title on one line without dashes at its ends."""
    return F.trim(F.regexp_replace(clean_text(c), r"(?U)\s+", " "), F.lit(" -–—"))


def needs_cleanup(c: Column) -> Column:
    """A title that is short, generic, or a file name, slug or number."""

    def judge(t: Column) -> Column:
        low = trimmed(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))
        return (F.char_length(t) < 10) | low.isin(BAD_TITLES) | t.rlike(TITLE_HEX) | low.rlike(TITLE_SLUG) | (t.rlike(TITLE_FILENAME) & ~F.contains(t, F.lit(" ")))

    return let(clean_text(c), judge)


def body_heading(body: Column) -> Column:
    """The first of a cleaned body's 40 first lines that may be its title; empty without one."""

    def good(t: Column) -> Column:
        low = F.lower(t)
        return (F.char_length(t).between(10, 180) & ~low.isin(BAD_TITLES) & ~t.rlike(DATE_LINE) & ~t.rlike(CONTENTS_DOTS) & ~t.rlike(CONTENTS_NUMBERED) & ~(t.rlike(TITLE_FILENAME) & ~F.contains(t, F.lit(" "))))

    return F.coalesce(F.get(F.filter(F.transform(F.slice(split_lines(body), 1, 40), title_candidate), good), F.lit(0)), F.lit(""))


def hex_tail(c: Column) -> Column:
    """The 24 or more hexadecimal digits that a text ends with, in lower case; empty without."""
    return F.lower(F.regexp_extract(blank(c), r"(?i)([0-9a-f]{24,})$", 1))
