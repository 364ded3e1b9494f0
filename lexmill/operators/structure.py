"""Documents to sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 900, 150
SECTION = "struct<level:int,title:string,body:string,heading_path:string>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def windows(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping character windows of the normalised text; the last one ends at its end."""
    if overlap >= size:
        overlap = max(0, size // 4)
    step = size - overlap

    def cut(t: Column) -> Column:
        n = F.char_length(t)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: _strip(F.substring(t, i * step + 1, F.lit(size))))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda x: x != ""))

    return T.let(T.normalize_whitespace(c), cut)


def _by_marks(c: Column, marks: Column) -> Column:
    """Sections between marked lines; ``marks``: array of struct(i, title, rest) in order, i from 0."""
    line = F.split(T.blank(c), r"\r\n|\r|\n")

    def section(m: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size(marks), F.try_element_at(marks, (k + 2).cast("int"))["i"]).otherwise(F.size(line))
        inner = F.slice(line, m["i"] + 2, F.greatest(F.lit(0), end - m["i"] - 1))
        body = F.when(m["rest"] == "", inner).otherwise(F.concat(F.array(m["rest"]), inner))
        return F.struct(F.lit(1).alias("level"), m["title"].alias("title"), _strip(F.array_join(body, "\n")).alias("body"), m["title"].alias("heading_path"))

    return F.filter(F.transform(marks, section), lambda s: s["body"] != "")


def plain_sections(c: Column) -> Column:
    """Known headings on lines of their own own the lines up to the next one."""
    marks = F.filter(F.transform(T.lines(c), lambda x, i: F.struct(i.alias("i"), T.plain_heading(x).alias("title"), F.lit("").alias("rest"))), lambda m: m["title"] != "")
    return T.let(marks, lambda m: _by_marks(c, m))


def inline_sections(c: Column) -> Column:
    """Known headings with text behind them on the same line."""

    def mark(x: Column, i: Column) -> Column:
        return T.let(T.inline_heading(x), lambda h: F.struct(i.alias("i"), h["heading"].alias("title"), h["rest"].alias("rest")))

    marks = F.filter(F.transform(T.lines(c), mark), lambda m: (m["title"] != "") & (m["rest"] != ""))
    return T.let(marks, lambda m: _by_marks(c, m))


def markdown_sections(c: Column, deepest: int = 6) -> Column:
    """``#`` headings; the path keeps as many ancestors as the level allows (by depth of the stack)."""
    line = F.split(T.blank(c), r"\n")
    head = rf"^(#{{1,{deepest}}})\s+(.+)$"
    marks = F.filter(
        F.transform(line, lambda x, i: F.struct(i.alias("i"), F.char_length(F.regexp_extract(x, head, 1)).alias("level"), F.trim(F.regexp_extract(x, head, 2)).alias("title"))),
        lambda m: m["level"] > 0)

    def build(m: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("paths"))

        def push(acc: Column, x: Column) -> Column:
            kept = F.concat(F.slice(acc["stack"], 1, F.least(F.size(acc["stack"]), x["level"] - 1)), F.array(x["title"]))
            return F.struct(kept.alias("stack"), F.concat(acc["paths"], F.array(kept)).alias("paths"))

        paths = F.aggregate(m, start, push)["paths"]

        def section(x: Column, k: Column) -> Column:
            end = F.when(k + 1 < F.size(m), F.try_element_at(m, (k + 2).cast("int"))["i"]).otherwise(F.size(line))
            body = F.array_join(F.slice(line, x["i"] + 2, F.greatest(F.lit(0), end - x["i"] - 1)), "\n")
            return F.struct(x["level"].alias("level"), x["title"].alias("title"), _strip(body).alias("body"), F.array_join(F.element_at(paths, (k + 1).cast("int")), " > ").alias("heading_path"))

        return F.transform(m, section)

    return T.let(marks, build)


def sections(c: Column) -> Column:
    """Markdown headings, else known headings on their own lines, else inline ones; an empty array without any."""
    # one look at the whole text spares most documents the work on each line
    none = F.array().cast(f"array<{SECTION}>")
    marked = F.when(T.blank(c).rlike(r"(?m)^#{1,6}\s+\S"), markdown_sections(c)).otherwise(none)
    named = T.let(plain_sections(c), lambda b: F.when(F.size(b) > 0, b).otherwise(inline_sections(c)))
    known = F.when(T.blank(c).rlike(f"(?iu){T.HEADING_WORDS}"), named).otherwise(none)
    return T.let(marked, lambda a: F.when(F.size(a) > 0, a).otherwise(known))


def chunks(df: DataFrame, body: str = "body", title: str = "title", source: str = "source_name", updated: Column | None = None,
           audience: Column | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``df`` plus ``chunk_index``, ``heading_path`` and ``chunk``; documents without text give no row.

    A section with its context header is a chunk if it fits, else its windows
    are, each with the header. Without sections the whole body is windowed.
    """
    none = F.lit(None).cast("string")
    updated, audience = none if updated is None else updated, none if audience is None else audience

    def of(s: Column) -> Column:
        head = T.context_header(F.col(title), s["title"], F.col(source), updated, audience)
        parts = F.when(F.char_length(head) + F.char_length(s["body"]) <= size, F.array(s["body"])).otherwise(windows(s["body"], size, overlap))
        return F.transform(parts, lambda p: F.struct(s["heading_path"].alias("heading_path"), F.concat(head, p).alias("chunk")))

    whole = T.context_header(F.col(title), none, F.col(source), updated, audience)
    flat = F.transform(windows(F.col(body), size, overlap), lambda p: F.struct(F.lit("").alias("heading_path"), F.concat(whole, p).alias("chunk")))
    at = df.withColumn("__s", F.filter(sections(F.col(body)), lambda s: s["body"] != ""))
    made = F.when(F.size("__s") > 0, F.flatten(F.transform("__s", of))).otherwise(flat)
    return at.select(*[F.col(f"`{c}`") for c in df.columns], F.posexplode(made).alias("chunk_index", "__c")).select(
        *[F.col(f"`{c}`") for c in df.columns], "chunk_index", "__c.heading_path", "__c.chunk")


def merge_short(sections_: Column, least: int = 300) -> Column:
    """A section is merged into the one before while that one's body is short."""
    kind = F.array().cast(f"array<{SECTION}>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["level"].alias("level"), last["title"].alias("title"), F.concat_ws("\n\n", last["body"], s["body"]).alias("body"), last["heading_path"].alias("heading_path"))
        rest = F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))
        return F.when((F.size(acc) > 0) & (F.char_length(last["body"]) < least), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sections_, kind, add)


def pack(parts: Column, most: int, sep: str = "\n\n") -> Column:
    """Parts in order, packed greedily into texts of up to ``most`` signs; a longer part stays whole."""

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.char_length(last) + len(sep) + F.char_length(p) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.concat_ws(sep, last, p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def dedupe_blocks(blocks: Column, contained: int = 30, words: int = 4) -> Column:
    """Blocks in order without equal ones and without longer ones that an earlier block holds."""

    def add(acc: Column, b: Column) -> Column:
        t = F.lower(T.squeeze(b))
        known = F.exists(acc, lambda x: (F.lower(T.squeeze(x)) == t) | (
            (F.char_length(t) >= contained) & (F.size(F.split(t, " ")) >= words) & F.contains(F.lower(T.squeeze(x)), t)) | (
            (F.char_length(t) >= 120) & F.contains(t, F.lower(T.squeeze(x)))))
        return F.when((t == "") | known, acc).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(blocks, F.array().cast("array<string>"), add)
