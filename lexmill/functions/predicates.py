"""Record and chunk predicates, and the lists of reasons built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, full_lines, let, lines, normalize_heading, reference_line_ratio, squeeze

# ---------------------------------------------------------------- fixed values
DOC_TYPES = ["guideline", "textbook", "faq", "patient_education", "review", "reference", "research_article", "journal_article",
             "original_research", "case_report", "meta_analysis"]
AUDIENCES = ["patient", "student", "clinician"]
TRUST_TIERS = [1, 2, 3]
HTML_REMNANTS = r"(?i)<(div|span|table|tr|td|ul|ol|li|nav|footer|header|script|style)\b"
HTML_ATTRIBUTES = r"(class|id)=['\"]"
DATE = r"^([0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$"
NAVIGATION = [
    r"skip to (main )?content", r"cookie (policy|consent|settings)", r"privacy policy", r"terms of (use|service)", r"back to top",
    r"share (on|this|via)", r"(facebook|twitter|linkedin|youtube)", r"subscribe to", r"sign up for", r"©\s*[0-9]{4}",
]
QUALITY_RANK = {"hold": 0, "review": 1, "go": 2}
CITATION_LINE = r"[0-9]{4}\s*;\s*[0-9]+\s*(?:\([0-9]+\))?\s*:\s*(?:e?[0-9]+|[A-Z][0-9]+)"
BIBLIO_DENSE = r"[0-9]{4}\s*;\s*[0-9]+\s*(?:\([0-9]+\))?\s*:\s*[0-9]+"
DOI = r"10\.[0-9]{4,}/"
REFERENCE_MARK = r"(?i)(?:^|\n)\s*(?:tài\s*liệu\s*tham\s*khảo|references|bibliography|danh\s*mục\s*tài\s*liệu)\s*(?:$|:|\n)"
JOURNAL_REF = (
    r"(?i)(?:J\s+\w+\s+\w+|Lancet|JAMA|BMJ|N\s+Engl\s+J\s+Med|Ann\s+\w+|Clin\s+\w+|Am\s+J|Eur\s+J|PLoS\s+\w+|Cochrane|Gastroenterology"
    r"|Hepatology|Circulation|Chest)\s*[.,;]?\s*[0-9]{4}"
)
PUNCTUATION = r"""[.,;:()\[\]{}!?/\-–—"']"""
# ----------------------------------------------------------------------------


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in order."""
    found = F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs])
    return F.filter(found, lambda x: x.isNotNull())


def missing(c: Column) -> Column:
    return F.trim(blank(c)) == ""


def record_errors(doc_id: Column, title: Column, body: Column, source: Column, doc_type: Column, audience: Column, tier: Column) -> Column:
    """what keeps a record from being valid; an empty array for a valid one."""
    outside = lambda c, values: ~F.coalesce(c.isin(values), F.lit(False))
    return reasons(
        (missing(doc_id), "doc_id is required"), (missing(title), "title is required"), (missing(body), "body is required"),
        (missing(source), "source_name is required"),
        (outside(doc_type, DOC_TYPES), F.concat(F.lit("doc_type '"), blank(doc_type), F.lit("' is unknown"))),
        (outside(audience, AUDIENCES), F.concat(F.lit("audience '"), blank(audience), F.lit("' is unknown"))),
        (outside(tier, TRUST_TIERS), "trust_tier must be one of [1, 2, 3]"),
    )


def valid_url(c: Column) -> Column:
    """empty, or http(s) with a host."""
    return (blank(c) == "") | c.rlike(r"(?i)^https?://[^/?#]+")


def html_remnants(c: Column) -> Column:
    """tags or attributes are left in a text."""
    return blank(c).rlike(HTML_REMNANTS) | blank(c).rlike(HTML_ATTRIBUTES)


def valid_date(c: Column) -> Column:
    """empty, a year, year-month, ISO date or month/day/year."""
    return (blank(c) == "") | F.trim(c).rlike(DATE)


def navigation_text(c: Column) -> Column:
    """two or more menu phrases in the first 300 signs."""
    t = F.lower(F.substring(blank(c), 1, 300))
    return let(t, lambda x: sum((x.rlike(p).cast("int") for p in NAVIGATION[1:]), x.rlike(NAVIGATION[0]).cast("int")) >= 2)


def mixed_topics(title: Column, body: Column) -> Column:
    """less than 15 % of the title's long words are in the first 500 signs of the body."""
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}_]{4,})"), 1))
    mine = long(blank(title))
    return (F.size(mine) > 0) & (F.size(F.array_intersect(mine, long(F.substring(blank(body), 1, 500)))) / F.size(mine) < 0.15)


def truncated_list(c: Column) -> Column:
    """the last line is a list item without a closing sign."""
    last = F.trim(F.element_at(F.split(F.regexp_replace(blank(c), r"^\s+|\s+$", ""), "\n"), -1))
    return last.rlike(r"^[-*0-9.]+\s") & ~last.rlike(r"[.):]$")


def truncated_table(c: Column) -> Column:
    """the last of two or more lines with bars doesn't end in one."""
    bars = F.filter(F.split(blank(c), "\n"), lambda x: F.contains(x, F.lit("|")))
    return F.coalesce((F.size(bars) >= 2) & ~F.trim(F.try_element_at(bars, F.lit(-1))).endswith("|"), F.lit(False))


def list_items(c: Column) -> Column:
    """two or more bulleted or numbered lines."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"^\s*([-*•]|[0-9]+[.)])\s"))) >= 2


def passes_gate(status: Column, least: str = "hold") -> Column:
    """a quality status is at least ``least``; unknown ones count as hold."""
    rank = F.when(F.lower(status) == "go", 2).when(F.lower(status) == "review", 1).otherwise(0)
    return rank >= QUALITY_RANK.get((least or "hold").lower(), 0)


def noise_chunk(section_type: Column, text: Column) -> Column:
    """a chunk of references."""
    return (section_type == "references") | (reference_line_ratio(text) >= 0.7)


def junk_chunk(c: Column) -> Column:
    """a chunk that is clearly no content."""

    def judge(t: Column) -> Column:
        n = F.char_length(t)
        cites = F.regexp_count(t, F.lit(BIBLIO_DENSE))
        head = F.regexp_instr(t, F.lit(REFERENCE_MARK)) - 1
        punct = n - F.char_length(F.regexp_replace(t, PUNCTUATION, ""))
        return (
            (n == 0) | ((n < 30) & ~F.contains(t, F.lit("."))) | ((head >= 0) & ((head < 50) | (n < 200))) | ((cites >= 3) & (n < 500))
            | (F.regexp_count(t, F.lit(DOI)) >= 2) | ((F.regexp_count(t, F.lit(JOURNAL_REF)) >= 2) & (cites >= 2)) | ((n > 10) & (punct / n > 0.40))
        )

    return let(F.regexp_replace(blank(c), r"^\s+|\s+$", ""), judge)


def weak_title(c: Column) -> Column:
    """Missing, short, or a fragment that starts in lower case."""
    t = F.trim(blank(c))
    return (F.char_length(t) < 15) | t.rlike(r"^\p{Ll}")


def embed_reasons(title: Column, body: Column, url: Column, status: Column, flags: Column, drop_flags: list[str], min_body: int = 120) -> Column:
    """why a record isn't embedded; an empty array if it is."""
    t, b = F.trim(blank(title)), F.regexp_replace(blank(body), r"^\s+|\s+$", "")
    base = reasons(
        (t == "", "missing_title"), ((t != "") & F.lower(squeeze(t)).isin("pdf", "document", "untitled", "unknown"), "bad_title"),
        (t.rlike(r"(?i)^[0-9a-f]{16,}$"), "hex_like_title"), (b == "", "missing_body"),
        ((b != "") & (F.char_length(b) < min_body), "body_too_short"), (missing(url), "missing_source_url"), (F.lower(F.trim(blank(status))) == "hold", "quality_hold"),
    )
    bad = F.sort_array(F.array_intersect(F.array_distinct(F.transform(flags, lambda x: F.trim(x))), F.array(*[F.lit(f) for f in drop_flags])))
    return F.concat(base, F.transform(bad, lambda x: F.concat(F.lit("flag:"), x)))


def bad_title(c: Column) -> Column:
    h = F.lower(normalize_heading(c))
    return (h == "") | h.isin("pdf", "document", "untitled")


def short_line_share(c: Column) -> Column:
    return F.size(F.filter(full_lines(c), lambda x: F.char_length(x) < 5)) / F.greatest(F.lit(1), F.size(lines(c)))
