"""Claims of an article that answer a question: candidate sentences of its chunks, scored, ranked and told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answering import FRAGMENT_MARKERS, holds, question, score_of
from .evidence import dense_table
from .ranking import keywords
from .text import blank, fold, let

# ---------------------------------------------------------------- fixed values
FRAGMENT_CUTS = [
    (r"(?id)\btitle:\s*.*?(?=\bsource:|\baudience:|\bbody:|$)", " "),
    (r"(?id)\bsource:\s*.*?(?=\baudience:|\bbody:|$)", " "),
    (r"(?id)\baudience:\s*.*?(?=\bbody:|$)", " "),
    (r"(?id)\bbody:\s*", " "),
    (r"(?id)\bkeywords?:\s*.*$", " "),
    (r"(?<!\n)\n(?!\n)", " "),
    (r"\n{2,}", "\n\n"),
    (r"\s+[o•]\s+(?=[A-ZÀ-Ỵ])", ". "),
    (r"(?iuU)\btheo dõi sau mổ:\s*", ". Theo dõi sau mổ: "),
    (r"(?iuU)\btheo doi sau mo:\s*", ". Theo dõi sau mổ: "),
    (r"(?iuU)\bđiều trị nội khoa hỗ trợ:\s*", ". Điều trị nội khoa hỗ trợ: "),
    (r"(?iuU)\bdieu tri noi khoa ho tro:\s*", ". Điều trị nội khoa hỗ trợ: "),
]
NUMERIC_ASKED = ["bao nhieu", "ty le", "phan tram", "karnofsky", "diem"]
CRITERIA_ASKED = ["chi so", "tiêu chí", "tieu chi"]
WHY_ASKED = ["vì sao", "vi sao", "tại sao", "tai sao"]
GROUP_ASKED = ["nhóm yếu tố", "nhom yeu to", "dựa trên", "dua tren"]
CRITERIA = ["lam sang", "can lam sang", "nhap vien", "tinh trang", "danh gia", "theo doi"]
METRICS = ["phan so tong mau", "ef", "bnp", "huyet ap", "thuoc"]
INTERACTIONS = ["rifampicin", "tacrolimus", "cyclosporine", "thải ghép", "thai ghep"]
REASONS = ["tương tác", "tuong tac", "nguy cơ", "nguy co", "thải ghép", "thai ghep", "độ nhạy", "do nhay", "kéo dài", "keo dai"]
SELECTION_FACTORS = ["muc do", "trieu chung", "nguy co quanh thu thuat", "song con"]
FOLLOWUP_FACTORS = [
    "noi khoa toi uu", "noi khoa ho tro", "nguy co tim mach", "theo doi hinh anh", "duplex", "kiem soat huyet ap", "dai thao duong", "roi loan lipid mau",
    "tai hep", "dot quy",
]
OTHER_FACTORS = [
    "mức độ", "muc do", "triệu chứng", "trieu chung", "nguy cơ", "nguy co", "sống còn", "song con", "nội khoa", "noi khoa", "hình ảnh", "hinh anh",
]
FOCUSED_STYLES = ["summary", "bounded_partial"]
FOCUSED_TYPES = ["teaching_explainer", "comparative_synthesis", "guideline_comparison"]
LEAST_SCORE = 2.0
# ----------------------------------------------------------------------------
CLAIMS = "array<struct<claim:string,chunk_id:string,section_title:string>>"


def _folded_sentences(text: Column) -> Column:
    """(claim, n) of the candidate sentences of a chunk and their folded forms; no sentence is folded twice."""
    t = blank(text)
    for pattern, to in FRAGMENT_CUTS:
        t = F.regexp_replace(t, pattern, to)
    parts = F.transform(F.split(t, r"(?<=[.?!])\s+|\n+"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" -\t\r\n")))
    long = F.filter(parts, lambda x: F.char_length(x) >= 30)
    return F.filter(F.transform(long, lambda x: F.struct(x.alias("claim"), fold(x).alias("n"))), lambda x: ~holds(x["n"], FRAGMENT_MARKERS))


def candidate_sentences(text: Column) -> Column:
    """Sentences of 30 signs or more of a chunk, without header labels and what they name; single line ends join lines."""
    return F.transform(_folded_sentences(text), lambda x: x["claim"])


def _candidates(chunks: Column, query: Column, numeric: Column, more) -> Column:
    """(score, place, sentence, folded, chunk_id, section) of every candidate; ``more(folded, sentence)`` is added to the score."""
    def of(c: Column, asked: Column) -> Column:
        def each(section: Column) -> Column:
            def one(x: Column) -> Column:
                score = score_of(x["claim"], asked, section["raw"], x["n"], section["folded"]) + more(x["n"], x["claim"])
                return F.struct(score.alias("score"), x["claim"].alias("claim"), x["n"].alias("n"), c["chunk_id"].alias("chunk_id"), section["raw"].alias("section_title"))

            return F.transform(_folded_sentences(c["text"]), one)

        raw = blank(c["section_title"])
        return let(F.struct(raw.alias("raw"), fold(raw).alias("folded")), each)

    every = let(question(query, numeric), lambda asked: F.flatten(F.transform(chunks, lambda c: of(c, asked))))
    found = F.filter(every, lambda x: x["score"] >= LEAST_SCORE)
    return F.transform(found, lambda x, i: F.struct(x["score"].alias("score"), i.alias("i"), x["claim"].alias("claim"), x["n"].alias("n"), x["chunk_id"].alias("chunk_id"), x["section_title"].alias("section_title")))


def _ordered(found: Column, *preferred) -> Column:
    """Best first; ``preferred`` rules, the first of them first, come before the score; equal ones in the text's order."""
    key = lambda x: [F.when(rule(x), 0).otherwise(1) for rule in preferred]
    keyed = F.transform(found, lambda x: F.struct(*[k.alias(f"k{j}") for j, k in enumerate(key(x))], (-x["score"]).alias("less"), x["i"].alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


_TAKEN = "array<struct<claim:string,n:string,chunk_id:string,section_title:string>>"


def _plain(x: Column) -> Column:
    return F.struct(x["claim"].alias("claim"), x["n"].alias("n"), x["chunk_id"].alias("chunk_id"), x["section_title"].alias("section_title"))


def _first(ordered: Column, most: int) -> Column:
    """The first ``most`` with different texts."""
    add = lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: y["n"] == x["n"]), F.concat(acc, F.array(_plain(x)))).otherwise(acc)
    return F.aggregate(ordered, F.array().cast(_TAKEN), add)


def _out(taken: Column) -> Column:
    return F.transform(taken, lambda x: F.struct(x["claim"].alias("claim"), x["chunk_id"].alias("chunk_id"), x["section_title"].alias("section_title"))).cast(CLAIMS)


def direct_answers(chunks: Column, query: Column, style: Column) -> Column:
    """The three best sentences that answer an exact question; ``chunks`` of (chunk_id, section_title, text), in order."""
    asked = (blank(style) == "exact") & ((F.size(keywords(query)) > 0) | blank(query).rlike(r"\p{Nd}"))
    numeric = holds(fold(query), NUMERIC_ASKED)
    best = let(_candidates(chunks, query, numeric, lambda n, s: F.lit(0.0)), lambda f: _first(_ordered(f), 3))
    return F.when(asked, _out(best)).otherwise(F.array().cast(CLAIMS))


def focus_claims(chunks: Column, query: Column, style: Column, query_type: Column) -> Column:
    """The four best sentences for a summary, explanation or comparison, by what the question is about.

    Questions on criteria, reasons and groups of factors raise sentences that
    speak of them and put those first; a reason or group that none of the four
    speaks of gets the best further sentence that does.
    """

    def points(q: Column):
        def more(n: Column, s: Column) -> Column:
            factors = holds(n, [*SELECTION_FACTORS, *FOLLOWUP_FACTORS])
            on = lambda rule, value: F.when(rule, value).otherwise(0.0)
            return (on(holds(q, CRITERIA_ASKED) & holds(n, CRITERIA), 1.6) + on(holds(q, CRITERIA_ASKED) & holds(n, METRICS) & ~holds(n, CRITERIA), -1.2)
                    + on(holds(q, WHY_ASKED) & holds(n, REASONS), 1.2) + on(holds(q, GROUP_ASKED) & factors, 1.8) + on(holds(q, GROUP_ASKED) & ~factors & holds(n, OTHER_FACTORS), 1.0)
                    + on(holds(q, GROUP_ASKED) & dense_table(s) & ~factors, -2.4) + on(F.contains(q, F.lit("ghep than")) & holds(n, INTERACTIONS), 4.0))

        return more

    def choose(q: Column) -> Column:
        criteria, group = holds(q, CRITERIA_ASKED), holds(q, GROUP_ASKED)
        transplant = holds(q, WHY_ASKED) & F.contains(q, F.lit("ghep than"))

        def pick(f: Column) -> Column:
            def add(acc: Column, on: Column, marks: list[str], ordered: Column) -> Column:
                need = on & ~F.exists(acc, lambda y: holds(y["n"], marks))
                next_ = F.get(F.filter(ordered, lambda x: holds(x["n"], marks) & ~F.exists(acc, lambda y: y["n"] == x["n"])), F.lit(0))
                return F.when(need & next_.isNotNull(), F.concat(acc, F.array(_plain(next_)))).otherwise(acc)

            ordered = _ordered(f, lambda x: group & holds(x["n"], [*SELECTION_FACTORS, *FOLLOWUP_FACTORS]), lambda x: transplant & holds(x["n"], INTERACTIONS),
                               lambda x: criteria & holds(x["n"], CRITERIA) & ~holds(x["n"], METRICS))
            return let(ordered, lambda o: let(_first(o, 4), lambda a: let(add(a, transplant, INTERACTIONS, o), lambda b: let(add(b, group, SELECTION_FACTORS, o), lambda c: add(c, group, FOLLOWUP_FACTORS, o)))))

        return let(_candidates(chunks, query, F.lit(False), points(q)), pick)

    asked = (blank(style).isin(FOCUSED_STYLES) | blank(query_type).isin(FOCUSED_TYPES)) & (F.size(keywords(query)) > 0)
    return F.when(asked, _out(let(fold(query), choose))).otherwise(F.array().cast(CLAIMS))
