"""Quality, similarity and evaluation scores as Column expressions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from . import sequences
from .predicates import BIBLIO_DENSE, CITATION_LINE, DOI, PUNCTUATION, bad_title, reasons
from .text import blank, content_tokens, let, negative_cue, normalize_eval, normalize_heading, numbers, reference_line_ratio, sentence_chunks, table_line_ratio

# ---------------------------------------------------------------- fixed values
GO, REVIEW = 85, 70
TITLE_REFERENCE = r"(?i)^[0-9]+\.\s+.*(?:doi:\s*10\.|\([0-9]{4}\)|et al\.?|pp?\.\s*[0-9]+)|Pan Afr Med J|N Engl J Med|BMJ|Lancet|Cochrane Database|PMID:"
TITLE_TABLE = r"(?iu)^(TT|STT)\b|^Tên hoạt chất\b|^Tên thuốc\b|^Hàm lượng\b|^Đơn vị\b|^Số lượng\b"
DOMAIN_TERMS = [
    "bệnh", "điều trị", "chẩn đoán", "triệu chứng", "phẫu thuật", "lâm sàng", "xét nghiệm", "thuốc", "liều", "viêm", "nhiễm",
    "ung thư", "tim", "thận", "gan", "phổi", "máu", "tế bào", "miễn dịch", "kháng sinh", "enzyme", "protein", "gen",
    "tỷ lệ", "nghiên cứu", "bệnh nhân", "kết quả", "phương pháp", "patient", "treatment", "diagnosis", "clinical", "study",
    "disease", "infection", "cancer", "therapy", "outcome",
]
# ----------------------------------------------------------------------------

_TOKEN, _PIECE = re.compile(r"[\w%.,/-]+"), re.compile(r"[\n\r]+|(?<=[.!?])\s+")


def status_of(score: Column) -> Column:
    return F.when(score >= GO, "go").when(score >= REVIEW, "review").otherwise("hold")


def _minus(*rules: tuple[Column, float]) -> Column:
    return sum((F.when(c, v).otherwise(0) for c, v in rules[1:]), F.when(rules[0][0], rules[0][1]).otherwise(0))


def ingest_quality(title: Column, body: Column, url: Column, source: Column, language: Column, doc_type: Column, sections: Column, sectionized: Column) -> Column:
    """struct(score, status, flags): 100 less penalties."""
    size = F.char_length(F.regexp_replace(blank(body), r"^\s+|\s+$", ""))
    seen = F.struct(bad_title(title).alias("bad"), size.alias("size"), reference_line_ratio(body).alias("ref"), table_line_ratio(body).alias("tab"))
    return let(seen, lambda x: _ingest_rules(title, url, source, language, doc_type, sections, sectionized, x["bad"], x["size"], x["ref"], x["tab"]))


def _ingest_rules(title, url, source, language, doc_type, sections, sectionized, bad, size, ref, tab) -> Column:
    rules = [
        (bad, 45, "title_missing_or_bad"), (~bad & (F.char_length(normalize_heading(title)) < 20), 10, "title_too_short"),
        (~bad & title.rlike(TITLE_REFERENCE), 30, "title_looks_like_reference"), (~bad & title.rlike(TITLE_TABLE), 30, "title_looks_like_table_header"),
        (size < 200, 45, "body_very_short"), ((size >= 200) & (size < 500), 20, "body_too_short"),
        (ref >= 0.55, 40, "reference_heavy_body"), ((ref >= 0.25) & (ref < 0.55), 20, "reference_noise_detected"), (tab >= 0.65, 20, "table_heavy_body"),
        (F.trim(blank(url)) == "", 10, "missing_source_url"), (F.trim(blank(source)) == "", 10, "missing_source_name"),
        (F.trim(blank(language)) == "", 5, "missing_language"), (blank(doc_type) == "", 5, "missing_doc_type"),
        ((sections == 0) & ~sectionized, 10, "no_sections_detected"), ((sections == 1) & (size > 4000) & ~sectionized, 10, "single_large_section"),
    ]
    score = F.greatest(F.lit(0), F.lit(100) - _minus(*[(c, v) for c, v, _ in rules])).cast("int")
    return F.struct(score.alias("score"), status_of(score).alias("status"), F.sort_array(reasons(*[(c, t) for c, _, t in rules])).alias("flags"))


def merge_quality(old_status: Column, old_score: Column, old_flags: Column, new: Column) -> Column:
    """The worse status, the lower score and all flags of a prior and a computed verdict."""
    rank = lambda s: F.when(s == "go", 2).when(s == "review", 1).when(s == "hold", 0)
    low = F.lower(blank(old_status))
    worse = F.when(rank(low).isNotNull() & (rank(low) <= rank(new["status"])), low).otherwise(new["status"])
    return F.struct(
        F.least(new["score"], old_score.cast("int")).alias("score"), worse.alias("status"),
        F.sort_array(F.array_union(F.coalesce(old_flags, F.array().cast("array<string>")), new["flags"])).alias("flags"))


def etl_quality(title: Column, body: Column, fields: list[Column], sections: Column, short_sections: Column, tier: Column, confidence: Column, mixed: Column) -> Column:
    """struct(score, status): title 25, metadata 20, body 20, sections 15, trust 10, language 10."""
    none = F.lower(F.trim(blank(title))).isin("pdf", "document", "untitled", "")
    n = F.char_length(blank(body))
    t = F.when(none, 0).otherwise(F.greatest(F.lit(0), 25 - _minus(
        (F.char_length(title) < 20, 10), (title.rlike(r"(?i)^[A-Za-z0-9_\-]+\.(pdf|txt|docx?)$"), 5), ((title == F.upper(title)) & (F.char_length(title) > 100), 5),
        (title.rlike(TITLE_REFERENCE), 20), (title.rlike(r"^(TT|STT)\s|,\s*$"), 20))))
    m = F.greatest(F.lit(0), 20 - 3 * sum(((F.coalesce(f.cast("string"), F.lit("")).isin("", "0")).cast("int") for f in fields), F.lit(0)))
    short = F.size(F.filter(F.split(blank(body), "\n"), lambda x: (F.trim(x) != "") & (F.char_length(F.trim(x)) < 5)))
    b = 20 - F.when(n < 500, 10).otherwise(0) - F.when((n > 0) & (short / F.size(F.split(blank(body), "\n")) > 0.3), 5).otherwise(0)
    s = F.greatest(F.lit(0), F.when(sections == 0, 0).when((sections == 1) | (sections > 20), 10).otherwise(15)
                   - F.when((sections > 5) & (n > 0) & (n / sections < 150), 10).otherwise(0) - F.when(short_sections > 0.4, 10).otherwise(0))
    trust = F.when(tier == 1, 10).when(tier == 2, 7).otherwise(4)
    lang = F.bround(confidence * 10)
    lang = F.when(mixed, F.greatest(F.lit(0), lang - 3)).otherwise(lang)
    total = (t + m + b + s + trust + F.least(F.lit(10), F.greatest(F.lit(0), lang))).cast("int")
    return F.struct(total.alias("score"), status_of(total).alias("status"))


def chunk_quality(c: Column) -> Column:
    """0 to 1, less for digits, punctuation, citations and little content."""

    def rate(t: Column) -> Column:
        n = F.char_length(t)
        share = lambda p: (n - F.char_length(F.regexp_replace(t, p, ""))) / n
        words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
        terms = F.array(*[F.lit(w) for w in DOMAIN_TERMS])

        def settle(w: Column) -> Column:
            digits, punct = share(r"\p{Nd}"), share(PUNCTUATION)
            cites, dois = F.regexp_count(t, F.lit(CITATION_LINE)), F.regexp_count(t, F.lit(DOI))
            hits = F.size(F.array_intersect(F.array_distinct(w), terms))
            score = (
                F.lit(1.0) - F.when((n > 20) & (digits > 0.35), 0.20).when((n > 20) & (digits > 0.25), 0.10).otherwise(0.0)
                - F.when((n > 20) & (punct > 0.30), 0.15).when((n > 20) & (punct > 0.20), 0.05).otherwise(0.0)
                - 0.10 * F.least(cites, F.lit(3)) - 0.10 * F.least(dois, F.lit(2))
                - F.when((F.size(w) > 5) & (F.size(F.array_distinct(w)) / F.size(w) < 0.3), 0.10).otherwise(0.0)
                - F.when(~F.contains(t, F.lit(".")) & (n > 50), 0.10).otherwise(0.0) - F.when(n < 80, 0.10).otherwise(0.0)
                + F.when(hits >= 3, 0.05).when((hits == 0) & (F.size(w) > 10), -0.10).otherwise(0.0)
            )
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

        return F.when(n == 0, 0.0).otherwise(let(words, settle))

    return let(F.regexp_replace(blank(c), r"^\s+|\s+$", ""), rate)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; there is no JVM-side form."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def _best(pieces: list[str], reference: str) -> float:
    """The greatest T25 of a piece with the reference; what lengths or counts of signs keep below the best so far isn't aligned."""
    m, best = SequenceMatcher(None, "", reference), 0.0
    bound = lambda p: 2.0 * min(len(p), len(reference)) / (len(p) + len(reference))
    for p in sorted(set(pieces), key=bound, reverse=True):
        if bound(p) <= best:
            break
        m.set_seq1(p)
        if m.quick_ratio() > best:
            best = max(best, m.ratio())
    return best


def _best_each(pieces: list, references: list, floors: list) -> list[float]:
    """The greatest T25 of each row's pieces with its reference, its floor if none is greater; no reference or pieces: the floor.

    Rows go together through bit sets; references and pieces that are too long for these go through ``_best``.
    """
    out = [float(z) for z in floors]
    rows = [i for i, (ps, r) in enumerate(zip(pieces, references, strict=True)) if r and ps is not None and len(ps)]
    for i in rows:
        slow = [p for p in pieces[i] if len(references[i]) > sequences.MOST or len(p) > sequences.LONGEST]
        if slow:
            out[i] = max(out[i], _best(slow, references[i]))
    rows = [i for i in rows if len(references[i]) <= sequences.MOST]
    found = sequences.best_ratios([[p for p in pieces[i] if 0 < len(p) <= sequences.LONGEST] for i in rows], [references[i] for i in rows], [out[i] for i in rows])
    for i, x in zip(rows, found.tolist(), strict=True):
        out[i] = x
    return out


@pandas_udf(DoubleType())
def best_sentence_ratio(pieces: pd.Series, reference: pd.Series, floor: pd.Series) -> pd.Series:
    """Greatest T25 of any piece with the reference, ``floor`` at least."""
    return pd.Series(_best_each(list(pieces), list(reference), list(floor)), dtype=float)


@pandas_udf(DoubleType())
def sequence_ratio_above(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """T25 where it is greater than ``least``, else 0."""

    def one(x: str, y: str, z: float) -> float:
        if not x or not y or 2.0 * min(len(x), len(y)) / (len(x) + len(y)) <= z:
            return 0.0
        m = SequenceMatcher(None, x, y)
        return r if m.quick_ratio() > z and (r := m.ratio()) > z else 0.0

    return pd.Series([one(*r) for r in zip(a, b, least, strict=True)])


def best_sentence_similarity(answer: Column, reference: Column, floor: Column | None = None, asked: Column | None = None) -> Column:
    """C16, ``floor`` at least; rows that aren't ``asked`` for get the floor."""
    pieces = F.filter(F.transform(sentence_chunks(answer), lambda p: normalize_eval(p)), lambda p: p != "")
    return best_sentence_ratio(pieces if asked is None else F.when(asked, pieces), normalize_eval(reference), F.lit(0.0) if floor is None else floor)


def token_coverage(answer: Column, concept: Column) -> Column:
    """Share of the concept's content tokens that the answer has."""
    mine = content_tokens(concept)
    return F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, content_tokens(answer))) / F.size(mine))


def number_match(answer: Column, concept: Column) -> Column:
    mine = numbers(concept)
    return F.when(F.size(mine) == 0, 0.0).otherwise(let(numbers(answer), lambda have: F.size(F.filter(mine, lambda x: F.array_contains(have, x)))) / F.size(mine))


def concept_overlap(answer: Column, concept: Column) -> Column:
    """1 if contained, else by numbers, tokens and sequence similarity."""
    a, k = normalize_eval(answer), normalize_eval(concept)
    cover, nums, figures = token_coverage(answer, concept), number_match(answer, concept), F.size(numbers(concept)) > 0
    # without figures a best below the coverage doesn't matter, and best is the coverage at least
    best = best_sentence_similarity(answer, concept, F.when(figures, 0.0).otherwise(cover), (k != "") & ~F.contains(a, k))
    least = best / 0.9 - 1e-9
    near = F.when(~figures & (2.0 * F.least(F.char_length(a), F.char_length(k)) > least * (F.char_length(a) + F.char_length(k))), a)  # no long text travels in vain
    return (
        F.when((a == "") | (k == ""), 0.0).when(F.contains(a, k), 1.0)
        .when(figures, F.greatest(nums, 0.55 * nums + 0.25 * cover + 0.20 * best))
        .otherwise(F.greatest(best, sequence_ratio_above(near, k, least) * 0.9))
    )


def length_score(words: Column, least: Column) -> Column:
    """C20: words over the least number, from 0 to 1."""
    return F.when(least <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), words / least)))


def citations(c: Column) -> Column:
    return F.regexp_count(blank(c), F.lit(BIBLIO_DENSE))


def verdict(base_hit: Column, hit: Column, base_mrr: Column, mrr: Column, generic: Column) -> Column:
    """Whether a candidate collection replaces the baseline."""
    return (
        F.when((hit < 80) | (generic > 0) | (hit < base_hit - 5), "ROLLBACK")
        .when((hit >= base_hit - 3) & (mrr >= base_mrr - 0.03) & (hit >= 85), "PROMOTE").otherwise("MANUAL_REVIEW")
    )


@pandas_udf(DoubleType())
def must_not_violation(answer: pd.Series, concept: pd.Series) -> pd.Series:
    """Greatest sentence-concept score, cut to 15 % where negation differs; 1 if the concept is said."""
    from .text import EN_STOPWORDS, NEGATION_MARKERS, VI_STOPWORDS

    stop = {*VI_STOPWORDS, *EN_STOPWORDS}
    norm = lambda s: " ".join((s or "").lower().split())
    terms = lambda s: {t for t in _TOKEN.findall(s) if len(t) > 1 and t not in stop}
    says_no = lambda s: any(m in s for m in NEGATION_MARKERS)

    def one(a: str, c: str) -> float:
        an, cn = norm(a), norm(c)
        if not an or not cn:
            return 0.0
        if cn in an:
            return 1.0
        want, best = terms(cn), 0.0
        for piece in _PIECE.split(a):
            p = norm(piece)
            if p:
                score = max(len(want & terms(p)) / len(want) if want else 0.0, SequenceMatcher(None, p, cn).ratio())
                best = max(best, score * (1.0 if says_no(p) == says_no(cn) else 0.15))
        return best

    return pd.Series([one(a, c) for a, c in zip(answer, concept, strict=True)])


def _mean_over(rows: DataFrame, ids: str, concepts: str, score: Column, name: str) -> DataFrame:
    """Scores of an answer's concepts as one array per row."""
    at = rows.select(ids, "answer", F.posexplode(concepts).alias("i", "concept")).withColumn("s", F.round(score, 3))
    return at.groupBy(ids).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias(name))


def semantic_lite(rows: DataFrame, ids: str = "id") -> DataFrame:
    """``rows(id, answer, ground_truth, must_have, must_not[, short_answer, answerability, top1_title_hit])`` with its scores.

    Concept coverage .45, reference similarity .35 and retrieval .20, renormalised
    over those there are; partial questions gain for saying so, others lose for a
    false insufficiency; a violated claim costs .30. Passes at .60.
    """
    for c, kind in (("short_answer", "string"), ("answerability", "string"), ("top1_title_hit", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    have = _mean_over(rows, ids, "must_have", concept_overlap(F.col("answer"), F.col("concept")), "have")
    bad = _mean_over(rows, ids, "must_not", must_not_violation(F.col("answer"), F.col("concept")), "bad")
    at = rows.join(have, ids, "left").join(bad, ids, "left")
    mean = F.when(F.size("have") > 0, F.aggregate("have", F.lit(0.0), lambda s, x: s + x) / F.size("have"))
    at = at.withColumn("cover", mean).withColumn("similar", F.greatest(best_sentence_similarity(F.col("answer"), F.col("short_answer")), best_sentence_similarity(F.col("answer"), F.col("ground_truth"))))
    violated = F.coalesce(F.exists("bad", lambda x: x >= 0.88), F.lit(False))
    known = (blank(F.col("short_answer")) != "") | (blank(F.col("ground_truth")) != "")
    weight = F.when(F.col("cover").isNotNull(), 0.45).otherwise(0.0) + F.when(known, 0.35).otherwise(0.0) + 0.20
    base = (0.45 * F.coalesce("cover", F.lit(0.0)) + F.when(known, 0.35 * F.col("similar")).otherwise(0.0) + F.when(F.col("top1_title_hit"), 0.20).otherwise(0.0)) / weight
    cue = negative_cue(F.col("answer"))
    false_no = (F.coalesce("answerability", F.lit("")) != "partial_only") & cue & (F.coalesce("cover", F.lit(0.0)) >= 0.55)
    score = base + F.when((F.col("answerability") == "partial_only") & cue, 0.08).otherwise(0.0) - F.when(false_no, 0.12).otherwise(0.0) - F.when(violated, 0.30).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return at.withColumns({
        "must_have_soft_coverage": F.round("cover", 3), "must_not_soft_violated": violated, "reference_similarity": F.round("similar", 3), "false_insufficiency_flag": false_no,
        "semantic_lite_score": F.round(score, 3), "semantic_lite_pass": (score >= 0.60) & ~violated}).drop("have", "bad", "cover", "similar")
