"""Mojibake detection and repair, and sentence dedup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import blank, squeeze

# ---------------------------------------------------------------- fixed values
MARKS = ["Ã", "â€", "Â®", "Â°", "Â "]
PATTERN = r"Ã.|Â[®° ]|â€"
VIETNAMESE = ["â€", "Â®", "Â°"]
REPLACEMENTS = {"Â°": "°", "â‰¥": "≥", "â‰¤": "≤", "â€”": "—", "â€“": "–", "â€™": "’", "â€œ": "“", "â€˜": "‘", "â€": "”", "Ã±": "ñ"}
COUNTED = ("Ã", "â", "Â")
# ----------------------------------------------------------------------------


def looks_like_mojibake(c: Column, language: Column) -> Column:
    """Marks of text decoded with the wrong code page; Vietnamese, which has Ã and Â of its own, by fewer marks."""
    vi = F.exists(F.array(*[F.lit(m) for m in VIETNAMESE]), lambda m: F.contains(blank(c), m))
    return F.when(F.lower(F.trim(blank(language))) == "vi", vi).otherwise(blank(c).rlike(PATTERN))


@pandas_udf(StringType())
def fix_code_page(texts: pd.Series) -> pd.Series:
    """UTF-8 that was read as code page 1252, if all of it can be read back; else unchanged. The JVM's decoders don't fail on single signs."""

    def one(t: str | None) -> str | None:
        if not t or not any(m in t for m in MARKS):
            return t
        try:
            return t.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return t

    return texts.map(one)


@pandas_udf(StringType())
def fix_common(texts: pd.Series) -> pd.Series:
    """Common wrong signs replaced, then a Latin-1 round trip if it leaves fewer marks."""

    def one(t: str | None) -> str | None:
        if not t or not any(m in t for m in COUNTED):
            return t
        for bad, good in REPLACEMENTS.items():
            t = t.replace(bad, good)
        back = t.encode("latin-1", errors="ignore").decode("utf-8", errors="ignore")
        count = lambda s: sum(s.count(m) for m in COUNTED)
        return back if back and count(back) < count(t) else t

    return texts.map(one)


def dedupe_sentences(c: Column, contained: int = 40) -> Column:
    """Sentences in order without equal ones and without longer ones that an earlier sentence holds."""

    def add(acc: Column, s: Column) -> Column:
        t = F.lower(squeeze(s))
        known = F.exists(acc, lambda x: (F.lower(squeeze(x)) == t) | ((F.char_length(t) >= contained) & F.contains(F.lower(squeeze(x)), t)))
        return F.when((t == "") | known, acc).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(blank(c), r"(?<=[.!?])\s+"), F.array().cast("array<string>"), add), " ")
