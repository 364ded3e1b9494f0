"""Mojibake and sentence repair over the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair as M
from .registry import REC, records, register, scalar

_BAD = lambda: F.when(F.col("doc_id") % 3 == 0, F.concat("title", F.lit(" Ã©t"))).when(F.col("doc_id") % 3 == 1, F.concat("title", F.lit(" Ã x â€œ"))).otherwise(F.col("title"))
scalar("t42_looks_like_mojibake", {"value": (lambda: M.looks_like_mojibake(_BAD(), F.when(F.col("doc_id") % 2 == 0, "vi").otherwise("en")),
    "CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 1 ELSE doc_id % 3 < 2 END")})


@register("t40_fix_code_page", f"WITH {REC} SELECT doc_id, 'x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' été' ELSE ' Ã plain' END AS value FROM rec")
def t40(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.concat(F.lit("x"), "doc_id", F.when(F.col("doc_id") % 2 == 0, " Ã©tÃ©").otherwise(" Ã plain"))
    return records(spark, sf_dir).select("doc_id", M.fix_code_page(bad).alias("value"))


scalar("u09_dedupe_sentences", {"value": (lambda: M.dedupe_sentences(F.concat(F.lit("First one. Second "), "doc_id", F.lit("! FIRST  one. Third?"))), "'First one. Second ' || doc_id || '! Third?'")})
