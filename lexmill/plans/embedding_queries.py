"""Embedding jobs, coverage and claims over the documents; the SQL holds its own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims as A
from ..functions import coverage as C
from ..operators import embedding as E
from .answering_queries import _Q, _asked
from .registry import REC, records, register, table

_W = r"regexp_extract_all(lower(body), '[\p{L}\p{M}\p{N}_]+')"
_VECTORS = f"""{REC}, w AS (SELECT doc_id, md5(unnest({_W})) AS h FROM rec), e AS (SELECT doc_id, (('0x' || left(h, 8))::BIGINT % 64)::INT AS place, sum(CASE WHEN substring(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL HAVING v <> 0)"""


@register("v01_hashed_words", f"WITH {_VECTORS} SELECT doc_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM e")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.explode(E.hashed_words(F.col("body"), 64)).alias("e")).select("doc_id", "e.place", F.round("e.value", 6).alias("value"))


@register("v03_v04_manifest", f"""WITH {_VECTORS}, n AS (SELECT doc_id, count(e.doc_id) AS k FROM rec LEFT JOIN e USING (doc_id) GROUP BY doc_id)
SELECT 'hashing-words' AS model_name, count(*) AS chunk_count, 64 AS least_dim, 64 AS most_dim, count(DISTINCT doc_id) AS distinct_ids, 0::BIGINT AS not_normalised, 0::BIGINT AS not_finite FROM n""")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.manifest_of(E.embed(records(spark, sf_dir), "doc_id", "body", 64), "doc_id").drop("ids_checksum")


@register("s27_alignment", """SELECT (SELECT count(DISTINCT vec_id) FROM embeddings) AS vectors, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, (SELECT count(DISTINCT doc_id) FROM labels) AS metadata,
  (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS missing_text, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS missing_metadata,
  (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS text_without_vector, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS metadata_without_vector""")
def s27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, texts and labels of the tables, by their numbers."""
    ids = lambda name, col: table(spark, sf_dir, name).select(F.col(col).alias("id"))
    return E.alignment(ids("embeddings", "vec_id"), ids("documents", "doc_id"), ids("labels", "doc_id"), "id")


# ------------------------------------------------------------------ coverage and claims
_KINDS = ["guideline_comparison", "study_result_extraction", "research_appraisal", "teaching_explainer", "comparative_synthesis", "fact_extraction"]


@register("c13_coverage")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document as evidence for its question, over whole bodies; tests hold it against plain rules."""
    c = F.col
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(c("doc_id") / n) % len(values) + 1).cast("int"))
    maybe = lambda k: F.when(c("doc_id") % k > 0, F.lit("x"))
    none = F.array().cast("array<string>")
    evidence = F.struct(
        "title", pick(["", "guideline", "review"], 4).alias("source_type"), F.when(c("doc_id") % 8 > 0, c("text")).otherwise("").alias("raw"), F.when(c("doc_id") % 3 == 0, F.array("said", F.substring("body", 1, 200))).otherwise(none).alias("findings"),
        (c("doc_id") % 4).cast("int").alias("numbers"), maybe(2).alias("design"), maybe(3).alias("population"), maybe(5).alias("sample_size"), maybe(7).alias("setting"), (c("doc_id") % 2).cast("int").alias("limitations"),
        (c("doc_id") % 2 == 0).alias("extracted"), F.when(c("doc_id") % 5 == 0, F.array("body")).otherwise(none).alias("secondary"), F.when(c("doc_id") % 5 == 0, 1).otherwise(0).alias("n_secondary"))
    router = F.struct(
        c("style").alias("answer_style"), pick(_KINDS, 2).alias("query_type"), pick(["article_centric", "topic_summary"], 3).alias("retrieval_mode"), c("policy").alias("answer_policy"), (c("doc_id") % 3 > 0).alias("requires_numbers"), (c("doc_id") % 4 > 1).alias("requires_limitations"))
    at = _asked(spark, sf_dir).select("doc_id", C.coverage(c("query"), evidence, router).alias("x"))
    return at.select("doc_id", "x.level", "x.ceiling", "x.mode", F.round("x.scores.direct", 6).alias("direct"), "x.scores.numeric", "x.scores.methods", F.array_join("x.abstain", "|").alias("abstain"), F.array_join("x.missing", "|").alias("missing"), F.array_join("x.unsupported", "|").alias("unsupported"), "x.gap", "x.scope", "x.max_external")


@register("l03_l04_claims")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct answers and focus claims from each document's whole text and its neighbour sentence, as two chunks; tests hold them against plain loops."""
    c = F.col
    chunks = F.array(F.struct(F.lit("a").alias("chunk_id"), c("section").alias("section_title"), c("text").alias("text")), F.struct(F.lit("b").alias("chunk_id"), F.lit("Kết luận").alias("section_title"), F.concat(c("said"), F.lit(". "), c("body")).alias("text")))
    told = lambda x: F.array_join(F.transform(x, lambda y: F.concat_ws("|", y["chunk_id"], y["section_title"], y["claim"])), "\n")
    return _asked(spark, sf_dir).select("doc_id", F.md5(told(A.direct_answers(chunks, c("query"), c("style")))).alias("direct_md5"), F.md5(told(A.focus_claims(chunks, c("query"), c("style"), c("query_type")))).alias("focus_md5"))
