"""The queries ``opN_<name>`` and their SQL; each a thin digest of its operator's rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, html_extract, media, mixing, quality, sentencepiece, sharding, simhash, spelling, structure_repair, substring_dedup, warc
from .common import cut, read, shared_folder


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs.withColumn("held_out", quality.held_out("doc_id")), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("__id", "doc_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_groups(read(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs)
    return out.select("doc_id", F.col("__n").alias("n_words"), F.col("__r").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select(F.col("__id").alias("doc_id"), "fingerprint", "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    ids = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(ids, 256).alias("ids_sha256"), "exact")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.place(rows, "doc_id", 16, ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = chat.format_rows(read(spark, sf_dir, "conversations"))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    out = rows.unionByName(chat.format_chats(one).drop("record", "error"))
    back, loss = chat.parse(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    said_all = F.array_join(F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "formatted", back.alias("__back"), loss.alias("__loss")).select(
        "conv_id", F.size("__back").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).cast("long").alias("taken"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        warc.write_monolithic(warc.records(read(spark, sf_dir, "pages")), f"{folder}/whole")
        warc.normalise(spark, f"{folder}/whole", f"{folder}/members")
        found = warc.read_records(warc.read_index(spark, f"{folder}/members"))
        page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS long)")
        digest = F.coalesce(F.sha1("payload"), F.substring_index("payload_digest", ":", -1))
        return cut(found.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")))
    finally:
        warc.drop_folder(spark, folder)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = structure_repair.report(structure_repair.damage(rows))
    every = rows.select("conv_id").distinct()
    numbers = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return joined.select("e.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_media_columns": op3_media_columns,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sharding": op8_sharding,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_mixing": op10_mixing,
    "op11_warc": op11_warc,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM later)
), g AS (
  SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(qs), 0) AS r,
    list_filter(ws, lambda x, i: NOT list_contains(coalesce(qs, []::BIGINT[]), i)) AS k
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM u UNION SELECT reach.v, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a
), comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(links.n, 0) AS n_links, c AS component_id, c = vec_id AS kept
FROM u JOIN comp ON comp.v = vec_id LEFT JOIN links ON links.a = vec_id
""",
    "op9_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, list_sum(list_transform([role, text], lambda x: len(x) + len(x) - len(replace(x, '\\', ''))
    + list_sum(list_transform(['<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'], lambda c: (len(x) - len(replace(x, c, ''))) // len(c))))) AS chars
  FROM rows
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(chars + 12 + 10 + 11) AS formatted FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM said
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source AS src, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY src
), o AS (
  SELECT *, cap::DOUBLE / w AS r FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o
), t AS (
  SELECT src, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.src ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * list_sum(list_transform([0, 1, 2], lambda e: CASE WHEN 2 * (source_size * e + start) + size <= 2 * target THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM p
""",
    "op11_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), o AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS owner FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN owner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner > page_id THEN owner END AS refers_to FROM o
""",
}
