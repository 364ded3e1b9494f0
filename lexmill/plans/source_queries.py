"""Asset, HTML and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import qa
from ..operators.lineage import shared_folder
from ..sources import sinks
from ..streaming import streams
from .registry import REC, records, register, scalar, table
from .text_queries import quoted

_ID = lambda: F.col("doc_id")
_URLS = ["https://a.example/x/Some_Title-here.html?q=1#f", "http://b.example/d/report%20one.PDF", "/rel/noext", "", "https://c.example/a.b/c.tar.gz", "https://c.example"]
_URL, _URL_SQL = (lambda: F.element_at(F.array(*[F.lit(u) for u in _URLS]), (_ID() % 6 + 1).cast("int"))), f"{quoted(_URLS)}[(doc_id % 6 + 1)::INT]"
_SLUGS = ["some title here", "report one", "noext", "", "c.tar.gz", ""]
scalar("t53_title_from_url", {"value": (lambda: T.title_from_url(_URL()), f"{quoted(_SLUGS)}[(doc_id % 6 + 1)::INT]")})
_EXTS = [".html", ".pdf", "", "", ".gz", ""]
scalar("t73_extension", {"value": (lambda: T.extension(F.when(_ID() % 7 == 0, "Name.TXT").otherwise(""), _URL()), f"CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE {quoted(_EXTS)}[(doc_id % 6 + 1)::INT] END")})
_E = [".htm", ".xml", "", ".PNG", ".docx", ".txt", ".markdown", ".jsonl", ".bin"]
_M = ["", "", "application/pdf", "", "", "", "", "", "image/tiff"]
_C = ["html", "xml", "pdf", "image", "docx", "txt", "md", "jsonl", "image"]
_S = ["html_text", "xml_text", "classify_pdf", "image_backlog", "office_backlog", "universal_loader", "universal_loader", "universal_loader", "image_backlog"]
_AT = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (_ID() % 9 + 1).cast("int"))
scalar("t74_content_class", {"value": (lambda: T.content_class(_AT(_E), _AT(_M)), f"{quoted(_C)}[(doc_id % 9 + 1)::INT]")})
scalar("t75_extract_strategy", {"value": (lambda: T.extract_strategy(T.content_class(_AT(_E), _AT(_M))), f"{quoted(_S)}[(doc_id % 9 + 1)::INT]")})
_HREF = ["#top", "javascript:x()", "mailto:a@b", "/abs/p#f", "rel/p?q#f", "//h.example/p", "https://z.example/#a", "?page=2", " "]
_HAVE = ["", "", "", "https://a.example/abs/p", "https://a.example/x/rel/p?q", "https://h.example/p", "https://z.example/", "https://a.example/x/y?page=2", ""]
scalar("t72_normalize_href", {"value": (lambda: T.normalize_href(F.lit("https://a.example/x/y?z=1#w"), _AT(_HREF)), f"{quoted(_HAVE)}[(doc_id % 9 + 1)::INT]")})
scalar("k10_safe_name", {"value": (lambda: sinks.safe_name(F.col("source_name"), F.concat(F.lit("a/b c/doc é ("), _ID(), F.lit(").v2.txt"))),
    "source_name || '__doc_é__' || doc_id || '_.v2__' || left(sha1('a/b c/doc é (' || doc_id || ').v2.txt'), 10) || '.txt'")})


@register("k08_build_release", f"""WITH {REC}, u AS (SELECT *, 0 AS part FROM rec WHERE language = 'en' UNION ALL SELECT *, 1 FROM rec)
SELECT doc_id, part, trim(body) <> '' AND trim(title) <> '' AND trim(source_name) <> '' AS is_valid FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part) = 1""")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir).withColumns({"doc_type": F.lit("review"), "audience": F.lit("student"), "source_id": F.lit(""), "pos": F.col("doc_id")})
    parts = {"first": rec.where("language = 'en'").withColumn("part", F.lit(0)), "second": rec.withColumn("part", F.lit(1))}
    return sinks.build_release(parts, "doc_id").select("doc_id", "part", "is_valid")


@register("k04_upsert", "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END, 2) AS v FROM customer UNION ALL SELECT c_custkey + 1000000, round(c_acctbal * 2, 2) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("v"), F.lit(0).alias("at"))
    hit = c.where("c_custkey % 3 = 0")
    new = hit.withColumns({"v": F.col("v") * 9, "at": F.lit(1)}).unionByName(hit.withColumns({"v": F.col("v") * 2, "at": F.lit(2)}))
    new = new.unionByName(hit.where("c_custkey % 2 = 0").withColumns({"c_custkey": F.col("c_custkey") + 1000000, "v": F.col("v") * 2, "at": F.lit(1)}))
    return sinks.upsert(c, new, "c_custkey", "at").select("c_custkey", F.round("v", 2).alias("v"))


@register("k11_export_checks", f"WITH {REC} SELECT count(*) AS chunk_count, count(*) - count(DISTINCT id) AS duplicate_ids, count_if(trim(body) = '') AS empty_texts, count_if(trim(title) = '') AS missing_title, count_if(trim(coalesce(language, '')) = '') AS missing_language FROM (SELECT *, n_chars % 500 AS id FROM rec)")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_checks(records(spark, sf_dir).withColumn("id", F.col("n_chars") % 500), ["title", "language"], text="body")


@register("w14_unique_ids", "SELECT o_orderkey, CASE WHEN n = 0 THEN id ELSE id || '_' || n END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) - 1 AS n FROM (SELECT o_orderkey, 'c' || o_custkey AS id FROM orders))")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("id"))
    return qa.unique_ids(o, "id", ["o_orderkey"]).select("o_orderkey", "unique_id")


@register("t79_html_to_text")
def t79(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.to_text("html").alias("text"))


@register("t80_html_lists")
def t80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.to_text_with_lists("html").alias("text"))


@register("t81_html_sections")
def t81(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.to_sections("html")).alias("s")).select("page_id", "s.title", "s.body")


@register("t83_json_ld", "SELECT page_id, 'Part one' || chr(10) || 'Text ' || page_id AS text FROM pages")
def t83(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit('<script type="application/ld+json">{"hasPart":[{"headline":"Part one","text":"<p>Text '), "page_id", F.lit('</p>"}]}</script>'))
    return table(spark, sf_dir, "pages").select("page_id", H.json_ld_text(F.concat(block, "html")).alias("raw")).select("page_id", F.regexp_replace("raw", r"\n ?\s*", "\n").alias("text"))


@register("h82_page_links", "SELECT page_id, len(l) AS n_links, array_to_string(l[:3], ' ') AS first_links FROM (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS l FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"''#]+)', 1) AS a FROM pages))")
def h82(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", H.links(F.col("html")).alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join(F.slice("l", 1, 3), " ").alias("first_links"))


def _drained(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """Result of a stream over the events, run until nothing is left, in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = streams.event_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    out = build(events)
    streams.drain(out, f"{folder}/out", f"{folder}/state", mode)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@register("z03_streaming_changes", "SELECT event_id, CASE WHEN psha <> sha THEN 'updated_asset' ELSE '' END AS duplicate_status, CASE WHEN psha <> sha THEN pid END AS duplicate_of FROM (SELECT *, lag(sha) OVER k AS psha, lag(event_id) OVER k AS pid FROM (SELECT *, floor(value * 10)::BIGINT % 200 AS sha FROM events) WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id))")
def z03s(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(e: DataFrame) -> DataFrame:
        return streams.change_detection(e.select("event_id", "ts", F.col("user_id").alias("key"), (F.floor(F.col("value") * 10).cast("long") % 200).alias("sha")))

    return _drained(spark, sf_dir, build, "append").select("event_id", "duplicate_status", "duplicate_of")


@register("z02_streaming_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def z02s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, lambda e: streams.first_seen(e, ["user_id", "event_type"]), "append").select("user_id", "event_type")


@register("z12_streaming_metrics", "SELECT floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, max(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def z12s(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(spark, sf_dir, streams.request_metrics, "append")
    return out.groupBy(F.unix_timestamp("start").alias("start"), "event_type").agg(F.sum("n").alias("n"))
