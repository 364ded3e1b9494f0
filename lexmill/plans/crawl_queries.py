"""Crawl, extraction and migration over manifests built from the tables; the SQL holds its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import links as page_links
from ..operators import assets as V
from ..operators import extraction as X
from ..operators import frontier as B
from ..operators import matching as M
from .registry import REC, records, register, table
from .text_queries import quoted


def _number(text: Column, most: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % most


def _no(x: str, most: int) -> str:
    return f"(('0x' || left(md5({x}), 8))::BIGINT % {most})"


# ------------------------------------------------------------------ discovery
_WAYS = 240


@register("z05_h76_discovery", f"""WITH l AS (SELECT page_id AS page, i - 1 AS position, {_no("href || '|' || page_id", _WAYS)} AS target, href AS title FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i, unnest(hrefs) AS href FROM (
  SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"''#]+)', 1) AS a FROM pages)))),
d0 AS (SELECT page_id AS page, [page_id] AS path FROM pages WHERE page_id % 50 = 0),
{', '.join(f'''d{k} AS (SELECT target AS page, list_append(path, position) AS path FROM l JOIN d{k - 1} ON l.page = d{k - 1}.page WHERE target % 4 > 0
  AND target NOT IN ({' UNION ALL '.join(f"SELECT page FROM d{j}" for j in range(k))}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY list_append(path, position)) = 1)''' for k in range(1, 4))},
v AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS n FROM ({' UNION ALL '.join(f"SELECT page, path, {k} AS depth FROM d{k}" for k in range(4))})),
i AS (SELECT target AS url, title, depth, list_append(path, position) AS path FROM l JOIN v ON l.page = v.page WHERE n <= 120 AND target % 3 = 0 QUALIFY row_number() OVER (PARTITION BY target ORDER BY depth, list_append(path, position)) = 1)
SELECT url, title, depth, array_to_string(path, '/') AS path FROM (SELECT *, row_number() OVER (ORDER BY depth, path) AS n FROM i) WHERE n <= 300""")
def z05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own links; addresses lead to pages by a hash, as the tables' pages don't link to each other."""
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.posexplode(page_links(F.col("html"))).alias("position", "title"))
    rows = found.withColumn("target", _number(F.concat("title", F.lit("|"), F.col("page").cast("string")), _WAYS))
    seeds = table(spark, sf_dir, "pages").where("page_id % 50 = 0").select(F.col("page_id").alias("page"), F.col("page_id").alias("position"))
    _, items = B.discover(rows, seeds, F.col("target") % 3 == 0, F.col("target") % 4 > 0, max_depth=3, max_pages=120, max_items=300)
    return items.select("url", "title", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


# ------------------------------------------------------------------ states
_KINDS, _ENDS = ["html", "pdf", "xml", "txt", "image"], [".html", ".pdf", ".xml", ".txt", ".png"]
_STATES, _HOWS = ["done", "pending", "failed", "deferred", "missing_asset"], ["html_text", "digital_pdf_text", "image_pdf_backlog", "long_pdf_book"]


def _pick(values: list[str], n: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / n) % len(values) + 1).cast("int"))


def _of(values: list[str], n: int) -> str:
    return f"{quoted(values)}[(doc_id // {n} % {len(values)} + 1)::INT]"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: several rows a path, several paths a stem."""
    c = F.col
    name = F.concat(F.lit("sources/s/name_"), (c("doc_id") % 311).cast("string"), _pick(_ENDS, 2))
    return records(spark, sf_dir).select(
        c("doc_id").alias("position"), F.lit("s").alias("source_id"), F.when(c("doc_id") % 97 == 5, " ").otherwise(name).alias("relative_path"), _pick(_KINDS, 2).alias("content_class"), _pick(_HOWS, 3).alias("extract_strategy"),
        _pick(_STATES, 1).alias("extract_status"), F.when(c("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("item_url"), F.lit("").alias("file_url"), F.lit(None).cast("string").alias("parent_item_url"),
        F.when(c("doc_id") % 2 == 0, "bootstrapped_from_existing_raw; x").otherwise("").alias("notes"), "title", "body", "source_name")


def _exist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _manifest(spark, sf_dir).where(F.trim("relative_path") != "")
    stem = F.regexp_extract("relative_path", r"(name_\d+)\.(?!png)|(name_\d+\.png)$", 0)
    stem = F.regexp_replace(stem, r"\.$", "")
    n = _number(F.col("relative_path"), 10)
    k = _number(F.col("stem"), 10)
    stems = m.select(stem.alias("stem")).distinct().unionAll(records(spark, sf_dir).where("doc_id % 25 = 0").select(F.concat(F.lit("old_"), F.col("doc_id").cast("string")).alias("stem")))
    return m.where(n > 2).select("relative_path"), stems.where(k.isin(0, 1, 2, 3)), stems.where(k.isin(3, 4, 5)).select("stem", (k == 4).alias("legacy"))


_MAN = f"""{REC}, man AS (SELECT doc_id AS position, CASE WHEN doc_id % 97 = 5 THEN '' ELSE 'sources/s/name_' || (doc_id % 311) || {_of(_ENDS, 2)} END AS p, {_of(_KINDS, 2)} AS kind, {_of(_HOWS, 3)} AS how, {_of(_STATES, 1)} AS st, doc_id % 2 = 0 AND doc_id % 3 = 0 AS lost FROM rec),
last AS (SELECT p, arg_max(struct_pack(kind, how, st, lost), position) AS r, min(position) AS first FROM man WHERE p <> '' GROUP BY p),
u AS (SELECT p, r.kind AS kind, r.how AS how, r.st AS st, r.lost AS lost, first, CASE WHEN p LIKE '%.png' THEN regexp_extract(p, '[^/]*$') ELSE regexp_extract(p, '([^/]*)[.][a-z]+$', 1) END AS stem FROM last),
stems AS (SELECT DISTINCT stem FROM u UNION ALL SELECT 'old_' || doc_id FROM rec WHERE doc_id % 25 = 0),
x AS (SELECT u.*, {_no('p', 10)} > 2 AS here, {_no('stem', 10)} IN (0, 1, 2, 3) AS outp, {_no('stem', 10)} IN (3, 4, 5) AS once, {_no('stem', 10)} = 4 AS legacy FROM u),
y AS (SELECT *, coalesce(bool_or(st = 'done' AND here AND (outp OR once)) OVER (PARTITION BY stem ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR bool_or(st = 'done') OVER (PARTITION BY stem ORDER BY first ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sib FROM x),
z AS (SELECT *, CASE WHEN NOT here THEN CASE WHEN sib OR lost THEN 'deferred' ELSE 'missing_asset' END WHEN st = 'missing_asset' THEN CASE WHEN kind <> 'image' OR how IN ('html_text', 'digital_pdf_text') THEN 'pending' ELSE 'deferred' END
  WHEN st = 'done' AND NOT outp AND NOT once THEN 'pending' ELSE st END AS new_st, CASE WHEN NOT here AND sib THEN 'stale_sibling_backlog' WHEN NOT here AND lost THEN 'legacy_missing_backlog' ELSE how END AS new_how FROM y)"""


@register("z08_reconcile", f"""WITH {_MAN} SELECT man.position, coalesce(z.new_how, man.how) AS extract_strategy, coalesce(z.new_st, man.st) AS extract_status FROM man LEFT JOIN z ON man.p = z.p""")
def z08(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _ = X.reconcile(_manifest(spark, sf_dir), *_exist(spark, sf_dir))
    return new.select("position", "extract_strategy", "extract_status")


@register("h74_h75_outputs", f"""WITH {_MAN}, w AS (SELECT stem, bool_or(new_st = 'done') AS done, bool_or((NOT here AND NOT sib AND (lost OR NOT legacy)) OR (here AND new_st IN ('failed', 'deferred') AND (outp OR back) AND NOT sib)) AS dropped, bool_or(back) AS restored FROM (SELECT *, once AND NOT outp AND bool_or(st = 'done') OVER (PARTITION BY stem) AS back FROM z) GROUP BY stem),
o AS (SELECT DISTINCT stem FROM stems WHERE {_no('stem', 10)} IN (0, 1, 2, 3))
SELECT coalesce(o.stem, w.stem) AS stem, CASE WHEN coalesce(dropped, false) THEN 'deleted' WHEN NOT coalesce(done, false) THEN 'quarantined' WHEN restored THEN 'restored' ELSE 'kept' END AS state FROM o FULL JOIN w ON o.stem = w.stem WHERE o.stem IS NOT NULL OR restored""")
def h74(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outputs = X.reconcile(_manifest(spark, sf_dir), *_exist(spark, sf_dir))
    return outputs


@register("a16_extract_report", f"""WITH {_MAN} SELECT count(*) AS unique_assets, count_if(st = 'done' AND outp)::BIGINT AS processed, count_if(st = 'failed')::BIGINT AS failed, count_if(st = 'missing_asset')::BIGINT AS missing_assets, count_if(st = 'deferred')::BIGINT AS deferred,
  count_if(st = 'pending' OR (st = 'done' AND NOT outp))::BIGINT AS pending, count_if(st = 'done' AND outp AND how = 'digital_pdf_text')::BIGINT AS digital_pdfs, 0::BIGINT AS scanned_pdfs, count_if(how = 'long_pdf_book')::BIGINT AS long_pdf_books,
  count_if(how = 'image_pdf_backlog')::BIGINT AS image_like_pdfs, (SELECT count(DISTINCT stem) FROM stems WHERE {_no('stem', 10)} IN (0, 1, 2, 3)) AS processed_files FROM x""")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_report(_manifest(spark, sf_dir), _exist(spark, sf_dir)[1])


_ROWS = f"""{REC}, r AS (SELECT doc_id, {_of([*_KINDS, 'docx', 'other', 'html_book'], 1)} AS kind, {_of(['', '.xml', '.DOCX', '.pdf'], 3)} AS ext, {_of(_HOWS, 2)} AS how, {_of(_STATES, 7)} AS st, doc_id % 6 > 0 AS here, doc_id % 5 = 0 AS outp, doc_id % 9 = 0 AS filtered,
  CASE WHEN doc_id % 4 > 0 THEN len(body) END AS chars, {_of(['process', 'defer', 'fail'], 5)} AS act FROM rec)"""


@register("z09_extraction_step", f"""WITH {_ROWS}, s AS (SELECT doc_id, CASE WHEN (st = 'done' AND outp) OR (st = 'deferred' AND NOT here) THEN ['skip', how, st] WHEN NOT here THEN ['drop', how, 'missing_asset'] WHEN ext = '.DOCX' THEN ['drop', 'office_backlog', 'deferred'] WHEN kind IN ('image', 'docx') THEN ['drop', how, 'deferred']
  WHEN kind LIKE 'html%' THEN CASE WHEN filtered THEN ['drop', 'html_filtered', 'deferred'] WHEN coalesce(chars, 0) < 120 THEN ['drop', 'html_text', 'failed'] ELSE ['write', 'html_text', 'done'] END
  WHEN kind = 'xml' THEN CASE WHEN ext NOT IN ('', '.xml') THEN ['drop', 'misclassified_non_xml', 'deferred'] ELSE ['write', 'xml_text', 'done'] END
  WHEN kind = 'pdf' THEN CASE WHEN act = 'process' THEN CASE WHEN chars IS NULL THEN ['drop', 'digital_pdf_text', 'failed'] ELSE ['write', 'profiled', 'done'] END WHEN act = 'defer' THEN ['drop', 'profiled', 'deferred'] ELSE ['drop', 'classify_pdf', 'failed'] END
  WHEN kind = 'txt' THEN ['write', 'universal_loader', 'done'] ELSE ['drop', how, 'deferred'] END AS v FROM r) SELECT doc_id, v[1] AS action, v[2] AS new_strategy, v[3] AS new_status FROM s""")
def z09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = records(spark, sf_dir).select(
        "doc_id", _pick([*_KINDS, "docx", "other", "html_book"], 1).alias("content_class"), _pick(["", ".xml", ".DOCX", ".pdf"], 3).alias("extension"), _pick(_HOWS, 2).alias("extract_strategy"), _pick(_STATES, 7).alias("extract_status"),
        (c("doc_id") % 6 > 0).alias("exists"), (c("doc_id") % 5 == 0).alias("has_output"), (c("doc_id") % 9 == 0).alias("filtered"), F.when(c("doc_id") % 4 > 0, F.char_length("body")).alias("text_chars"),
        _pick(["process", "defer", "fail"], 5).alias("pdf_action"), F.lit("profiled").alias("pdf_strategy"))
    return X.extraction_step(rows).select("doc_id", "action", "new_strategy", "new_status")


# ------------------------------------------------------------------ page filter
_SITES = ["msd_manual_consumer", "cdc_health_topics", "mayo_diseases_conditions", "who_vietnam", "vien_dinh_duong", "none", ""]
_PATHS = ["/resource/x", "/about-us/", "/diseases-conditions/flu/symptoms-causes/y", "/westernpacific/emergencies/covid-19", "/vi/professional-activities/hoat-dong", "/vi/professional-activities/hoat-dong-0123abcdef", "/a/INDEX?letter=B", "/diseases-conditions/index.aspx/", "/vi/search/", "/topic"]
_NAMES = ["3D Models", "Contact us today", "Find a condition that begins with the letter A", "Questions and Answers", "so-do-to-chuc", "Tra cứu", "plain", ""]
_LOW = "lower(t)"


@register("f19_page_filter", f"""WITH {REC}, r AS (SELECT doc_id, {_of(_SITES, 1)} AS s, lower('https://X.org' || {_of(_PATHS, 7)} || CASE WHEN doc_id % 11 = 0 THEN '?q=' || title ELSE '' END) AS u, lower(CASE WHEN doc_id % 5 = 0 THEN title ELSE {_of(_NAMES, 3)} END) AS t FROM rec),
q AS (SELECT *, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT doc_id, CASE s WHEN 'msd_manual_consumer' THEN contains(u, '/pages-with-widgets/') OR contains(u, '/resource/') OR contains(t, '3d models') OR contains(t, 'resources') OR contains(t, 'news')
  WHEN 'cdc_health_topics' THEN {' OR '.join(f"contains(u, '{x}')" for x in ['affirmative-employment', 'alternative-dispute-resolution', 'about-us', 'about-cdc', 'budget', 'cdc-info', 'contact-us', 'data-research', 'equal-employment-opportunity', 'fellowships', 'foia', 'helpdesk', 'index.html', 'no-fear-act', 'sams-user-faq', 'site.html'])}
    OR {' OR '.join(f"contains(t, '{x}')" for x in ['contact us', 'about our service', 'view all', 'español', 'fellowships', 'training opportunities', 'no fear act', 'faq', 'help desk'])}
  WHEN 'mayo_diseases_conditions' THEN contains(u, 'index?letter=') OR ends_with(rtrim(u, '/'), '/diseases-conditions/index.aspx') OR NOT (contains(u, '/symptoms-causes/') OR contains(u, '/diagnosis-treatment/')) OR starts_with(t, 'find a condition that begins with the letter')
  WHEN 'who_vietnam' THEN contains(u, '/westernpacific/emergencies/covid-19') OR contains(u, '/about/how-we-work/pacific-support/') OR contains(u, '/news/questions-and-answers') OR contains(t, 'questions and answers') OR contains(t, 'pacific health ministers meeting') OR contains(t, 'who western pacific')
  WHEN 'vien_dinh_duong' THEN regexp_matches(path, '^/vi/professional-activities/[^/]+$') AND NOT regexp_matches(path, '[a-f0-9]{{8,}}$') OR rtrim(path, '/') IN ('/vi/professional-activities', '/vi/search') OR contains(u, '/about/') OR contains(u, '/trang-chu') OR contains(u, '/question/')
    OR {' OR '.join(f"contains(t, '{x}') OR contains(trim(replace(t, '-', ' ')), '{x}')" for x in ['so do to chuc', 'tra cứu', 'tra cuu', 'search', 'site map', 'hoi dap'])} ELSE false END AS filtered FROM q""")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://X.org"), _pick(_PATHS, 7), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("?q="), "title")).otherwise(""))
    rows = records(spark, sf_dir).select("doc_id", _pick(_SITES, 1).alias("source_id"), url.alias("item_url"), F.when(F.col("doc_id") % 5 == 0, F.col("title")).otherwise(_pick(_NAMES, 3)).alias("title_hint"))
    return X.filtered_pages(rows).select("doc_id", "filtered")


# ------------------------------------------------------------------ assets
@register("k14_versions", f"""WITH {REC}, d AS (SELECT DISTINCT source_name AS s, 'file_' || (doc_id % 40) || '.pdf' AS asset, sha256(body) AS sha, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%dT%H:%M:%SZ') AS t FROM rec WHERE source_name IS NOT NULL)
SELECT s AS source_id, asset, CASE WHEN row_number() OVER (PARTITION BY s, asset ORDER BY t, sha) = 1 THEN asset ELSE regexp_replace(asset, '[.]pdf$', '') || '__' || replace(replace(t, '-', ''), ':', '') || '.pdf' END AS name, sha AS sha256, t AS downloaded_at FROM d""")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of downloads, the second with all of the first again: nothing is appended twice."""
    c = F.col
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + c("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    got = records(spark, sf_dir).where("source_name is not null").select(
        "doc_id", c("source_name").alias("source_id"), F.concat(F.lit("file_"), (c("doc_id") % 40).cast("string")).alias("filename_hint"), F.lit(".pdf").alias("extension"), F.sha2("body", 256).alias("sha256"), time.alias("downloaded_at"))
    none = got.select("source_id", F.lit("").alias("asset"), F.lit("").alias("name"), "sha256", "downloaded_at").where("false")
    half = records(spark, sf_dir).agg(F.expr("percentile_disc(0.5) within group (order by doc_id)").alias("m"))
    first = V.append_versions(none, got.join(F.broadcast(half), c("doc_id") <= c("m")).drop("doc_id", "m"))
    return V.append_versions(first, got.drop("doc_id"))


@register("k15_migration", f"""WITH {REC}, f AS (SELECT 'old/' || doc_id AS path, len(body)::BIGINT AS bytes, sha256(body) AS sha FROM rec WHERE doc_id % 7 > 0 UNION ALL SELECT 'new/' || doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN sha256(body) ELSE 'other' END FROM rec WHERE doc_id % 3 = 0),
t AS (SELECT doc_id, 'old/' || doc_id AS s, 'new/' || doc_id AS d FROM rec) SELECT t.doc_id, CASE WHEN a.sha IS NULL THEN 'missing_source' WHEN b.sha = a.sha THEN 'skip_same_hash' WHEN b.sha IS NOT NULL THEN 'conflict' ELSE 'copy' END AS action, coalesce(a.bytes, 0) AS bytes,
  CASE WHEN a.sha IS NULL THEN '' ELSE coalesce(b.sha, a.sha) END AS destination_sha256, CASE WHEN a.sha IS NULL THEN 'missing_source' WHEN b.sha IS NOT NULL AND b.sha <> a.sha THEN 'conflict' ELSE 'skip_same_hash' END AS again FROM t LEFT JOIN f a ON a.path = t.s LEFT JOIN f b ON b.path = t.d""")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration, and the same one again over what it leaves."""
    c = F.col
    rec = records(spark, sf_dir)
    at = lambda folder: F.concat(F.lit(folder), c("doc_id").cast("string"))
    files = rec.where("doc_id % 7 > 0").select(at("old/").alias("path"), F.char_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256")).unionAll(
        rec.where("doc_id % 3 = 0").select(at("new/"), F.lit(1).cast("long"), F.when(c("doc_id") % 2 == 0, F.sha2("body", 256)).otherwise("other")))
    tasks = rec.select("doc_id", at("old/").alias("source"), at("new/").alias("destination"))
    done = V.migration(tasks, files, execute=True)
    again = V.migration(tasks, V.migrated(files, done), execute=True)
    return done.select("doc_id", "action", "bytes", "destination_sha256").join(again.select("doc_id", c("action").alias("again")), "doc_id")


# ------------------------------------------------------------------ manifest rows of files
_HINTS = ["pdf", "A plain title of a study", "some-slug-of-words", "0123456789abcdef0123456789abcdef", ""]


def _hex(x: str) -> str:
    return f"lower(regexp_extract({x}, '(?i)([0-9a-f]{{24,}})$', 1))"


@register("c21_j07_j08_manifest_rows", f"""WITH {REC}, m AS (SELECT doc_id AS position, 'sources/s/' || CASE WHEN doc_id % 3 = 0 THEN md5((doc_id // 6)::VARCHAR) ELSE 'name_' || (doc_id % 150) END || '.html' AS p, {_of(_HINTS, 1)} AS hint, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'http://x/' || md5((doc_id // 9)::VARCHAR) END AS url,
  doc_id % 5 = 0 AS done, doc_id % 2 = 0 AS boot FROM rec), s AS (SELECT *, CASE WHEN url <> '' THEN 80 ELSE 0 END + CASE hint WHEN '' THEN 0 WHEN 'A plain title of a study' THEN 60 ELSE 10 END + CASE WHEN done THEN 10 ELSE 0 END + 5 - CASE WHEN boot THEN 25 ELSE 0 END - CASE WHEN hint = 'pdf' THEN 50 ELSE 0 END - CASE WHEN hint = 'A plain title of a study' THEN 0 ELSE 10 END AS score,
  regexp_extract(p, '([^/]*)[.]html$', 1) AS stem FROM m), f AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN md5((doc_id // 6)::VARCHAR) ELSE 'name_' || (doc_id % 200) END AS file FROM rec),
c AS (SELECT DISTINCT file, s.*, file = stem AS by_stem FROM f JOIN s ON file = stem OR ({_hex('file')} <> '' AND {_hex('file')} IN ({_hex('stem')}, {_hex('p')}, {_hex('hint')}, {_hex('url')})))
SELECT f.file, any_value(position) AS position, any_value(score)::INT AS score, any_value(url) AS url, coalesce(any_value(n), 0) AS n_candidates FROM f LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, by_stem DESC, position) = 1) b ON f.file = b.file GROUP BY f.file""")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    no = lambda n: F.floor(c("doc_id") / n).cast("string")
    stem = F.when(c("doc_id") % 3 == 0, F.md5(no(6))).otherwise(F.concat(F.lit("name_"), (c("doc_id") % 150).cast("string")))
    rows = records(spark, sf_dir).select(
        F.lit("s").alias("source_id"), c("doc_id").alias("position"), F.concat(F.lit("sources/s/"), stem, F.lit(".html")).alias("relative_path"), F.lit("html").alias("content_class"), _pick(_HINTS, 1).alias("title_hint"),
        F.when(c("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("http://x/"), F.md5(no(9)))).alias("item_url"), F.lit(None).cast("string").alias("file_url"), F.lit("").alias("parent_item_url"),
        F.when(c("doc_id") % 5 == 0, "done").otherwise("").alias("extract_status"), F.when(c("doc_id") % 2 == 0, "bootstrapped_from_existing_raw").otherwise("").alias("notes"))
    files = records(spark, sf_dir).select(F.lit("s").alias("source_id"), F.when(c("doc_id") % 2 == 0, F.md5(no(6))).otherwise(F.concat(F.lit("name_"), (c("doc_id") % 200).cast("string"))).alias("name")).distinct()
    found = M.best_manifest_rows(files.select("source_id", F.concat(F.lit("processed/"), "name", F.lit(".txt")).alias("file"), "name"), M.manifest_index(rows))
    return found.select(c("name").alias("file"), "match.position", "match.score", "match.url", "n_candidates")
