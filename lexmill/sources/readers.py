"""Readers: any Hadoop file system, explicit schemas, lenient coercion at the record boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import predicates as P
from ..functions import text as T
from ..operators.structure import markdown_sections

# Fields of a document record with their defaults, in order.
FIELDS: dict[str, str] = {
    "doc_id": "", "title": "", "body": "", "source_name": "", "canonical_title": "", "section_title": "", "source_url": "", "source_id": "",
    "source_file": "", "article_id": "", "institution": "", "raw_path": "", "processed_path": "", "intermediate_path": "", "parent_file": "",
    "source_sha256": "", "crawl_run_id": "", "etl_run_id": "", "doc_type": "reference", "specialty": "general", "audience": "patient", "language": "en",
    "language_confidence": "0.0", "is_mixed_language": "false", "trust_tier": "3", "published_at": "", "updated_at": "", "quality_score": "",
    "quality_status": "", "quality_flags": "", "tags": "", "heading_path": "",
}
LISTS = ("quality_flags", "tags")
# Columns of a crawl manifest.
MANIFEST = (
    "source_id crawl_run_id item_id item_type title_hint item_url file_url parent_item_url relative_path extension mime_type content_class http_status "
    "content_length etag last_modified sha256 discovered_at_utc downloaded_at_utc duplicate_status duplicate_of extract_strategy extract_status notes"
).split()
_RAW = StructType([StructField(f, StringType()) for f in FIELDS])


def bind(raw: DataFrame) -> DataFrame:
    """String columns of a record to its types; unknown columns go, missing ones get their default.

    Comma lists and JSON arrays become arrays, digits integers, ``1/true/yes``
    true; what can't be read as a number is null.
    """

    def value(name: str) -> Column:
        c = F.col(f"`{name}`").cast("string") if name in raw.columns else F.lit(None).cast("string")
        if name in LISTS:
            listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
            return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        if name == "is_mixed_language":
            return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))
        if name == "language_confidence":
            return F.coalesce(c.try_cast("double"), F.lit(0.0))
        if name in ("trust_tier", "quality_score"):
            default = F.lit(int(FIELDS[name])) if FIELDS[name] else F.lit(None).cast("int")
            return F.when(c.isNull(), default).otherwise(c.try_cast("int"))
        return F.coalesce(c, F.lit(FIELDS[name]))

    return raw.select(*[value(f).alias(f) for f in FIELDS], *[c for c in ("_pos",) if c in raw.columns])


def generated_id(source: Column, title: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", source, title, index.cast("string")), 256), 1, 16)


def jsonl(spark: SparkSession, path: str, strict: bool = True, source_name: str = "") -> DataFrame:
    """Records of a JSON-lines path.

    Strict: a malformed line fails the read. Tolerant: such lines are skipped,
    a missing source gets the given name and a missing id one made of source,
    title and the line's hash (line numbers don't exist in a split file).
    """
    if strict:
        return bind(spark.read.schema(_RAW).json(path, mode="FAILFAST"))
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", StructType([*_RAW.fields, StructField("_bad", StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    raw = lines.where("r._bad is null and r is not null").select("r.*", "value")
    source = F.coalesce(F.col("source_name"), F.lit(source_name or None), F.lit("unknown"))
    made = generated_id(source, F.coalesce("title", F.lit("record")), F.md5("value"))
    raw = raw.withColumns({"source_name": F.coalesce(F.col("source_name"), F.lit(source_name)), "doc_id": F.when(T.blank(F.col("doc_id")) == "", made).otherwise(F.col("doc_id"))})
    return bind(raw.drop("value", "_bad"))


def csv(spark: SparkSession, path: str, source_name: str = "CSV Import") -> DataFrame:
    """Headers in any case; the body falls back to content and text, the title to the body's start; unknown kinds get their default."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "title" not in raw.columns and "body" not in raw.columns:
        raise ValueError("a title or body column is needed")
    get = lambda n: F.trim(T.blank(F.col(f"`{n}`"))) if n in raw.columns else F.lit("")
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    body = first(get("body"), get("content"), get("text"))
    title = first(get("title"), F.trim(F.regexp_replace(F.substring(body, 1, 80), "\n", " ")))
    made = generated_id(F.lit(source_name), title, F.md5(body))
    rows = raw.select(
        first(get("doc_id"), made).alias("doc_id"), title.alias("title"), body.alias("body"), first(get("source_name"), F.lit(source_name)).alias("source_name"),
        get("section_title").alias("section_title"), first(get("source_url"), get("url")).alias("source_url"),
        F.when(get("doc_type").isin(P.DOC_TYPES), get("doc_type")).otherwise("reference").alias("doc_type"), first(get("specialty"), F.lit("general")).alias("specialty"),
        F.when(get("audience").isin(P.AUDIENCES), get("audience")).otherwise("patient").alias("audience"), first(get("language"), F.lit("en")).alias("language"),
        first(get("trust_tier"), F.lit("3")).alias("trust_tier"), get("tags").alias("tags"))
    return bind(rows.where("body <> ''"))


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Whole files with their stem as words."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    stem = F.regexp_replace(F.regexp_extract(F.try_url_decode(F.col("file")), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return files.withColumn("stem", F.initcap(F.translate(stem, "_-", "  ")))


def txt(spark: SparkSession, path: str, source_name: str = "TXT Import") -> DataFrame:
    """A file or a folder of text files, one record each; empty files give none."""
    f = _files(spark, path, ".txt")
    body = F.regexp_replace("value", r"^\s+|\s+$", "")
    return bind(f.select(generated_id(F.lit(source_name), F.col("stem"), F.lit(0)).alias("doc_id"), F.col("stem").alias("title"), body.alias("body"), F.lit(source_name).alias("source_name"), F.col("file").alias("source_file")).where("body <> ''"))


def markdown(spark: SparkSession, path: str, source_name: str = "Markdown Import") -> DataFrame:
    """One record for each section under ``#`` to ``###``; a file without headings is one record."""
    f = _files(spark, path, ".md").withColumn("s", markdown_sections(F.col("value"), 3))
    whole = F.array(F.struct(F.lit(1).alias("level"), F.col("stem").alias("title"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("body"), F.col("stem").alias("heading_path")))
    f = f.select("stem", "file", F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(whole)).alias("i", "s")).where("s.body <> ''")
    return bind(f.select(
        generated_id(F.lit(source_name), F.col("s.title"), F.col("i")).alias("doc_id"), F.col("s.title").alias("title"), F.col("s.body").alias("body"), F.lit(source_name).alias("source_name"),
        F.col("s.title").alias("section_title"), F.concat_ws(" > ", "stem", "s.title").alias("heading_path"), F.col("file").alias("source_file")))


def detect_format(spark: SparkSession, path: str) -> str:
    """By suffix; of a folder by its files' suffixes, text before markdown before JSON lines."""
    known = {".jsonl": "jsonl", ".csv": "csv", ".txt": "txt", ".md": "md", ".markdown": "md"}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        suffixes = {"." + s.getPath().getName().rsplit(".", 1)[-1].lower() for s in fs.listStatus(p) if s.isFile()}
        return next((k for s, k in ((".txt", "txt"), (".md", "md"), (".jsonl", "jsonl")) if s in suffixes), "txt")
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in known:
        raise ValueError(f"unsupported file format: {suffix}")
    return known[suffix]


READERS: dict[str, Callable[..., DataFrame]] = {"csv": csv, "txt": txt, "md": markdown}


def load(spark: SparkSession, path: str, source_name: str = "", fmt: str | None = None) -> DataFrame:
    """The records of a path without a validation error."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "jsonl":
        rows = jsonl(spark, path, strict=False, source_name=source_name)
    elif fmt in READERS:
        rows = READERS[fmt](spark, path, **({"source_name": source_name} if source_name else {}))
    else:
        raise ValueError(f"unknown format: {fmt}")
    c = F.col
    return rows.where(F.size(P.record_errors(c("doc_id"), c("title"), c("body"), c("source_name"), c("doc_type"), c("audience"), c("trust_tier"))) == 0)


def frontmatter(raw: Column) -> Column:
    """S11, S12, H101: struct(meta, body): the key-value block between ``---`` lines, the last of equal keys, and what follows."""
    pattern = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    block = F.regexp_extract(T.blank(raw), pattern, 1)
    rows = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & F.contains(x, F.lit(":")))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"\A[^:]*:", "")), r"""^["']|["']$""", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.struct(F.map_from_entries(last).alias("meta"), F.regexp_replace(T.blank(raw), pattern, "").alias("body"))


def frontmatter_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with a frontmatter block: file, meta, body."""
    f = _files(spark, path, ".txt").withColumn("f", frontmatter(F.col("value")))
    return f.select("file", "f.meta", "f.body")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's string columns, null as empty; a missing path is an empty manifest."""
    schema = StructType([StructField(c, StringType()) for c in MANIFEST])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in MANIFEST]).na.fill("")


def xml_topics(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ``health-topic`` elements of an XML feed: the summary, or else the alias, of 30 signs or more."""
    schema = "`_title` string, `_url` string, `_id` string, `_language` string, `_date-created` string, `full-summary` string, `also-called` array<string>"
    rows = spark.read.format("xml").option("rowTag", "health-topic").schema(schema).load(path)
    plain = T.normalize_whitespace(F.regexp_replace(F.regexp_replace(T.blank(F.col("full-summary")), r"(?i)</?(p|li|ul|ol|h\d|br|div)[^>]*>", "\n"), "<[^>]*>", ""))
    other = F.when(F.size("also-called") > 0, F.concat(F.lit("Also known as: "), F.element_at("also-called", 1)))
    body = F.when(F.char_length(plain) >= 50, plain).otherwise(F.coalesce(other, plain))
    language = F.when(F.lower(F.coalesce("_language", F.lit("English"))) == "english", "en").otherwise("es")
    return bind(rows.select(
        F.concat_ws("_", F.lit("topic"), language, T.slug(F.col("_title"))).alias("doc_id"), F.trim("_title").alias("title"), F.lit("Full Summary").alias("section_title"), body.alias("body"),
        F.lit("topics").alias("source_name"), F.col("_url").alias("source_url"), F.lit("patient_education").alias("doc_type"), language.alias("language"), F.col("_date-created").alias("published_at"),
        F.col("_date-created").alias("updated_at"), F.concat_ws(" > ", F.trim("_title"), F.lit("Full Summary")).alias("heading_path")).where(F.char_length("body") >= 30))


def binary_pages(spark: SparkSession, path: str, page_texts: Callable[[bytes], list[str]]) -> DataFrame:
    """(file, sha256, pages) of binary documents by a pluggable extractor, e.g. a PDF library; a failing file has null pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = []
            for content in b["content"]:
                try:
                    pages.append(page_texts(bytes(content)))
                except Exception:  # noqa: BLE001  a broken file is a result, not a failure of the job
                    pages.append(None)
            yield pd.DataFrame({"file": b["path"], "sha256": b["sha256"], "pages": pages})

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(run, "file string, sha256 string, pages array<string>")


def classify_pages(pages: Column) -> Column:
    """Digital if the first three pages hold 50 signs, scanned if not, corrupted without pages."""
    text = F.array_join(F.slice(pages, 1, 3), "")
    return F.when(pages.isNull() | (F.size(pages) == 0), "corrupted").when(F.char_length(F.trim(text)) >= 50, "digital").otherwise("scanned")


def lineage(df: DataFrame, stage: str) -> DataFrame:
    """H110: file, size and time of the rows' files from Spark's own metadata column."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("file_time"), F.lit(stage).alias("stage"))
