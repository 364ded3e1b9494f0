"""Extraction of crawled assets: filters of pages, states of assets, and their reconciliation with what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curation import processed_stem
from ..functions.text import blank

# ---------------------------------------------------------------- fixed values
#: Page filter: (sources, field, kind, tokens). A page goes if a rule holds: its field contains, starts with, ends with or equals
#: any token, or lacks all of them. ``spaced`` is the title, or the title with blanks for its hyphens.
PAGE_RULES = [
    (["msd_manual_consumer", "msd_manual_professional"], "url", "contains", ["/pages-with-widgets/", "/resource/"]),
    (["msd_manual_consumer", "msd_manual_professional"], "title", "contains", ["3d models", "resources", "news"]),
    (["cdc_health_topics"], "url", "contains", [
        "affirmative-employment", "alternative-dispute-resolution", "about-us", "about-cdc", "budget", "cdc-info", "contact-us", "data-research",
        "equal-employment-opportunity", "fellowships", "foia", "helpdesk", "index.html", "no-fear-act", "sams-user-faq", "site.html",
    ]),
    (["cdc_health_topics"], "title", "contains", [
        "contact us", "about our service", "view all", "español", "fellowships", "training opportunities", "no fear act", "faq", "help desk",
    ]),
    (["mayo_diseases_conditions"], "url", "contains", ["index?letter="]),
    (["mayo_diseases_conditions"], "bare_url", "ends", ["/diseases-conditions/index.aspx"]),
    (["mayo_diseases_conditions"], "url", "lacks", ["/symptoms-causes/", "/diagnosis-treatment/"]),
    (["mayo_diseases_conditions"], "title", "starts", ["find a condition that begins with the letter"]),
    (["who_vietnam"], "url", "contains", ["/westernpacific/emergencies/covid-19", "/about/how-we-work/pacific-support/", "/news/questions-and-answers"]),
    (["who_vietnam"], "title", "contains", ["questions and answers", "pacific health ministers meeting", "who western pacific"]),
    (["vien_dinh_duong"], "activity", "equals", ["unnumbered"]),
    (["vien_dinh_duong"], "bare_path", "equals", ["/vi/professional-activities", "/vi/search"]),
    (["vien_dinh_duong"], "url", "contains", [
        "/about/", "/cong-cu-va-tien-ich/", "/hop-tac-quoc-te", "/chuc-nang-nhiem-vu", "/gioi-thieu", "/mang-noi-bo", "/question/", "/site-map",
        "/sitemap", "/trang-chu",
    ]),
    (["vien_dinh_duong"], "spaced", "contains", [
        "hợp tác quốc tế", "hop tac quoc te", "các văn bản chỉ đạo điều hành", "cac van ban chi dao dieu hanh", "chỉ đạo tuyến", "chi dao tuyen",
        "chức năng nhiệm vụ", "chuc nang nhiem vu", "dinh dưỡng học đường", "dinh duong hoc duong", "giao dục truyền thông dinh dưỡng",
        "giao duc truyen thong dinh duong", "mạng nội bộ", "mang noi bo", "ngày vi chất dinh dưỡng", "ngay vi chat dinh duong",
        "những lời khuyên dinh dưỡng", "nhung loi khuyen dinh duong", "phổ biến kiến thức dinh dưỡng", "pho bien kien thuc dinh duong", "site map",
        "tài liệu truyền thông", "tai lieu truyen thong", "tin tức sự kiện liên quan", "tin tuc su kien lien quan", "tin tức về đào tạo",
        "tin tuc ve dao tao", "tuần lễ dinh dưỡng và phát triển", "tuan le dinh duong va phat trien", "giới thiệu", "gioi thieu",
        "đội ngũ lãnh đạo", "doi ngu lanh dao", "sơ đồ tổ chức", "so do to chuc", "tra cứu", "tra cuu", "hỏi đáp", "hoi dap", "search",
    ]),
]
SUFFIXES = [".html", ".htm", ".xml", ".pdf", ".txt", ".md", ".csv", ".json", ".jsonl", ".doc", ".docx", ".xls", ".xlsx"]
TEXT_CLASSES = ["txt", "md", "csv", "jsonl", "json"]
PROCESSED_CLASSES = ["html", "html_book", "xml", "pdf", *TEXT_CLASSES]
PROCESSED_STRATEGIES = ["html_text", "xml_text", "digital_pdf_text", "universal_loader"]
OFFICE_SUFFIXES = [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"]
DEFERRED_CLASSES = ["image", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "binary"]
BOOTSTRAPPED = "bootstrapped_from_existing_raw"
LEAST_PAGE_TEXT = 120
# ----------------------------------------------------------------------------


# ------------------------------------------------------------------ pages
def page_rules(spark: SparkSession, rules: list = PAGE_RULES) -> DataFrame:
    """(source_id, rules): the filter as a table, one row a source; it has as many rows as sources with rules, so it may be broadcast."""
    rows = [(s, field, kind, tokens) for sources, field, kind, tokens in rules for s in sources]
    return spark.createDataFrame(rows, "source_id string, field string, kind string, tokens array<string>").groupBy("source_id").agg(F.collect_list(F.struct("field", "kind", "tokens")).alias("rules"))


def page_fields(url: Column, title: Column) -> Column:
    """What rules look at, by name: each field has one or more values."""
    u, t = F.lower(blank(url)), F.lower(blank(title))
    path = F.regexp_extract(u, r"^(?:[a-z][-+.\w]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    tail = F.regexp_extract(path, r"/professional-activities/(.*)$", 1)
    activity = F.when(F.contains(u, F.lit("/professional-activities/")) & (tail != "") & ~F.contains(tail, F.lit("/")) & ~tail.rlike("[a-f0-9]{8,}$"), "unnumbered").otherwise("")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return F.create_map(
        F.lit("url"), F.array(u), F.lit("bare_url"), F.array(bare(u)), F.lit("bare_path"), F.array(bare(path)), F.lit("title"), F.array(t),
        F.lit("spaced"), F.array(t, F.trim(F.replace(t, F.lit("-"), F.lit(" ")))), F.lit("activity"), F.array(activity))


def _holds(rule: Column, fields: Column) -> Column:
    def any_token(test) -> Column:
        return F.exists(F.try_element_at(fields, rule["field"]), lambda v: F.exists(rule["tokens"], lambda t: test(v, t)))

    return (F.when(rule["kind"] == "contains", any_token(lambda v, t: F.contains(v, t))).when(rule["kind"] == "starts", any_token(lambda v, t: F.startswith(v, t)))
            .when(rule["kind"] == "ends", any_token(lambda v, t: F.endswith(v, t))).when(rule["kind"] == "equals", any_token(lambda v, t: v == t))
            .otherwise(~any_token(lambda v, t: F.contains(v, t))))


def filtered_pages(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``rows(source_id, item_url, title_hint, ...)`` plus ``filtered``: a rule of the row's source holds; without rules none does.

    A null address or title is empty; a null source has no rules.
    """
    rules = page_rules(rows.sparkSession) if rules is None else rules
    at = rows.withColumn("__f", page_fields(F.col("item_url"), F.col("title_hint"))).join(F.broadcast(rules.withColumnRenamed("source_id", "__s")), F.col("source_id") == F.col("__s"), "left")
    held = F.coalesce(F.exists("rules", lambda r: _holds(r, F.col("__f"))), F.lit(False))
    return at.withColumn("filtered", held).drop("__f", "__s", "rules")


# ------------------------------------------------------------------ states
def unique_assets(manifest: DataFrame) -> DataFrame:
    """The last row of each path, by ``position``; rows without a path don't count."""
    path = F.trim(blank(F.col("relative_path")))
    names = [c for c in manifest.columns if c != "relative_path"]
    return manifest.where(path != "").groupBy(path.alias("relative_path")).agg(F.max_by(F.struct(*names), "position").alias("__r"), F.min("position").alias("__first")).select("relative_path", "__r.*", "__first")


def _stem() -> Column:
    return processed_stem(F.col("relative_path"), F.col("content_class"), SUFFIXES)


def _can_be_processed() -> Column:
    return F.coalesce(F.col("content_class").isin(PROCESSED_CLASSES) | F.trim(blank(F.col("extract_strategy"))).isin(PROCESSED_STRATEGIES), F.lit(False))


def reconcile(manifest: DataFrame, assets: DataFrame, outputs: DataFrame, prior: DataFrame, quarantine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(manifest, outputs) after both are brought in line with what exists.

    ``manifest(position, relative_path, content_class, extract_strategy,
    extract_status, item_url, file_url, notes)``; ``assets(relative_path)`` exist;
    ``outputs(stem)`` are there now, ``prior(stem, legacy)`` once were, in the
    legacy folder or among the stale ones. Rows are taken path by path in order;
    a stem counts as done at a row if a row before it stays done, or it or a
    later one still is. That needs two figures a stem (the first place that
    stays, the last that is done), so no stem's rows come together.

    The manifest comes back with new ``extract_strategy`` and ``extract_status``
    for all rows of a path, ``outputs(stem, state)`` with ``kept``,
    ``restored``, ``deleted`` or ``quarantined``. Equal inputs give equal results.
    """
    rows = unique_assets(manifest).withColumn("stem", _stem())
    there = assets.select(F.trim("relative_path").alias("relative_path")).distinct().withColumn("exists", F.lit(True))
    have = outputs.select("stem").distinct().withColumn("has_output", F.lit(True))
    once = prior.groupBy("stem").agg(F.max("legacy").alias("legacy"), F.lit(True).alias("once"))
    state = F.trim(blank(F.col("extract_status")))
    at = rows.join(there, "relative_path", "left").join(have, "stem", "left").join(once, "stem", "left")
    at = at.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("exists", "has_output", "legacy", "once")} | {"was": state})
    done, back = F.col("was") == "done", F.col("has_output") | F.col("once")
    by = at.groupBy("stem").agg(F.min(F.when(done & F.col("exists") & back, F.col("__first"))).alias("__stays"), F.max(F.when(done, F.col("__first"))).alias("__last"))
    # a stem with a done row gets back what it once had, before any row is looked at
    back_now = F.col("once") & ~F.col("has_output") & F.col("__last").isNotNull()
    at = at.join(by, "stem").withColumn("__back", back_now).withColumn("sibling", F.coalesce(F.col("__stays") < F.col("__first"), F.lit(False)) | F.coalesce(F.col("__last") >= F.col("__first"), F.lit(False)))
    lost = F.contains(blank(F.col("notes")), F.lit(BOOTSTRAPPED)) & (F.trim(blank(F.col("item_url"))) == "") & (F.trim(blank(F.col("file_url"))) == "")
    gone, sibling = ~F.col("exists"), F.col("sibling")
    revived = F.when(_can_be_processed(), "pending").otherwise("deferred")
    after = F.when(F.col("was") == "missing_asset", revived).otherwise(F.col("was"))
    status = (F.when(gone, F.when(sibling | lost, "deferred").otherwise("missing_asset"))
              .when(done & ~back, "pending").otherwise(after))
    usual = F.coalesce("extract_strategy", F.lit("backlog"))
    strategy = F.when(gone & sibling, "stale_sibling_backlog").when(gone & lost, "legacy_missing_backlog").when(status != F.col("was"), usual).otherwise(F.col("extract_strategy"))
    status = F.when(status == F.col("was"), F.col("extract_status")).otherwise(status)
    # outputs that a row gives up: a lost asset without a done sibling, a failed or deferred row likewise
    dropped = (gone & ~sibling & (lost | ~F.col("legacy"))) | (~gone & after.isin("failed", "deferred") & (F.col("has_output") | F.col("__back")) & ~sibling)
    told = at.select("relative_path", "stem", strategy.alias("__strategy"), status.alias("__status"), dropped.alias("__dropped"), F.col("__back").alias("__restored"))
    changed = manifest.withColumn("__p", F.trim(blank(F.col("relative_path")))).join(told.select(F.col("relative_path").alias("__p"), "__strategy", "__status", F.lit(True).alias("__told")), "__p", "left")
    new = changed.withColumns({"extract_strategy": F.when(F.col("__told"), F.col("__strategy")).otherwise(F.col("extract_strategy")), "extract_status": F.when(F.col("__told"), F.col("__status")).otherwise(F.col("extract_status"))}).select(manifest.columns)
    wanted = told.groupBy("stem").agg(F.max(F.trim(blank(F.col("__status"))) == "done").alias("done"), F.max("__dropped").alias("dropped"), F.max("__restored").alias("restored"))
    every = have.join(wanted, "stem", "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_output", "done", "dropped", "restored")}).where("has_output or restored")
    fate = (F.when(F.col("dropped"), "deleted").when(~F.col("done") & F.lit(quarantine), "quarantined").when(F.col("restored"), "restored").otherwise("kept"))
    return new, every.select("stem", fate.alias("state"))


def extraction_step(rows: DataFrame, force: bool = False) -> DataFrame:
    """``rows`` plus ``action``, ``new_strategy`` and ``new_status``: what one run of the extraction makes of each asset.

    ``rows(content_class, extension, extract_strategy, extract_status, exists,
    has_output, filtered, text_chars, pdf_action, pdf_strategy)``: whether asset
    and output exist, the page filter's verdict, the length of what the asset's
    text would be (null: none) and the profile of a PDF (process, defer, fail).
    ``action`` is skip, drop (the output, if no other row has it) or write.
    """
    c = lambda n: F.col(n)
    status, kind, ext = F.trim(blank(c("extract_status"))), blank(c("content_class")), F.lower(F.trim(blank(c("extension"))))
    usual, chars = F.coalesce("extract_strategy", F.lit("backlog")), F.coalesce("text_chars", F.lit(0))
    to = lambda action, strategy, state: F.struct(F.lit(action).alias("action"), (strategy if isinstance(strategy, Column) else F.lit(strategy)).alias("new_strategy"), F.lit(state).alias("new_status"))
    skip = F.struct(F.lit("skip").alias("action"), c("extract_strategy").alias("new_strategy"), c("extract_status").alias("new_status"))
    table = (
        F.when(F.lit(not force) & (status == "done") & c("has_output"), skip)
        .when((status == "deferred") & ~c("exists"), skip)
        .when(~c("exists"), to("drop", usual, "missing_asset"))
        .when(ext.isin(OFFICE_SUFFIXES), to("drop", "office_backlog", "deferred"))
        .when(kind.isin(DEFERRED_CLASSES), to("drop", usual, "deferred"))
        .when(kind.isin("html", "html_book"), F.when(F.coalesce("filtered", F.lit(False)), to("drop", "html_filtered", "deferred"))
              .when(chars < LEAST_PAGE_TEXT, to("drop", "html_text", "failed")).otherwise(to("write", "html_text", "done")))
        .when(kind == "xml", F.when(~ext.isin("", ".xml"), to("drop", "misclassified_non_xml", "deferred")).otherwise(to("write", "xml_text", "done")))
        .when(kind == "pdf", F.when(c("pdf_action") == "process", F.when(c("text_chars").isNull(), to("drop", "digital_pdf_text", "failed")).otherwise(to("write", c("pdf_strategy"), "done")))
              .when(c("pdf_action") == "defer", to("drop", c("pdf_strategy"), "deferred")).otherwise(to("drop", "classify_pdf", "failed")))
        .when(kind.isin(TEXT_CLASSES), to("write", "universal_loader", "done"))
        .otherwise(to("drop", usual, "deferred")))
    return rows.withColumn("__x", table).select(*[F.col(f"`{x}`") for x in rows.columns], "__x.*")


def extract_report(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row of counts over the unique assets and the outputs, in one pass over each."""
    have = outputs.select("stem").distinct().withColumn("has_output", F.lit(True))
    at = unique_assets(manifest).withColumn("stem", _stem()).join(have, "stem", "left")
    s, how, out = F.trim(blank(F.col("extract_status"))), F.trim(blank(F.col("extract_strategy"))), F.coalesce("has_output", F.lit(False))
    rules = {
        "processed": (s == "done") & out, "failed": s == "failed", "missing_assets": s == "missing_asset", "deferred": s == "deferred",
        "pending": (s == "pending") | ((s == "done") & ~out), "digital_pdfs": (s == "done") & out & (how == "digital_pdf_text"),
        "scanned_pdfs": (s == "deferred") & how.isin("ocr_backlog", "long_pdf_book_ocr"), "long_pdf_books": how.isin("long_pdf_book", "long_pdf_book_ocr"),
        "image_like_pdfs": how == "image_pdf_backlog",
    }
    counts = at.agg(F.count(F.lit(1)).alias("unique_assets"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.select("*", have.agg(F.count(F.lit(1))).scalar().alias("processed_files"))
