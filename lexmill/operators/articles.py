"""Article groups of retrieved chunks: keys, support, representative metadata, selection reasons, expansion of the primary article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import weak_title
from ..functions.ranking import keywords, words
from ..functions.text import acronyms, blank, estimate_tokens, let, stable_text_hash, title_norm
from .lineage import kept


def group_key(chunk_id: Column, title: Column, source: Column, url: Column, article_id: Column, doc_id: Column) -> Column:
    """The article that a chunk belongs to: by article, by title for parts of old issues, by document, by title, or none."""
    t, s = title_norm(title), title_norm(source)
    article, doc = F.trim(blank(article_id)), F.trim(blank(doc_id))
    legacy = (t != "") & ~weak_title(title) & F.contains(blank(url), F.lit("/issue/view/"))
    return (F.when(article != "", F.concat(F.lit("article:"), article))
            .when(legacy, F.concat(F.lit("legacy-title:"), F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), t))
            .when(doc != "", F.concat(F.lit("doc:"), doc)).when(t != "", F.concat(F.lit("title:"), t))
            .otherwise(F.concat(F.lit("_unknown_"), F.substring(chunk_id, 1, 8))))


def metadata_of(title: Column, chunks: Column) -> Column:
    """An article's title and six fields of each of its chunks in one text."""
    fields = ["title", "section_title", "heading_path", "canonical_title", "source_id", "institution"]
    every = F.concat(F.array(blank(title)), F.flatten(F.transform(chunks, lambda c: F.array(*[blank(c[f]) for f in fields]))))
    return F.array_join(F.filter(every, lambda x: x != ""), " ")


def support_text(title: Column, chunks: Column) -> Column:
    """That and the first 500 signs of the first two chunks."""
    every = F.concat(F.array(metadata_of(title, chunks)), F.transform(F.slice(chunks, 1, 2), lambda c: F.substring(blank(c["text"]), 1, 500)))
    return F.array_join(F.filter(every, lambda x: x != ""), " ")


def support_terms(query: Column, support: Column) -> Column:
    """The question's keywords that an article's support text has."""
    return F.array_intersect(keywords(query), keywords(support))


def acronym_matches(text: Column, short: Column) -> Column:
    """How many acronyms a text has as whole words."""
    return let(words(title_norm(text)), lambda w: F.size(F.filter(short, lambda a: F.contains(w, F.concat(F.lit(" "), a, F.lit(" "))))))


def representative(chunks: Column) -> Column:
    """The first chunk that has a trust tier or a document type, else the first."""
    good = F.filter(chunks, lambda c: c["trust_tier"].isNotNull() | (blank(c["doc_type"]) != ""))
    return F.coalesce(F.get(good, F.lit(0)), F.get(chunks, F.lit(0)))


def selected_reason(chunk: Column, primary: Column, mode: Column, relevance: Column, authority: Column, fit: Column, support: Column) -> Column:
    """Why an article was selected, in words."""
    return F.concat_ws(
        "; ", F.when(primary, F.when(mode == "anchor", "article-centric retrieval anchor").otherwise("highest composite score")).otherwise("supporting source"),
        F.when(chunk["trust_tier"] == 1, "authoritative source (Tier 1)"), F.when(blank(chunk["doc_type"]) != "", F.concat(F.lit("type="), chunk["doc_type"])),
        F.concat(F.lit("relevance="), relevance.cast("string")), F.when(authority > 0, F.concat(F.lit("authority=+"), authority.cast("string"))),
        F.when(fit > 0, F.concat(F.lit("query_fit=+"), fit.cast("string"))), F.when(support > 0, F.concat(F.lit("support_terms="), support.cast("string"))))


def adds_support(query: Column, mode: Column, query_type: Column, own: Column, primary: Column) -> Column:
    """a secondary article adds to the primary one; ``own`` and ``primary`` are support texts."""
    asked = (mode == "topic_summary") | (query_type == "comparative_synthesis")
    mine, theirs, short = support_terms(query, own), support_terms(query, primary), acronyms(query)
    more = (F.size(short) > 0) & (acronym_matches(own, short) > acronym_matches(primary, short))
    return ~asked | ((F.size(mine) > 0) & ((F.size(F.array_except(mine, theirs)) > 0) | more))


def _ids(chunks: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(chunks, lambda c: F.trim(blank(c[field]))), lambda x: x != "")))


def same_article(title: Column, chunks: Column, primary_title: Column, primary_chunks: Column) -> Column:
    """two groups are one article: equal titles, or equal sets of document or of article ids."""
    def equal(field: str) -> Column:
        return (F.size(_ids(chunks, field)) > 0) & (_ids(chunks, field) == _ids(primary_chunks, field))

    return ((blank(title) != "") & (title == primary_title)) | equal("doc_id") | equal("article_id")


def with_previous(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` plus, under each new name, a column of the row before by ``key``, which is unique; the first row gets nulls.

    Rows are dealt by ranges of the key and kept, so each range is a window of
    its own; its first row takes the last row of the range before, of which
    there is one a range.
    """
    c = F.col
    ranged = kept(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    row = F.struct(*[c(old).alias(new) for new, old in columns.items()])
    own = Window.partitionBy("__p").orderBy(key)
    last = ranged.groupBy("__p").agg(F.max_by(row, key).alias("__last"), F.min(key).alias("__k"))
    # one row a range
    ends = last.select(c("__p").alias("__q"), F.lag("__last").over(Window.orderBy("__k")).alias("__end"))
    at = ranged.withColumn("__prev", F.lag(row).over(own)).join(F.broadcast(ends), c("__p") == c("__q"))
    prev = F.coalesce("__prev", "__end")
    return at.select(*[c(f"`{n}`") for n in df.columns], *[prev[n].alias(n) for n in columns])


def candidate_chunks(candidates: DataFrame, chunks: DataFrame, by: str = "candidate") -> DataFrame:
    """(``by``, chunk_id) of the chunks of each candidate article: by article id, document id, or title and source.

    An OR in a join would compare everything; three equi-joins and a distinct don't.
    """
    got = chunks.select("chunk_id", "article_id", "doc_id", "title", "source_name")
    wanted = candidates.select(by, F.col("article_id").alias("a"), F.col("doc_id").alias("d"), F.col("title").alias("t"), F.col("source_name").alias("s"))
    has = lambda c: blank(F.col(c)) != ""
    one = wanted.where(has("a")).join(got, F.col("a") == F.col("article_id"))
    two = wanted.where(has("d")).join(got, F.col("d") == F.col("doc_id"))
    three = wanted.where(has("t")).join(got, (F.col("t") == F.col("title")) & (~has("s") | (F.col("s") == F.col("source_name"))))
    return one.select(by, "chunk_id").union(two.select(by, "chunk_id")).union(three.select(by, "chunk_id")).distinct()


def identity_chunks(wanted: DataFrame, chunks: DataFrame, by: str = "candidate") -> DataFrame:
    """(``by``, chunk_id, rung): a candidate's chunks by the first rung that has any: article id, document id, title and source, title alone."""
    got = chunks.select("chunk_id", "article_id", "doc_id", "title", "source_name")
    at = wanted.select(by, F.col("article_id").alias("a"), F.col("doc_id").alias("d"), F.col("title").alias("t"), F.col("source_name").alias("s"))
    has = lambda c: blank(F.col(c)) != ""
    rungs = [(has("a"), F.col("a") == F.col("article_id")), (has("d"), F.col("d") == F.col("doc_id")),
             (has("t") & has("s"), (F.col("t") == F.col("title")) & (F.col("s") == F.col("source_name"))), (has("t"), F.col("t") == F.col("title"))]
    hits = None
    for i, (rule, match) in enumerate(rungs):
        one = at.where(rule).join(got, match).select(by, "chunk_id", F.lit(i).alias("rung"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy(by).agg(F.min("rung").alias("rung"))
    return hits.join(best, [by, "rung"]).select(by, "chunk_id", "rung")


def article_chunks(articles: DataFrame, chunks: DataFrame, bonus: Column, per_article: int = 3, by: str = "query_id") -> DataFrame:
    """For each found article (``by``, article_key, score) its best chunks by ``bonus``, of equal ones the first by id.

    A chunk's score is 0.62 and the article's; the bonus only orders. Chunks without text are left out.
    """
    rows = articles.join(chunks.where(F.trim(blank(F.col("text"))) != ""), "article_key").withColumns({"chunk_rank_score": F.round(0.62 + F.col("score"), 6), "bonus": bonus})
    rank = F.row_number().over(Window.partitionBy(by, "article_key").orderBy(F.desc("bonus"), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_article)


def expand_primary(primary: DataFrame, chunks: DataFrame, bonus: Column, most: int = 8, budget: int = 2400, by: str = "query_id") -> DataFrame:
    """(``by``, kept, used): the primary article's chunks, best first, as many as fit the budget of tokens; one that doesn't fit is skipped.

    ``chunks(article_key, chunk_id, text, score, chunk_index)``, the last two if
    known: those with a score were retrieved and all take part, the others are their siblings and
    take part if they have text that none before them has. The order is bonus,
    score (0 for siblings), the lesser chunk_index, chunk_id. If nothing fits,
    the retrieved chunks are kept as they are. A budget of 0 is none.

    What is skipped once never fits again, as the budget only shrinks; so the
    next chunk to take is the first behind the last one that fits what is left,
    and ``most`` rounds of a join with one row a question and a minimum find
    them all. No article's chunks come together, whatever their number.
    """
    for name, kind in (("score", "double"), ("chunk_index", "int")):
        chunks = chunks if name in chunks.columns else chunks.withColumn(name, F.lit(None).cast(kind))
    own = F.col("score").isNotNull()
    rows = primary.join(chunks, "article_key").withColumns({"__own": own, "__h": stable_text_hash(F.col("text"))}).withColumn("__bonus", bonus)
    key = F.struct((-F.col("__bonus")).alias("bonus"), (-F.coalesce("score", F.lit(0.0))).alias("score"), F.coalesce("chunk_index", F.lit(0)).alias("index"), F.col("chunk_id").cast("string").alias("chunk_id"))
    small = rows.select(by, "__own", "__h", (F.trim(blank(F.col("text"))) == "").alias("__blank"), key.alias("key"), estimate_tokens(F.col("text")).cast("long").alias("n"))
    retrieved = small.where("__own")
    said = retrieved.select(by, "__h").distinct()
    one = F.min(F.struct(F.col("key.index"), F.col("key.chunk_id"), "key", "n")).alias("x")
    siblings = small.where("not __own and not __blank").join(said, [by, "__h"], "left_anti").groupBy(by, "__h").agg(one).select(by, "x.key", "x.n")
    every = kept(retrieved.select(by, "key", "n").unionAll(siblings))
    state = every.groupBy(by).agg(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(None).cast(every.schema["key"].dataType).alias("last"))
    for _ in range(most):
        fits = F.lit(budget == 0) | (F.col("used") + F.col("n") <= budget)
        step = every.join(state.select(by, "used", "last"), by).where(fits & (F.col("last").isNull() | (F.col("key") > F.col("last"))))
        new = step.groupBy(by).agg(F.min(F.struct("key", "n")).alias("x"))
        state = kept(state.join(new, by, "left").select(
            by, (F.col("used") + F.coalesce("x.n", F.lit(0))).alias("used"), F.when(F.col("x").isNull(), F.col("kept")).otherwise(F.concat("kept", F.array("x.key.chunk_id"))).alias("kept"), F.coalesce("x.key", "last").alias("last")))
        if new.isEmpty():
            break
    nothing = state.where(F.size("kept") == 0).select(by)
    whole = retrieved.join(nothing, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("key.index"), F.col("key.chunk_id")))).alias("l"), F.sum("n").alias("n"))
    return state.join(whole, by, "left").select(by, F.when(F.col("l").isNull(), F.col("kept")).otherwise(F.transform("l", lambda x: x["chunk_id"])).alias("kept"), F.coalesce("n", "used").alias("used"))


def multi_axis(hits: DataFrame, budget: int, by: str = "question") -> DataFrame:
    """Hits (``by``, axis, chunk_id, text, score) of a question's sub-queries: each text once, from the first axis that has it and there
    by score, then all by score until the budget is spent.

    Sub-queries and their hits are bounded by the top-k that made them.
    """
    first = F.struct("axis", (-F.col("score")).alias("less"), "chunk_id")
    rows = hits.withColumn("h", stable_text_hash(F.col("text"))).groupBy(by, "h").agg(F.min_by(F.struct("axis", "chunk_id", "text", "score"), first).alias("c")).select(by, "c.*")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "axis", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("n", estimate_tokens(F.col("text"))).withColumn("spent", F.sum("n").over(order))
    return spent.where(F.col("spent") <= budget).select(by, "axis", "chunk_id", "score", "spent")
