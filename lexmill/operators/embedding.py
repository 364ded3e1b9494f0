"""Embedding jobs: a deterministic vectoriser, batches of vectors with their manifest, and audits of what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, let

DIM = 256
MODEL = "hashing-words"


def hashed_words(text: Column, dim: int = DIM) -> Column:
    """(place, value) of a text's vector, by place: words are counted at the place that their MD5 gives, with the sign that it gives.

    Words are runs of letters, marks, digits and underscores in lower case. A
    text without words has no entry. Entries are scaled to length one, unless
    all signs cancel.
    """
    words = F.regexp_extract_all(F.lower(blank(text)), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)
    spot = F.transform(words, lambda w: F.md5(w))
    signed = F.transform(spot, lambda h: F.struct((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("at"), F.when(F.substring(h, 9, 1) < "8", 1.0).otherwise(-1.0).alias("v")))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("v"), F.array().cast("array<struct<place:int,value:double>>").alias("done"))
    now = lambda a: F.when((a["at"] >= 0) & (a["v"] != 0), F.concat(a["done"], F.array(F.struct(a["at"].alias("place"), a["v"].alias("value"))))).otherwise(a["done"])

    def add(a: Column, x: Column) -> Column:
        return F.when(a["at"] == x["at"], F.struct(a["at"].alias("at"), (a["v"] + x["v"]).alias("v"), a["done"].alias("done"))).otherwise(F.struct(x["at"].alias("at"), x["v"].alias("v"), now(a).alias("done")))

    summed = F.aggregate(F.array_sort(signed), start, add, now)  # equal places stand side by side; at most ``dim`` entries grow
    length = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x["value"] * x["value"]))
    return let(summed, lambda e: let(length(e), lambda n: F.transform(e, lambda x: F.struct(x["place"].alias("place"), (x["value"] / n).alias("value")))))


def dense(entries: Column, dim: int = DIM) -> Column:
    """The whole vector of ``hashed_words``, as floats."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def fill(e: Column) -> Column:
        gap = lambda x, i: x["place"] - F.coalesce(F.get(e, i - 1)["place"], F.lit(-1)) - 1
        parts = F.transform(e, lambda x, i: F.concat(zeros(gap(x, i)), F.array(x["value"])))
        tail = zeros(dim - 1 - F.coalesce(F.get(e, F.size(e) - 1)["place"], F.lit(-1)))
        return F.transform(F.concat(F.flatten(parts), tail), lambda x: x.cast("float"))

    return let(entries, fill)


def embed(rows: DataFrame, ids: str, text: str, dim: int = DIM) -> DataFrame:
    """(ids, vector) for each row; a null or empty text has the zero vector. Another vectoriser is another function of this shape."""
    return rows.select(F.col(ids), dense(hashed_words(F.col(text), dim), dim).alias("vector"))


def manifest_of(vectors: DataFrame, ids: str, model: str = MODEL) -> DataFrame:
    """One row on a set of vectors: model, count, least and greatest dimension, distinct ids, a checksum of the ids in any order, vectors that aren't of length one or zero, and non-finite ones."""
    n = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    key = F.xxhash64(F.col(ids).cast("string"))
    return vectors.agg(
        F.lit(model).alias("model_name"), F.count(F.lit(1)).alias("chunk_count"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"),
        F.countDistinct(F.col(ids)).alias("distinct_ids"), F.bit_xor(key).alias("ids_checksum"),
        F.count_if((F.abs(F.sqrt(n) - 1) > 1e-3) & (n > 0)).alias("not_normalised"), F.count_if(n.isNull() | F.isnan(n)).alias("not_finite"))


def write_batches(vectors: DataFrame, folder: str, ids: str, model: str = MODEL, files: int | None = None) -> None:
    """The vectors and their manifest under ``folder``, each by Spark's commit protocol, the manifest last."""
    (vectors.repartition(files) if files else vectors).write.parquet(f"{folder}/vectors")
    manifest_of(vectors.sparkSession.read.parquet(f"{folder}/vectors"), ids, model).coalesce(1).write.parquet(f"{folder}/manifest")


def finalise(spark: SparkSession, folder: str, ids: str, expected_dim: int | None = None) -> dict:
    """Checks what ``write_batches`` left: dimension, count and ids against the manifest; raises ``ValueError``, else returns the manifest."""
    told = spark.read.parquet(f"{folder}/manifest").first().asDict()
    found = manifest_of(spark.read.parquet(f"{folder}/vectors"), ids, told["model_name"]).first().asDict()
    if expected_dim and found["chunk_count"] and not found["least_dim"] == found["most_dim"] == expected_dim:
        raise ValueError(f"vectors of {found['least_dim']} to {found['most_dim']} numbers, expected {expected_dim}")
    if found["distinct_ids"] != found["chunk_count"]:
        raise ValueError(f"{found['chunk_count']} vectors, {found['distinct_ids']} ids")
    if wrong := [k for k in told if told[k] != found[k]]:
        raise ValueError(f"the manifest differs from the vectors: {', '.join(wrong)}")
    return found


def alignment(vectors: DataFrame, texts: DataFrame, metadata: DataFrame, ids: str) -> DataFrame:
    """One row on how vectors, texts and metadata belong together: distinct ids of each, vectors without a text or metadata, either without a vector.

    Null ids belong to nothing. Ids are made distinct before the full outer joins, so repeated rows don't multiply.
    """
    have = lambda df, name: df.where(F.col(ids).isNotNull()).select(F.col(ids).alias("__id")).distinct().withColumn(name, F.lit(True))
    at = have(vectors, "v").join(have(texts, "t"), "__id", "full").join(have(metadata, "m"), "__id", "full")
    v, t, m = (F.col(x).isNotNull() for x in "vtm")
    rules = {"vectors": v, "texts": t, "metadata": m, "missing_text": v & ~t, "missing_metadata": v & ~m, "text_without_vector": t & ~v, "metadata_without_vector": m & ~v}
    return at.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def load_points(vectors: DataFrame, texts: DataFrame, metadata: DataFrame, ids: str, dim: int) -> DataFrame:
    """``metadata`` joined with text and vector; raises ``ValueError`` if a vector lacks a text or metadata, or has another dimension."""
    a = alignment(vectors, texts, metadata, ids).first()
    if a.missing_text or a.missing_metadata:
        raise ValueError(f"vectors without a text: {a.missing_text}, without metadata: {a.missing_metadata}")
    if other := vectors.where((F.size("vector") != dim) | F.col("vector").isNull()).count():
        raise ValueError(f"{other} vectors don't have {dim} numbers")
    return metadata.join(texts, ids).join(vectors, ids)
