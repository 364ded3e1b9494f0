"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009..U+000D; every other byte belongs to a word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Same set, as a regular expression for words.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step looks at.
CHUNK_BYTES = 1 << 20
#: Bytes whose words are hashed at a time: a step takes some 30 bytes a byte, and its tables of powers 16.
HASH_BYTES = 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] | None = None
_own_folder: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory, opened by Spark alone (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a session on one machine may lack it (tests): it gets a folder that goes with the process.
    """
    global _own_folder
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept by a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def column(name: str) -> F.Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(names: Iterable[str], outputs: Iterable[str]) -> list[str]:
    """``names``, those that equal an output's name (case ignored) with ``_input`` behind them."""
    names, own = list(names), {o.lower() for o in outputs}
    taken, out = own | {n.lower() for n in names}, []
    for n in names:
        if n.lower() in own:
            n += "_input"
            while n.lower() in taken:
                n += "_"
            taken.add(n.lower())
        out.append(n)
    return out


def packed(names: list[str], outputs: Iterable[str] = ()) -> F.Column:
    """These columns as one struct ``r``, so that no name in it can meet a name of the operator's own."""
    return F.struct(*[column(n).alias(m) for n, m in zip(names, beside(names, outputs), strict=True)]).alias("r")


def row_hash(df: DataFrame) -> F.Column:
    """A hash of a row's values; maps and variants, which have no hash, don't count."""
    return F.xxhash64(*[column(f.name) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))], F.lit(0))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; at its end the worker, which stays for the next stage, gives its free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_sql(text: str) -> str:
    """SQL: the words of a text column as an array (null: empty)."""
    return f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes; a longer text is a range of its own."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > most:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """A string column as ranges (first row, end, texts as UTF-8) of about ``most`` bytes, so that few texts are Python objects at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0))
    lo, n = 0, len(sizes)
    ends = np.cumsum(sizes, dtype=np.int64)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi, utf8(column.slice(lo, hi - lo))
        lo = hi


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer."""
    full = np.concatenate(([False], ~_SPACE[buf], [False]))
    edge = np.flatnonzero(full[1:] != full[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over HASH_BYTES at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_BYTES, side="right")))
        at = starts[lo]
        out[lo:hi] = _hash_words(buf[at : ends[hi - 1]], starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    global _powers
    n = len(buf)
    if _powers is None or len(_powers[0]) < n + 1:
        size = max(n + 1, HASH_BYTES + 1)
        r = 0xD6E8FEB86659FD93
        up, down = np.full(size, np.uint64(r)), np.full(size, np.uint64(pow(r, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MULT
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return at, np.append(at[1:], len(keys))


class Forest:
    """Union-find over small integers; the least member stands for its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def key_of(name: str) -> F.Column:
    """A 64-bit id that stands for null by the least long. Ids are integers; a text that is none fails the cast."""
    return F.coalesce(column(name).cast("long"), F.lit(-(1 << 63)))


def identity(docs: DataFrame, id_col: str, text_col: str) -> list[F.Column]:
    """(k, s, z, o): what tells a row from others: its id, 120 bits of its text's MD5, and a hash of all its columns."""
    digest = F.md5(F.coalesce(column(text_col), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return [key_of(id_col).alias("k"), half(1).alias("s"), half(16).alias("z"), row_hash(docs).alias("o")]


#: Bits of the table that tells which rows may share their label with another.
DOUBT_BITS = 24


def keep_least(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each label ``c`` of ``labelled(k, s, z, o, c)``: the least by id, text and the rest.

    Rows with a null id or a shared one are told apart by their texts; rows that
    are equal in all columns are one. A row that is alone under its label stays
    where it is: a table of 2^DOUBT_BITS bits tells most of them, and only the
    rows that it can't tell, whatever their number, are shuffled and joined.
    """
    key = ["k", "s", "z", "o"]
    labelled = cut(labelled)
    by = cut(labelled.groupBy("c").agg(F.min(F.struct(*key)).alias("w"), F.count(F.lit(1)).alias("n")))
    least = by.select("w.*")
    at = F.pmod(F.xxhash64(*key), F.lit(1 << DOUBT_BITS)) + 1  # buckets of positive numbers start at 1
    bucket, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    shared = labelled.join(by.where("n > 1").select("c"), "c", "left_semi")
    bits = shared.groupBy(bucket.alias("__b")).agg(F.bitmap_construct_agg(bit).alias("__bits"))  # 4 KB a row, 2^DOUBT_BITS bits in all
    rows = docs.select(packed(docs.columns), *identity(docs, id_col, text_col)).withColumn("__b", bucket).withColumn("__at", bit)
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    doubt = F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    told = rows.join(F.broadcast(bits), "__b", "left").withColumn("__doubt", doubt).select("r", *key, "__doubt")
    settled = told.where("__doubt").join(least, key, "left_semi").dropDuplicates(key)
    return told.where("not __doubt").select("r.*").unionAll(settled.select("r.*"))
