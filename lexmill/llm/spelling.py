"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has one bit for each letter of the alphabet, set if the letter
occurs an odd number of times. An inserted or deleted letter flips one bit, a
replaced one flips two, so of three bands of the mask one at least stays equal.
Words meet by equal band and the length of the shorter word; an edit also
leaves the first or the last half of the word untouched, so that half is part
of the key and no band value alone fills a bucket. Candidates differ in at most
two mask bits, meet under one key only, and are then compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, lean, mix, parts

#: Distinct words that a counting task holds before it sends them on.
HOLD_WORDS = 400_000
#: Bytes of one text that are split at a time; a run of letters is never cut.
PIECE = 1 << 20
#: One run in DROP_EVERY loses a letter.
DROP_EVERY = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Forms at least multiply the count by RATIO, so chains of forms are shorter than 2^ROUNDS.
ROUNDS = 6

_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _LETTERS else 0x20 for c in range(256))
_BITS = np.zeros((3, 256), np.int64)
for _i, _c in enumerate(_LETTERS):
    _BITS[_i % 3, _c] = 1 << (_i // 3)


def _pieces(text: bytes) -> Iterator[bytes]:
    lo = 0
    while len(text) - lo > PIECE:
        hi = text.find(b" ", lo + PIECE)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _count(least_length: int, drop_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([seen[w] for w in part], pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in parts(batch.column(1)):
                for i, text in zip(ids[lo:hi], texts, strict=True):
                    head = zlib.crc32(f"{'' if i is None else i}:".encode())
                    folded = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_FOLD)
                    for piece in _pieces(folded):
                        for w, k in Counter(piece.split()).items():
                            if len(w) < least_length:
                                continue
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                            if drop_every and h % drop_every == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least_length:
                                    continue
                            seen[w] = seen.get(w, 0) + k
                        if len(seen) >= HOLD_WORDS:
                            yield from flush()
        yield from flush()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the words of all whole texts and how often they occur, from ``least_count`` on.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, of at
    least ``least_length`` letters. With ``drop_every``, a run whose crc32 of
    ``<id>:<run>`` it divides first loses the letter at crc32 modulo its length.
    A null text has no words; a null id counts as empty; repeated rows count
    each; an empty table gives an empty result. Other columns are not read.
    """
    found = docs.select(column(id_col).cast("string").alias("d"), column(text_col).alias("t")).mapInArrow(lean(_count(least_length, drop_every)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_POSTING = "key long, band int, tail int, longer int, size int, m0 long, m1 long, m2 long, word string"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in _POSTING.split(", ")], [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.string()]
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            texts = whole.column(0).slice(at, 4096)
            words = [w.encode("latin-1") for w in texts.to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            buf, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
            masks = [np.bitwise_xor.reduceat(bits[buf], starts) for bits in _BITS]
            for longer in (0, 1):
                short = sizes - longer
                for tail in (0, 1):
                    half = np.array([xxhash.xxh64_intdigest(w[len(w) - n // 2 :] if tail else w[: n // 2]) for w, n in zip(words, short.tolist(), strict=True)], np.uint64)
                    # between words of unlike length one bit differs, so one of two bands is equal
                    for band in range(3 - longer):
                        key = mix(mix(half + masks[band].astype(np.uint64)) + (short * 8 + tail * 4 + band).astype(np.uint64)).view(np.int64)
                        same = [np.full(len(words), x, np.int32) for x in (band, tail, longer)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([key, *same, sizes, *masks], kinds, strict=False)] + [texts], names)


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(map(_one_edit, batch.column(0).to_pylist(), batch.column(1).to_pylist()), pa.bool_()))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct words of ``words(word)`` that one inserted, deleted or replaced letter tells apart, once.

    ``a`` is the shorter word, or the lesser of two of one length. Words are
    unique and of four or more of the letters above.
    """
    posts = words.select("word").mapInArrow(_post, _POSTING)
    a, b = posts.where("longer = 0").alias("a"), posts.alias("b")
    flipped = sum((F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(3)), F.lit(0))
    bands = [F.col(f"a.m{i}") == F.col(f"b.m{i}") for i in range(3)]
    first_band = F.when(bands[0], 0).when(bands[1], 1).when(bands[2], 2).otherwise(-1)
    half = F.floor(F.col("a.size") / 2).cast("int")
    heads = F.substring(F.col("a.word"), F.lit(1), half) == F.substring(F.col("b.word"), F.lit(1), half)
    ordered = ((F.col("b.longer") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("b.longer") == 1) & (F.col("a.size") + 1 == F.col("b.size")))
    # a pair that meets under several keys counts under the first alone
    once = (F.col("a.band") == first_band) & ((F.col("a.tail") == 0) | ~heads)
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.tail") == F.col("b.tail"))
    return a.join(b, met & ordered & (flipped <= 2) & once).select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).mapInArrow(_verify, "a string, b string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over ``forms(word, form)``."""
    up = cut(forms.select("word", F.col("form").alias("up")))
    for _ in range(ROUNDS):
        x, y = up.alias("x"), up.alias("y")
        jumped = cut(x.join(y, F.col("x.up") == F.col("y.word"), "left").select(F.col("x.word").alias("word"), F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")))
        up = jumped.select("word", "up")
        if jumped.where("moved").isEmpty():
            break
    return up.select("word", F.col("up").alias("root"))


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every word of ``counts(word, n)`` with its form, root and near words.

    A word's form is its near word of the largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``ratio`` (two or more) times its own
    ``n``, else null. ``root`` follows the forms to the last; ``n_near`` counts the near words.
    An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counts = cut(counts.select("word", "n"))
    pairs = near_pairs(counts)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    other = counts.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    told = cut(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
