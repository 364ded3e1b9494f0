"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

A text's features are its distinct word uni- and bigrams and its distinct word
shape uni-, bi- and trigrams (a shape is a word's first and last byte class,
its last sign and its length class), hashed into one table and scaled to unit
length. Training follows the regularised leader on a bounded sample of
labelled rows in one task; scoring is a sparse dot product per text against
the broadcast table, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import chunks, lean, mix, packed, parts, utf8, word_bounds, word_hashes

#: log2 of the number of weights.
BITS = 18
#: Most labelled rows to train on: those with the least hash of their id.
MOST_ROWS = 6000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.05
#: Least passes over the sample, and least updates: a small sample is gone through more often.
EPOCHS, UPDATES = 3, 9000
_CLASS = np.full(256, 4, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = buf[ends - 1]
    size = np.minimum(ends - starts, 31).astype(np.uint64) // np.uint64(4)
    sign = np.where(_CLASS[last] == 4, last, 0).astype(np.uint64)
    second = _CLASS[buf[np.maximum(ends - 2, starts)]]
    return mix(_CLASS[buf[starts]] + np.uint64(5) * _CLASS[last] + np.uint64(25) * second + np.uint64(125) * size + np.uint64(1000) * sign + np.uint64(1 << 40))


def features(texts: list[bytes], bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text."""
    shift = np.uint64(64 - bits)
    two, three = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
    for lo, hi in chunks(texts):
        buf = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
        starts, ends = word_bounds(buf)
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]]))
        w, s = word_hashes(buf, starts, ends), _shapes(buf, starts, ends)
        pair = mix(w[:-1] * two + w[1:])
        spair = mix(s[:-1] * two + s[1:])
        striple = mix(spair[:-1] * three + s[2:]) if len(s) > 2 else s[:0]
        grams = [(w >> shift, 0), (pair >> shift, 1), (s >> shift, 0), (spair >> shift, 1), (striple >> shift, 2)]
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(np.concatenate([g[a : max(a, b - k)] for g, k in grams])).astype(np.int32)


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates; the last weight is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, grams: np.ndarray, label: int) -> None:
        i = np.append(grams, len(self.z) - 1)
        x = np.full(len(i), 1 / np.sqrt(max(1, len(grams))))
        x[-1] = 1.0
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def score_grams(grams: np.ndarray, w: np.ndarray) -> float:
    x = w[-1] + (w[grams].sum() / np.sqrt(len(grams)) if len(grams) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True)
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    grams, model = list(features([t for _, t, _ in rows])), Ftrl()
    for _ in range(max(EPOCHS, -(-UPDATES // max(1, len(rows))))):
        for g, (_, _, label) in zip(grams, rows, strict=True):
            model.learn(g, label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f8").tobytes()], pa.binary())], ["w"])


def held_out(id_col: str) -> F.Column:
    """Rows that are never trained on: CRC-32 of the id's text divisible by 5 (null as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows that aren't held out, at most ``most_rows`` of them.

    Labels that are null or whose id is null are left out; of several for an id the
    greatest counts. Without any usable row all weights are zero.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    some = known.withColumn("__h", F.md5(F.col("__id").cast("string"))).orderBy("__h").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__t")).join(F.broadcast(some), F.col("__d") == F.col("__id"))
    got = rows.select("__h", "__t", "__y").repartition(1).mapInArrow(_learn, "w binary").collect()
    return np.frombuffer(got[0][0], "<f8") if got else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus a score from 0 to 1 of each whole text, as ``name``; a column of that name comes back as ``<name>_input``.

    Null and empty texts get the bias's score; repeated rows get equal scores; an empty table gives an empty result.
    """
    w = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score_grams(g, w.value) for _, _, texts in parts(b.column(0).field(at)) for g in features(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["r", "s"])

    at = docs.columns.index(text_col)
    rows = docs.select(packed(docs.columns, [name]))
    schema = D.StructType([rows.schema["r"], D.StructField("s", D.DoubleType())])
    return rows.mapInArrow(lean(run), schema).select("r.*", F.col("s").alias(name))
