"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. The minimiser of a window is its
least hashed word triple; consecutive windows with one minimiser travel as one
packed string to the minimiser's bucket. Equal windows have equal minimisers,
so a bucket sees every occurrence of each of its windows: it sorts them,
compares their words byte by byte and marks all but the first. Word triples
instead of words keep frequent words from filling a bucket, and a task sends
only the first of equal strings it meets, so a passage or document copied any
number of times costs one string per map task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import column, key_of, lean, mix, packed, parts, runs, shuffle_partitions, word_bounds, word_hashes

#: Bytes of distinct packed strings that a map task holds before it sends them on.
HOLD_BYTES = 24 << 20
#: Places of repeated strings that it holds, some 200 bytes each.
HOLD_LATE = 25_000
#: Text bytes that a task looks at in one step, some 60 bytes each.
PART_BYTES = 1 << 18
_MM = 3
_PACKED = "bucket int, docs binary, marks binary, starts binary, ends binary, words binary"
_SPANS = "__d long, __m long, __s int, __e int"


def _pack(window: int, buckets: int):
    def row(bucket: int, entries: list[tuple], strings: list[bytes] | None) -> tuple:
        a = np.array(entries, np.int64).reshape(-1, 4)
        return (
            int(bucket), a[:, 0].tobytes(), a[:, 1].tobytes(), a[:, 2].astype(np.int32).tobytes(), a[:, 3].astype(np.int32).tobytes(),
            None if strings is None else zstandard.ZstdCompressor(level=3).compress(b"\n".join(strings)),
        )

    def flush(seen: dict, again: list, late: list) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PACKED.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 5

        def rows() -> Iterator[tuple]:
            for i in range(0, len(late), 4096):
                yield row((late[i][0] + i) % buckets, late[i : i + 4096], None)
            sent = sorted([*seen.items(), *again], key=lambda x: x[1][4])
            for _, same in groupby(sent, key=lambda x: x[1][4]):
                same = list(same)
                yield row(same[0][1][4], [x[:4] for _, x in same], [w for w, _ in same])

        for part in batched(rows(), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        again: list[tuple] = []
        late: list[tuple] = []
        held = 0
        for batch in batches:
            docs, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, texts in parts(batch.column(2), PART_BYTES):
                plain = [b" ".join(t.split()) for t in texts]
                whole = b"\n".join(plain)
                buf = np.frombuffer(whole, np.uint8)
                starts, ends = word_bounds(buf)
                if len(starts) < window:
                    continue
                offsets = np.cumsum([0] + [len(t) + 1 for t in plain])
                first = np.searchsorted(starts, offsets)
                wh = word_hashes(buf, starts, ends)
                g = wh[: 1 - _MM].copy()
                for j in range(1, _MM):
                    g = mix(g + wh[j : len(wh) - _MM + 1 + j])
                span, low = 1, g
                need = window - _MM + 1
                while span * 2 <= need:
                    low = np.minimum(low[: len(low) - span], low[span:])
                    span *= 2
                if span < need:
                    low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                n = len(low)
                ok = doc[:n] == doc[window - 1 : window - 1 + n]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                cut = np.concatenate(([True], (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])))
                a = at[cut]
                z = np.append(at[np.flatnonzero(cut)[1:] - 1], at[-1]) + window
                where = doc[a]
                for s, e, d, p, q, b in zip(
                    starts[a].tolist(), ends[z - 1].tolist(), where.tolist(), (a - first[where]).tolist(), (z - first[where]).tolist(),
                    (low[a] % np.uint64(buckets)).tolist(), strict=True,
                ):
                    words, x = whole[s:e], (docs[lo + d], marks[lo + d], p, q, b)
                    old = seen.get(words)
                    if old is None:
                        seen[words] = x
                        held += e - s + 160
                    elif (x[0], x[2]) > (old[0], old[2]):
                        late.append(x[:4])
                    elif (x[0], x[2]) < (old[0], old[2]):
                        seen[words] = x
                        late.append(old[:4])
                    elif x != old:
                        again.append((words, x))
                        held += e - s + 160
                if len(late) > HOLD_LATE:
                    yield from flush({}, [], late)
                    late = []
                if held > HOLD_BYTES:
                    yield from flush(seen, again, late)
                    seen, again, late, held = {}, [], [], 0
        yield from flush(seen, again, late)

    return run


def _later(docs, marks, starts, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in a bucket, those whose words also start earlier: doc, mark, start."""
    whole = b"\n".join(words)
    buf = np.frombuffer(whole, np.uint8)
    ws, we = word_bounds(buf)
    offsets = np.cumsum([0] + [len(t) + 1 for t in words])
    first = np.searchsorted(ws, offsets)
    counts = np.diff(first)
    h = word_hashes(buf, ws, we)
    span, value, done = 1, h, {1: h}
    while span * 2 <= window:
        value = mix(value[: len(value) - span] * np.uint64(0x9FB21C651E98DF25) + value[span:])
        span *= 2
        done[span] = value
    total, left = value, window - span
    at = span
    for size in sorted(done, reverse=True):
        while left >= size:
            part = done[size][at:]
            total = mix(total[: len(part)] * np.uint64(0x9FB21C651E98DF25) + part[: len(total)])
            at, left = at + size, left - size
    which = np.repeat(np.arange(len(words)), np.maximum(counts - window + 1, 0))
    begin = np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0)
    i = np.arange(len(which)) - begin[which] + first[which]
    d, m, p = docs[which], marks[which], starts[which] + (i - first[which])
    order = np.argsort(total[i], kind="stable")
    lo, hi = runs(total[i][order])
    many = hi - lo > 1
    pick = order[np.repeat(many, hi - lo)]
    if not len(pick):
        return d[:0], m[:0], p[:0]
    pick = pick[np.lexsort((p[pick], d[pick], total[i[pick]]))]
    lo, hi = runs(total[i[pick]])
    head = pick[np.repeat(lo, hi - lo)]
    same = np.fromiter(
        (whole[a:b] == whole[x:y] for a, b, x, y in zip(
            ws[i[pick]].tolist(), we[i[pick] + window - 1].tolist(), ws[i[head]].tolist(), we[i[head] + window - 1].tolist(), strict=True)),
        bool, len(pick),
    )
    later = (d[pick] != d[head]) | (p[pick] != p[head])
    if not same.all():  # two sequences with one hash: tell their words apart
        earliest: dict[bytes, tuple] = {}
        bad = np.isin(total[i[pick]], total[i[pick[~same]]])
        for k in np.flatnonzero(bad):
            j = pick[k]
            t = whole[ws[i[j]] : we[i[j] + window - 1]]
            o = earliest.setdefault(t, (d[j], p[j]))
            later[k] = o != (d[j], p[j])
    pick = pick[later]
    return d[pick], m[pick], p[pick]


def _resolve(window: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in _SPANS.split(", ")]

    def out(d, m, s, e) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(d), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000], t) for x, t in zip((d, m, s, e), kinds, strict=True)], names)

    def bucket(parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        docs, marks, starts = (np.concatenate([np.frombuffer(x[j], t) for x in parts]) for j, t in ((0, np.int64), (1, np.int64), (2, np.int32)))
        z = zstandard.ZstdDecompressor()
        words = [w for x in parts for w in z.decompress(x[3]).split(b"\n")]
        d, m, p = _later(docs, marks, starts, words, window)
        if not len(d):
            return
        o = np.lexsort((p, m, d))
        d, m, p = d[o], m[o], p[o]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] > p[:-1] + window)))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(d)) - 1
        yield from out(d[a], m[a], p[a], p[b] + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for b, d, m, s, e, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w is None:
                    yield from out(np.frombuffer(d, np.int64), np.frombuffer(m, np.int64), np.frombuffer(s, np.int32), np.frombuffer(e, np.int32))
                    continue
                if b != now:
                    yield from bucket(parts)
                    now, parts = b, []
                parts.append((d, m, s, w))
        yield from bucket(parts)

    return run


def _keep(at: int):
    """``at``: the place of the text in ``r``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in parts(batch.column(0).field(at), PART_BYTES):
                total, gone, kept = [], [], []
                for t, sp in zip(texts, batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    words = t.split()
                    total.append(len(words))
                    if not sp:
                        gone.append(0)
                        kept.append(b" ".join(words).decode())
                        continue
                    drop = np.zeros(len(words) + 1, np.int32)
                    for x in sp:
                        drop[x["__s"]] += 1
                        drop[x["__e"]] -= 1
                    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
                    gone.append(len(words) - len(stay))
                    kept.append(b" ".join([words[i] for i in stay]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["r", "n", "g", "k"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Every row of ``docs`` plus ``__n`` (words), ``__r`` (words removed) and ``__kept`` (the rest, joined by one space).

    A word goes if a window that covers it also starts earlier: in a smaller id,
    or in the same one at an earlier word. A null text has no words; texts of
    fewer than ``window`` words lose none. Ids are integers; a null id counts as
    the least. Rows that share an id are one document for the order, and equal
    rows get equal results. An empty table gives an empty result; other columns
    pass through, one with an output's name with ``_input`` behind it.
    """
    if window < _MM:
        raise ValueError(f"window must be {_MM} or more")
    spark = docs.sparkSession
    names = ["__n", "__r", "__kept"]
    text = column(text_col)
    keyed = docs.select(packed(docs.columns, names), key_of(id_col).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("m"), text.alias("t"))
    buckets = 8 * shuffle_partitions(spark)
    strings = keyed.select("d", "m", "t").mapInArrow(lean(_pack(window, buckets)), _PACKED)
    spans = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_resolve(window)), _SPANS)
    gone = spans.groupBy(F.col("__d").alias("d"), F.col("__m").alias("m")).agg(F.collect_list(F.struct("__s", "__e")).alias("spans"))
    both = keyed.select("r", "d", "m").join(gone, ["d", "m"], "left").select("r", "spans")
    schema = D.StructType([both.schema["r"], *D.StructType.fromDDL("n long, g long, k string").fields])
    out = both.mapInArrow(lean(_keep(docs.columns.index(text_col))), schema)
    return out.select("r.*", F.col("n").alias("__n"), F.col("g").alias("__r"), F.col("k").alias("__kept"))
