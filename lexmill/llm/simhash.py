"""SimHash near-dedup with BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a
text's word shingles. Equal fingerprints are one vertex. Two fingerprints
within ``radius`` bits agree on all but ``radius`` of ``radius + 3`` bit
blocks, so each choice of three blocks names a shard and every pair to be
linked meets in one. A shard's task builds a BK-tree of its fingerprints,
children keyed by Hamming distance to the parent, and follows only the edges
within the radius. The shard trees would grow with the corpus if broadcast, so
a shard's queries travel to its tree by the same shuffle instead. A shard
gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import Forest, column, cut, identity, keep_least, key_of, parts
from .components import components

#: Fingerprints in a shard beyond which it is parted by further bits.
SHARD = 2048


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not words:
        return 0
    if len(words) < shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(
            (digest(flat[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
            np.uint64, len(words) - shingle + 1,
        )
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    """The last column's fingerprints in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for _, _, texts in parts(batch.columns[-1]) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*batch.schema.names[:-1], "__fp"])

    return run


def _links(radius: int):
    """Edges of a spanning forest for each shard; shards arrive sorted."""

    def shard(signed: list[int]) -> Iterator[tuple[int, int]]:
        fps = [x & (1 << 64) - 1 for x in signed]
        forest = Forest(len(fps))
        kids: list[dict[int, int]] = [{}]
        for i in range(1, len(fps)):
            x, stack, hang = fps[i], [0], None
            at = 0
            while stack:  # every earlier fingerprint within the radius
                j = stack.pop()
                d = (fps[j] ^ x).bit_count()
                if d <= radius:
                    forest.union(i, j)
                for e in range(max(0, d - radius), d + radius + 1):
                    k = kids[j].get(e)
                    if k is not None:
                        stack.append(k)
            while True:  # then it joins the tree
                d = (fps[at] ^ x).bit_count()
                hang = kids[at].get(d)
                if hang is None:
                    kids[at][d] = i
                    break
                at = hang
            kids.append({})
        last: dict[int, int] = {}
        for i in range(len(fps)):
            r = forest.find(i)
            if r in last:
                yield signed[last[r]], signed[i]
            last[r] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for members in batch.column(0).to_pylist():
                out += shard(members)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _edges(n: int, bits: list[int]) -> list[int]:
    """Masks that deal these bits out to n blocks."""
    cut_at = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[cut_at[i] : cut_at[i + 1]]) for i in range(n)]


def _key(name: int, mask: int) -> F.Column:
    mask = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(name).alias("c"), F.col("__fp").bitwiseAND(F.lit(mask)).alias("v"))


def _shards(radius: int) -> dict[int, int]:
    """Shard number to mask: each choice of three of radius + 3 bit blocks."""
    return {c: sum(x) for c, x in enumerate(combinations(_edges(radius + 3, list(range(64))), 3))}


def _split(radius: int, mask: int) -> list[int]:
    """Masks that part a shard further: of the bits outside it, in radius + 2 blocks, each choice of two."""
    return [sum(x) for x in combinations(_edges(radius + 2, [b for b in range(64) if not mask >> b & 1]), 2)]


def _sharded(reps: DataFrame, radius: int) -> DataFrame:
    """``__members``: the fingerprints of each shard.

    A shard of more than ``SHARD`` fingerprints is parted by further bits, which
    pairs within the radius share as well; what is left then differs in few
    bits, so its size is bounded whatever the corpus.
    """
    masks = _shards(radius)
    placed = reps.select("__fp", F.explode(F.array(*[_key(c, m) for c, m in masks.items()])).alias("__key"))
    hot = cut(placed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("__key"))
    if hot.isEmpty():
        parts_ = placed.withColumn("__sub", F.lit(None).cast("struct<c:int,v:bigint>"))
    else:
        further = F.array().cast("array<struct<c:int,v:bigint>>")
        for c, m in masks.items():
            further = F.when(F.col("__key.c") == c, F.array(*[_key(i, x) for i, x in enumerate(_split(radius, m))])).otherwise(further)
        parts_ = placed.join(hot, "__key", "left_anti").withColumn("__sub", F.lit(None).cast("struct<c:int,v:bigint>")).unionByName(
            placed.join(hot, "__key", "left_semi").withColumn("__sub", F.explode(further)))
    return parts_.groupBy("__key", "__sub").agg(F.collect_list("__fp").alias("__members")).where(F.size("__members") > 1).select("__members")


def _labels(docs: DataFrame, columns: list[F.Column], text_col: str, shingle: int, radius: int) -> DataFrame:
    """``columns`` of each row with its fingerprint ``__fp`` and group ``c``, a fingerprint of the group."""
    plain = docs.select(*columns, column(text_col).alias("__fp"))
    schema = D.StructType([*plain.schema.fields[:-1], D.StructField("__fp", D.LongType())])
    rows = cut(plain.mapInArrow(_fingerprints(shingle), schema))
    found = components(_sharded(rows.select("__fp").distinct(), radius).mapInArrow(_links(radius), "a long, b long"))
    return rows.join(found, rows["__fp"] == found["node"], "left").withColumn("c", F.coalesce("component", "__fp")).drop("node", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(``__id``, ``fingerprint``, ``component_id``) for each row of ``docs``.

    component_id is the least id reachable over links between fingerprints that
    differ in ``radius`` bits or fewer. A null or empty text has fingerprint zero
    and is linked like any other. Ids are integers; a null id stays null in
    ``__id`` and counts as the least long in component_id. Repeated rows give
    repeated results; an empty table gives an empty one. Other columns, whatever
    their names, are not looked at.
    """
    rows = _labels(docs, [key_of(id_col).alias("k")], text_col, shingle, radius)
    least = rows.groupBy("c").agg(F.min("k").alias("component_id"))
    return rows.join(least, "c").select(
        F.when(F.col("k") != -(1 << 63), F.col("k")).alias("__id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id, of several such the one with the least hash of text and columns.

    A row goes only if its group keeps another: rows with a null or a shared id
    but different texts stay unless their fingerprints link. All columns,
    whatever their names, come back as they were; an empty table gives an empty one.
    """
    return keep_least(docs, _labels(docs, identity(docs, id_col, text_col), text_col, shingle, radius), id_col, text_col)
