"""Embedding near-dedup by sorted projection passes.

Each pass gives a vector a key of concatenated random hyperplane signs and
sorts all vectors by it; vectors that are neighbours within a bounded window
are compared exactly, and verified pairs are united across passes. The number
of passes follows from the number of vectors, so that recall at the threshold
stays the same at any size. Where more vectors than the window share a key's
leading signs, as in a cone of vectors, all of that run are compared block by
block, so recall doesn't depend on how the vectors lie either. Groups found this way are then completed: within
each, every vector is compared with every other block by block, so a vector's
links aren't limited by the window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, column, cut, key_of
from .components import components

THRESHOLD = 0.9
#: Neighbours that a vector is compared with on either side.
WINDOW = 64
#: Wanted chance that a pair at the threshold is found.
RECALL = 0.99
#: Vectors in a block when a group is completed, and when a long run is compared.
BLOCK = 512
RUN_BLOCK = 2048
#: Copies of a vector's results that its rows are dealt to.
SALTS = 8
_BITS = 63


def run_bits(n: int, window: int = WINDOW) -> int:
    """Leading signs that leave ``window`` vectors or fewer in a run, if they are spread evenly."""
    return min(_BITS, max(0, math.ceil(math.log2(max(n, 1) / window))))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with chance ``recall`` among n vectors.

    Two vectors share a random sign with chance 1 - angle / pi, and are
    compared if they share the leading signs that make a run.
    """
    same = 1 - math.acos(threshold) / math.pi
    hit = same ** run_bits(n, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - hit)))) if hit < 1 else 4


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as unit vectors in double precision; null what can't be used."""
    for b in batches:
        out: list[bytes | None] = []
        for v in b.column(1).to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            x = x / np.abs(x).max()
            out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "v"])


def _signs(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vs = b.column(1)
            for lo in range(0, len(vs), 2000):
                part, ids = vs.slice(lo, 2000), b.column(0).slice(lo, 2000)
                by: dict[int, list[int]] = {}
                for i, v in enumerate(part.to_pylist()):
                    by.setdefault(len(v) // 8, []).append(i)
                for dim, at in by.items():
                    if dim not in planes:
                        planes[dim] = np.random.default_rng(seed).standard_normal((passes, dim, _BITS))
                    x, own = _matrix(part.take(pa.array(at))), ids.take(pa.array(at))
                    for p in range(passes):
                        key = ((x @ planes[dim][p]) > 0) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), p * 65536 + dim), pa.int64()), pa.array(key, pa.int64()), own, part.take(pa.array(at))], ["p", "key", "id", "v"])

    return run


def _compare(ids: list[int], x: np.ndarray, threshold: float, window: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the verified pairs within the window."""
    n, forest = len(ids), Forest(len(ids))
    for lo in range(0, n, window):
        a, b = x[lo : lo + window], x[lo : lo + 2 * window]
        i, j = np.nonzero(a @ b.T >= threshold)
        ok = (j > i) & (j - i <= window)
        for s, t in zip((i[ok] + lo).tolist(), (j[ok] + lo).tolist(), strict=True):
            forest.union(s, t)
    return _edges(ids, forest)


def _edges(ids: list[int], forest: Forest) -> list[tuple[int, int]]:
    last: dict[int, int] = {}
    out = []
    for i in range(len(ids)):
        r = forest.find(i)
        if r in last:
            out.append((ids[last[r]], ids[i]))
        last[r] = i
    return out


def _windows(threshold: float, window: int):
    """Sorted rows: links inside a task's range, and its first and last rows for the tasks beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        edges: list[tuple[int, int]] = []
        border: list[tuple] = []
        held: list[tuple] = []
        now, seen = None, 0

        def settle(final: bool) -> None:
            nonlocal held
            if held:
                edges.extend(_compare([r[2] for r in held], _rows(held), threshold, window))
            if final:
                border.extend((part, r) for r in held[-window:])
                held = []
            else:
                held = held[-window:]

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != now:
                    if now is not None:
                        settle(True)
                    now, seen = r[0], 0
                if seen < window:
                    border.append((part - 1, r))
                seen += 1
                held.append(r)
                if len(held) >= 32 * window:
                    settle(False)
        if now is not None:
            settle(True)
        out = [(None, None, None, None, None, a, b) for a, b in edges] + [(s, *r, None, None) for s, r in border]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for k in range(0, len(out), 4000):
            cols = list(zip(*out[k : k + 4000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["s", "p", "key", "id", "v", "a", "b"])

    return run


def _rows(held: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[3] for r in held), "<f8").reshape(len(held), -1)


def _borders(threshold: float, window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted({r["id"]: (r["key"], r["id"], r["v"]) for r in table.to_pylist()}.values())
        x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), -1)
        out = _compare([r[1] for r in rows], x, threshold, window)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _block_links(threshold: float):
    """Links between two blocks of a long run, or inside one; block pairs arrive sorted."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        a = [r for r in held if r[4] == r[2]]
        b = a if held[0][2] == held[0][3] else [r for r in held if r[4] == r[3]]
        out: list[tuple[int, int]] = []
        if a and b:
            x, y = (np.frombuffer(b"".join(r[6] for r in z), "<f8").reshape(len(z), -1) for z in (a, b))
            both = a if b is a else a + b
            forest, off = Forest(len(both)), 0 if b is a else len(a)
            for lo in range(0, len(a), 256):
                i, j = np.nonzero(x[lo : lo + 256] @ y.T >= threshold)
                for s, t in zip((i + lo).tolist(), (j + off).tolist(), strict=True):
                    forest.union(s, t)
            out = _edges([r[5] for r in both], forest)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != now:
                    if held:
                        yield settle(held)
                    now, held = r[:4], []
                held.append(r)
        if held:
            yield settle(held)

    return run


def _long_runs(keys: DataFrame, bits: int, threshold: float, window: int) -> DataFrame:
    """Edges from comparing all vectors of each run that exceeds the window."""
    keys = keys.withColumn("run", F.shiftrightunsigned("key", _BITS - bits) if bits else F.lit(0).cast("long"))
    sizes = cut(keys.groupBy("p", "run").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > window))
    placed = keys.join(sizes, ["p", "run"]).withColumn("blocks", F.ceil(F.col("size") / RUN_BLOCK).cast("int"))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    placed = placed.select("p", "run", F.explode(pairs).alias("q"), "blk", "id", "v").select("p", "run", F.col("q.i").alias("i"), F.col("q.j").alias("j"), "blk", "id", "v")
    sorted_ = placed.repartition("p", "run", "i", "j").sortWithinPartitions("p", "run", "i", "j", "blk", "id")
    return sorted_.mapInArrow(_block_links(threshold), "a long, b long")


def _block_counts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> tuple[list[int], list[int]]:
            a = [r for r in held if r[3] == now[1]]
            b = [r for r in held if r[3] == now[2]]
            x, y = (np.frombuffer(b"".join(r[5] for r in z), "<f8").reshape(len(z), -1) for z in (a, b)) if a and b else (np.zeros((0, 1)), np.zeros((0, 1)))
            wa, wb = np.array([r[6] for r in a]), np.array([r[6] for r in b])
            if not len(x) or not len(y):
                return [], []
            hit = x @ y.T >= threshold
            if now[1] == now[2]:
                np.fill_diagonal(hit, False)
                return [r[4] for r in a], (hit @ wb).tolist()
            return [r[4] for r in a + b], (hit @ wb).tolist() + (hit.T @ wa).tolist()

        def batch() -> pa.RecordBatch:
            ids, counts = settle()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["id", "n"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != now:
                    if held:
                        yield batch()
                    now, held = r[:3], []
                held.append(r)
        if held:
            yield batch()

    return run


def link_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                window: int = WINDOW, passes: int | None = None, seed: int = 7) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``) for each row.

    Cosines are taken in double precision. Vectors that are null, empty, zero or
    hold a null or non-finite component, and those of another length, link with
    nothing. Equal vectors are compared once and linked by count. Ids are
    integers; each row, also one with a repeated or a null id, is a vector of
    its own and gives one row. A null id counts as the least long in
    component_id. An empty table gives an empty result; other columns aren't
    looked at.
    """
    base = vectors.select(key_of(id_col).alias("id"), column(vector_col).alias("v"))
    unit = base.mapInArrow(_normalise, "id long, v binary")
    usable = unit.where("v is not null")
    # equal vectors are one, with a number of its own in the graph, since ids may repeat
    same = cut(usable.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w")).withColumn("rep", F.monotonically_increasing_id()))
    n = same.count()
    k = passes or passes_for(n, threshold, window)
    keys = same.select(F.col("rep").alias("id"), "v").mapInArrow(_signs(k, seed), "p long, key long, id long, v binary")
    ordered = keys.repartitionByRange("p", "key", "id").sortWithinPartitions("p", "key", "id")
    found = cut(ordered.mapInArrow(_windows(threshold, window), "s long, p long, key long, id long, v binary, a long, b long"))
    across = found.where("s is not null").groupBy("s", "p").applyInArrow(_borders(threshold, window), "a long, b long")
    whole = _long_runs(keys, run_bits(n, window), threshold, window)
    group = cut(components(found.where("a is not null").select("a", "b").unionByName(across).unionByName(whole)))
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # each member meets every block of its group once: as the left side for later blocks, the right side for earlier ones
    spread = F.ceil(F.col("size") / BLOCK).cast("int")
    member = group.join(sizes, "component").withColumn("blocks", spread).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    placed = member.join(same, member.node == same.rep).select("component", F.explode(pairs).alias("q"), "blk", F.col("node").alias("id"), "v", "w")
    placed = placed.select("component", F.col("q.i").alias("i"), F.col("q.j").alias("j"), "blk", "id", "v", "w")
    counts = placed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "blk", "id").mapInArrow(_block_counts(threshold), "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("others"))
    reps = same.select("rep", "least", "w", F.md5("v").alias("name")).join(counts, same.rep == counts.id, "left").drop("id").join(group, same.rep == group.node, "left").select(
        "name", "least", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("c"))
    reps = reps.join(reps.groupBy("c").agg(F.min("least").alias("first")), "c")
    # rows of one vector may be a third of all, so each is dealt to one of SALTS copies of its vector's results
    dealt = reps.select("name", "links", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = unit.select("id", F.md5("v").alias("own"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("at"))
    null_id = F.col("id") == -(1 << 63)
    least = F.coalesce("first", "id")
    return rows.join(dealt, (rows["own"] == dealt["name"]) & (rows["at"] == dealt["salt"]), "left").select(
        F.when(~null_id, F.col("id")).alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        least.alias("component_id"), (least == F.col("id")).alias("kept"))
