"""SentencePiece encoding and decoding as relations.

A text with U+2581 for each space, and one in front, falls apart into units
that no piece can cross. Units are encoded relationally: their substrings of
bounded length are exploded and equi-joined to the piece table, the lattice
edges are grouped by unit, and a higher-order aggregate folds each lattice. For
a unigram model the fold is Viterbi. A BPE model's scores are merge ranks, whose
sums mean nothing: there the fold takes, best first, the edges that span two
adjacent segments, which is what the model defines.

Every distinct unit of the corpus takes that way: map tasks number the units of
a block of texts and keep each text as numbers, the distinct units are encoded,
their ids are joined back to the blocks, and each block's texts are put together
from its own units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import column, lean, packed, parts, runs, shuffle_partitions

#: The public vocabulary's place; a parameter of every function below.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest unit that the lattice takes, in characters: its bounds are the bits of a long, and a fold grows with the
#: square of the length. The model library encodes the longer ones (long lines without a space); ids are the same.
LONGEST = 61
#: Bytes of text in a block.
BLOCK = 32 << 20
#: Signs whose bounds are sought at a time.
STEP = 1 << 17
#: Units whose ids a task packs at a time.
HOLD = 250_000
#: Units in a row on their way to the lattice.
PACK = 20_000
SPACE = "▁"
_models: dict[int, tuple] = {}


class Model:
    """A model file's pieces and how texts fall into units."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.bytes_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces):
            raise ValueError("a piece holds a space after another sign")
        breaks = "".join(c for c in "\t\n\x0b\x0c" if not any(c in p for p, _, _ in self.pieces))
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+|[{breaks}]")
        self.breaks = list(map(ord, breaks))
        self.pairs = {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)}
        # signs of the pairs by number (0: in none), and a bit for each two of them: whether they stand side by side
        signs = sorted({x for pair in self.pairs for x in pair})
        self.sign = np.zeros(0x110000, np.uint16 if len(signs) < 1 << 16 else np.uint32)
        self.sign[[ord(x) for x in signs]] = np.arange(1, len(signs) + 1)
        self.signs = len(signs) + 1
        at = np.array([int(self.sign[ord(x)]) * self.signs + int(self.sign[ord(y)]) for x, y in self.pairs], np.int64)
        self.glued = np.zeros((self.signs * self.signs >> 3) + 1, np.uint8)
        np.bitwise_or.at(self.glued, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        self.to_bytes = {i: bytes([b]) for b, i in self.bytes_ids.items()} | {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces}
        self.own_space = [self.bytes_ids[b] for b in SPACE.encode()]

    def units(self, text: str) -> list[list[str]]:
        """The units of each part of a text between its own U+2581 signs."""
        parts = text.split(SPACE)
        parts[0] = " " + parts[0]
        return [self.unit.findall(p.replace(" ", SPACE)) for p in parts]

    def apart(self, unit: str) -> list[str]:
        """A unit cut between any two signs that stand side by side in no piece."""
        at = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs), len(unit)]
        return [unit[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def cut(self, texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """All texts' units (``units``, each taken ``apart``) in order, which of them are a text's own U+2581, and each text's bounds among them."""
        whole = b"".join([b" " + t if t else b"" for t in texts]).decode()
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths + (lengths > 0))))  # bytes, with the spaces in front
        starts, mine, heads = [], [], []  # of units, and of texts among the units' bytes
        given = put = 0  # bytes before a step, and as the units have them: a space is three bytes there
        last = ""
        for lo in range(0, len(whole), STEP):
            code = np.frombuffer((last + whole[lo : lo + STEP]).encode("utf-32-le"), "<u4")
            own, blank = code == ord(SPACE), code == 32
            code = np.where(blank, np.uint32(ord(SPACE)), code)
            sign = self.sign[code].astype(np.int64)
            pair = sign[:-1] * self.signs + sign[1:]
            new = self.glued[pair >> 3] >> (pair & 7).astype(np.uint8) & 1 == 0
            new |= (blank[1:] & ~blank[:-1]) | own[1:] | own[:-1]
            for x in self.breaks:
                new |= (code[1:] == x) | (code[:-1] == x)
            if not last:
                new = np.append(True, new)
            else:
                code, own, blank = code[1:], own[1:], blank[1:]
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)
            place = put + np.cumsum(width) - width
            plain = np.where(blank, 1, width)
            at = given + np.cumsum(plain) - plain
            given, put = int(at[-1] + plain[-1]), int(place[-1] + width[-1])
            k = np.searchsorted(at, begins[(begins >= at[0]) & (begins < given)])
            new[k] = True
            heads.append(place[k])
            starts.append(place[new])
            mine.append(own[new])
            last = whole[lo + len(code) - 1]
        none = np.zeros(0, np.int64)
        start = np.concatenate((none, *starts))
        data = whole.replace(" ", SPACE).encode()
        units = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, put).astype(np.int32).tobytes()), pa.py_buffer(data))
        heads = np.concatenate((none, *heads, np.full(int((begins == given).sum()), put)))
        return units, np.concatenate((none.astype(bool), *mine)), np.searchsorted(start, heads)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of units by the library, which puts a space before what it is given."""
        nl = self.bytes_ids[10]
        given = [u[1:].replace(SPACE, " ") if u[0] == SPACE else "\n" + u for u in units]
        out = []
        for u, ids in zip(units, self.sp.encode(given, num_threads=1), strict=True):
            if u == SPACE and not ids:
                ids = [self.sp.piece_to_id(SPACE)]
            elif u[0] != SPACE:
                ids = ids[ids.index(nl) + 1 :]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The exact text: pieces and bytes in order, without the space put in front."""
        get = self.to_bytes
        return b"".join([get[i] for i in ids])[1:]


def model_of(proto: bytes) -> Model:
    key = hash(proto)
    if key not in _models:
        _models[key] = Model(proto)
    return _models[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _substrings(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    at = units.select("key", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)).alias("s"))
    sub = at.select("key", "unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("unit") - F.col("s")))).alias("l"))
    sub = sub.select("key", "unit", "s", (F.col("s") + F.col("l")).alias("e"), F.substring(F.col("unit"), F.col("s") + 1, F.col("l")).alias("piece"))
    return sub.join(F.broadcast(pieces), "piece")


def edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Lattice of each (``key``, ``unit``): array ``edges`` of (score, s, e, id), offsets in characters; only units that have any."""
    return _substrings(units, pieces, longest).groupBy("key", "unit").agg(F.collect_list(F.struct("score", "s", "e", "id")).alias("edges"))


def inverting(scores: dict[str, float]) -> set[str]:
    """Pieces whose own last merge scores no less than the one before it.

    Merges inside an edge go on as in its string alone, as long as its ends
    stay. So an edge that opens only after a merge of lower or equal score is
    one of these; where a unit has none, its merges come in falling order.
    """
    out = set()
    for piece in scores:
        parts_, last = list(piece), float("inf")
        while len(parts_) > 1:
            ways = [(scores[x + y], -i) for i, (x, y) in enumerate(zip(parts_[:-1], parts_[1:], strict=True)) if x + y in scores]
            if not ways:
                break
            score, i = max(ways)
            if len(parts_) == 2 and score >= last:
                out.add(piece)
            last = score
            parts_[-i : 2 - i] = ["".join(parts_[-i : 2 - i])]
    return out


def merge_edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The lattice for ``merge_ids`` of each (``key``, ``unit``): ``edges`` of two signs and more, and of single signs beyond ASCII and U+2581.

    An edge is a long that orders edges by score and then from the right: rank,
    63 - s, s, length and id. ``inverts`` tells if any edge does. A unit without
    an edge has an empty array, as an empty string that every unit holds is
    joined as well.
    """
    plain = "CASE WHEN ascii(substring(unit, s + 1, 1)) < 128 OR substring(unit, s + 1, 1) = '\u2581' THEN 2 ELSE 1 END"
    at = units.select("key", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)).alias("s"))
    at = at.select("key", "unit", "s", F.expr(plain).alias("lo"), F.least(F.lit(longest), F.char_length("unit") - F.col("s")).alias("hi"))
    lengths = F.expr("concat(IF(s = 0, array(0), CAST(array() AS ARRAY<INT>)), IF(lo <= hi, sequence(lo, hi), CAST(array() AS ARRAY<INT>)))")
    sub = at.select("key", "unit", "s", F.explode(lengths).alias("l")).select("key", "unit", "s", "l", F.expr("substring(unit, s + 1, l)").alias("piece"))
    none = units.sparkSession.createDataFrame([("", None, None, False)], pieces.schema)
    found = sub.join(F.broadcast(pieces.unionByName(none)), "piece")
    edge = F.expr("shiftleft(rank, 38) + shiftleft(CAST(63 - s AS BIGINT), 32) + shiftleft(CAST(s AS BIGINT), 26) + shiftleft(CAST(l AS BIGINT), 20) + id")
    return found.select("key", "unit", edge.alias("edge"), "inverts").groupBy("key", "unit").agg(F.collect_list("edge").alias("edges"), F.max("inverts").alias("inverts"))


def merge_ids(byte_ids: list[int], sign_ids: list[int]) -> Column:
    """Ids of the BPE segments of ``unit``: merges of two adjacent segments, best score first, leftmost among equals.

    The segments' bounds are the set bits of a long. An edge can be taken if
    both of its ends are bounds and it holds exactly one, and stands for a
    segment in the end if it holds none. Without an inverting edge merges come
    in falling order of score, so one pass over the sorted edges takes them all;
    else the best open edge is sought step by step. A single sign takes its id
    of ``sign_ids`` (ASCII and U+2581, -1 for none) or its own edge; a sign
    without a piece becomes the ids of its bytes.
    """
    first = "shiftleft(1L, char_length(unit) + 1) - 1L"
    start, size = "CAST(shiftright(x, 26) & 63 AS INT)", "CAST(shiftright(x, 20) & 63 AS INT)"
    need = f"shiftleft(1L | shiftleft(1L, {size}), {start})"
    holds = f"shiftleft(shiftleft(1L, {size} - 1) - 1L, {start} + 1)"
    once = f"aggregate(sort_array(edges, false), {first}, (b, x) -> IF(bit_count(b & {holds}) = 1 AND (b & {need}) = {need}, b & ~{holds}, b))"
    wide = f"transform(filter(edges, x -> {size} > 1), x -> named_struct('key', x, 'need', {need}, 'holds', {holds}))"
    # what a lambda binds is computed once; a plain expression would be computed again in each step
    steps = f"""aggregate(sequence(1, char_length(unit)), named_struct('b', {first}, 'live', {wide}),
        (now, i) -> transform(array(array_max(filter(now.live, x -> bit_count(now.b & x.holds) = 1))), m ->
            IF(m IS NULL, now, named_struct('b', now.b & ~m.holds, 'live', filter(now.live, x -> (x.need & m.holds) = 0))))[0], now -> now.b)"""
    table, signs = (f"array({', '.join(map(str, x))})" for x in (byte_ids, [*sign_ids, -1]))
    sign = "substring(unit, i + 1, 1)"
    code = f"hex(encode({sign}, 'UTF-8'))"
    by_byte = f"transform(sequence(1, CAST(char_length({code}) / 2 AS INT)), j -> element_at({table}, CAST(conv(substring({code}, 2 * j - 1, 2), 16, 10) AS INT) + 1))"
    single = "filter(sequence(0, char_length(unit) - 1), i -> (b & shiftleft(3L, i)) = shiftleft(3L, i))"
    by_sign = f"element_at({signs}, CASE WHEN ascii({sign}) < 128 THEN ascii({sign}) + 1 WHEN {sign} = '\u2581' THEN 129 ELSE 130 END)"
    own = f"""concat(transform(filter(edges, x -> (b & {holds}) = 0 AND (b & {need}) = {need}), x -> shiftleft(shiftright(x, 26) & 63, 20) + (x & 1048575)),
        filter(transform({single}, i -> shiftleft(CAST(i AS BIGINT), 20) + {by_sign}), x -> (x & 1048575) != 1048575))"""
    alone = f"filter({single}, i -> NOT exists(own, x -> shiftright(x, 20) = i))"
    return F.expr(f"""transform(array(IF(inverts, {steps}, {once})), b -> transform(array({own}), own -> IF(size(own) = bit_count(b) - 1,
        transform(sort_array(own), x -> CAST(x & 1048575 AS INT)),
        flatten(transform(array_sort(concat(transform(own, x -> named_struct('s', CAST(shiftright(x, 20) AS INT), 'ids', array(CAST(x & 1048575 AS INT)))),
            transform({alone}, i -> named_struct('s', i, 'ids', {by_byte})))), x -> x.ids))))[0])[0]""")


def viterbi_fold(unit: Column, edge: Column, unknown: float) -> Column:
    """Bounds of the segments with the greatest sum of scores; a single sign without a piece scores ``unknown``."""
    kind = "array<struct<score:double,bounds:array<int>>>"

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edge, lambda x: x["e"] == e), lambda x: F.struct(
            (F.element_at(best, x["s"] + 1)["score"] + x["score"]).alias("score"), F.concat(F.element_at(best, x["s"] + 1)["bounds"], F.array(e)).alias("bounds")))
        one = F.element_at(best, e)
        lone = F.struct((one["score"] + unknown).alias("score"), F.concat(one["bounds"], F.array(e)).alias("bounds"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(lone)))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("bounds"))).cast(kind)
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), first, step), -1)["bounds"]


def segment_ids(unit: Column, edge: Column, bounds: Column, byte_ids: list[int]) -> Column:
    """Piece ids of the segments; a sign without a piece becomes the ids of its bytes."""
    table = F.array(*[F.lit(i) for i in byte_ids])
    spans = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda s, i: F.struct(s.alias("s"), F.element_at(bounds, i + 2).alias("e")))

    def ids(x: Column) -> Column:
        own = F.filter(edge, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))
        code = F.hex(F.encode(F.substring(unit, x["s"] + 1, x["e"] - x["s"]), "UTF-8"))
        by_byte = F.transform(F.sequence(F.lit(1), (F.char_length(code) / 2).cast("int")), lambda i: F.element_at(table, F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(F.size(own) > 0, F.array(F.element_at(own, 1)["id"])).otherwise(by_byte)

    return F.flatten(F.transform(spans, ids))


def encode_units(units: DataFrame, model: Model, kind: str = "bpe") -> DataFrame:
    """(``unit``, ``ids``) for each distinct, non-empty ``unit`` of up to LONGEST characters, by joins and folds alone."""
    return _encoded(units.where(F.col("unit") != "").select("unit").distinct().repartition(shuffle_partitions(units.sparkSession), "unit"), model, kind)


def _encoded(units: DataFrame, model: Model, kind: str) -> DataFrame:
    """As ``encode_units``, for distinct units that are dealt out by ``unit``: no further exchange is needed."""
    spark = units.sparkSession
    units = units.select(F.xxhash64("unit").alias("key"), "unit")  # a number in front of the unit sorts faster
    byte_ids = [model.bytes_ids[b] for b in range(256)]
    if kind == "bpe":
        ranks = {x: i for i, x in enumerate(sorted({s for _, _, s in model.pieces}))}
        odd = inverting({p: s for p, _, s in model.pieces})
        pieces = spark.createDataFrame([(p, ranks[s], i, p in odd) for p, i, s in model.pieces], "piece string, rank long, id int, inverts boolean")
        signs = {p: i for p, i, _ in model.pieces if len(p) == 1}
        sign_ids = [signs.get(x, -1) for x in [*map(chr, range(128)), SPACE]]
        return merge_edges(units, pieces, min(model.longest, LONGEST)).select("unit", merge_ids(byte_ids, sign_ids).alias("ids"))
    pieces = spark.createDataFrame([(p, float(s), i) for p, i, s in model.pieces], "piece string, score double, id int")
    lattice = units.join(edges(units, pieces, model.longest), ["key", "unit"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<score:double,s:int,e:int,id:int>>")))
    unknown = min(s for _, _, s in model.pieces) - 10.0
    lattice = lattice.withColumn("bounds", viterbi_fold(F.col("unit"), F.col("edges"), unknown))
    return lattice.select("unit", segment_ids(F.col("unit"), F.col("edges"), F.col("bounds"), byte_ids).alias("ids"))


_BLOCKS = "block long, at int, codes binary, digest binary"


def _number(proto):
    """Texts as numbers of their block's units, and each block's units in packs (``at``: the number before the first); number 0 is a text's own U+2581."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, press = model_of(proto.value), zstandard.ZstdCompressor(level=3)
        block, size = TaskContext.get().partitionId() << 16, 0
        known: dict[str, int] = {}
        kind = None

        def numbered(units: pa.StringArray) -> np.ndarray:
            every = units.to_numpy(zero_copy_only=False).tolist()
            out = list(map(known.get, every))
            for i in [i for i, x in enumerate(out) if x is None]:
                known[every[i]] = out[i] = len(known) + 1
            return np.array(out, np.int64)

        def units() -> Iterator[pa.RecordBatch]:
            every = [u.encode() for u in known]
            for i in range(0, len(every), PACK):
                part = every[i : i + PACK]
                pack = press.compress(np.array([len(part), *map(len, part)], "<u4").tobytes() + b"".join(part))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([block], pa.int64()), pa.array([i], pa.int32()), pa.array([pack], pa.binary()), pa.nulls(1, pa.binary())],
                                                 ["r", "block", "at", "codes", "digest"])

        for b in batches:
            kind = b.column(0).type
            for lo, hi, texts in parts(b.column(1)):
                unit, own, ends = model.cut(texts)
                coded = unit.filter(pa.array(~own)).dictionary_encode()
                every = np.zeros(len(unit), "<u4")
                every[~own] = numbered(coded.dictionary)[np.asarray(coded.indices)]
                # bytes of one weight side by side press better
                codes = [press.compress(every[i:j].view(np.uint8).reshape(-1, 4).T.tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                size += sum(map(len, texts))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(np.full(n, block), pa.int64()), pa.nulls(n, pa.int32()), pa.array(codes, pa.binary()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())],
                    ["r", "block", "at", "codes", "digest"])
                if size >= BLOCK or len(known) > 1 << 23:
                    yield from units()
                    block, size, known = block + 1, 0, {}
        yield from units()

    return run


def _unpacked(pack: bytes) -> pa.StringArray:
    n = int(np.frombuffer(pack, "<u4", 1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(pack, "<u4", n, 4)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(pack[4 * (n + 1) :]))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, place) of the units up to LONGEST in each block's packs; a place is the block's number and, in its last 24 bits, the unit's."""
    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        b = b.select(["block", "at", "codes"]).filter(pc.is_valid(b.column("at")))
        for block, at, pack in zip(*(c.to_pylist() for c in b.columns), strict=True):
            unit = _unpacked(unpress.decompress(pack))
            short = pc.less_equal(pc.utf8_length(unit), LONGEST)
            place = (block << 24) + np.arange(at + 1, at + len(unit) + 1)
            yield pa.RecordBatch.from_arrays([unit, pa.array(place)], ["unit", "place"]).filter(short)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pack) from (place, ids), dealt anyhow: the numbers of a block's units, their count of ids and the ids, pressed."""
    press = zstandard.ZstdCompressor(level=3)

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        place = np.concatenate([np.asarray(b.column(0)) for b in held])
        ids = pa.concat_arrays([b.column(1) for b in held])
        order = np.argsort(place)
        place, ids = place[order], ids.take(pa.array(order))
        size, flat = np.asarray(pc.list_value_length(ids)), np.asarray(ids.flatten())
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        lo, hi = runs(place >> 24)
        out = []
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            steps = np.diff(place[a:b] & (1 << 24) - 1, prepend=0)
            # bytes of one weight side by side press better
            every = np.concatenate(([b - a], steps, size[a:b], flat[ends[a] : ends[b]])).astype("<i4")
            out.append(press.compress(every.view(np.uint8).reshape(-1, 4).T.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(place[lo] >> 24), pa.array(out, pa.binary())], ["block", "pack"])

    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= HOLD:
            yield packs(held)
            held, n = [], 0
    if held:
        yield packs(held)


def _answered(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, counts of ids and ids of these packs."""
    unpress, at, size, flat = zstandard.ZstdDecompressor(), [], [], []
    for x in packs:
        every = np.frombuffer(unpress.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
        n = int(every[0])
        at.append(np.cumsum(every[1 : n + 1], dtype=np.int64))
        size.append(every[n + 1 : 2 * n + 1].astype(np.int64))
        flat.append(every[2 * n + 1 :])
    none = np.zeros(0, np.int64)
    return np.concatenate((none, *at)), np.concatenate((none, *size)), np.concatenate((none.astype(np.int32), *flat))


def _fill(proto):
    """Ids of the texts of a block from those of its units."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        model, unpress = model_of(proto.value), zstandard.ZstdDecompressor()
        say = [model.to_bytes.get(i, b"") for i in range(model.sp.get_piece_size())]
        own = np.array(model.own_space, np.int32)
        at, n, flat = _answered(known.column("pack").to_pylist())
        long = {}
        packs = texts.filter(pc.is_valid(texts.column("at")))
        for lo, pack in zip(packs.column("at").to_pylist(), packs.column("codes").to_pylist(), strict=True):
            unit = _unpacked(unpress.decompress(pack))
            for i in np.flatnonzero(np.asarray(pc.utf8_length(unit)) > LONGEST).tolist():
                long[lo + 1 + i] = model.encode_units([unit[i].as_py()])[0]
        at = np.concatenate((at, np.fromiter(long, np.int64, len(long))))
        n = np.concatenate((n, np.fromiter(map(len, long.values()), np.int64, len(long))))
        values = np.concatenate((own, flat, *(np.array(x, np.int32) for x in long.values())))
        sizes, starts = (np.zeros(1 + int(at.max() if len(at) else 0), np.int64) for _ in range(2))
        sizes[0], sizes[at], starts[at] = len(own), n, len(own) + np.cumsum(n) - n
        texts = texts.filter(pc.is_null(texts.column("at")))
        out = [texts.slice(0, 0).select(["r"]).append_column("ids", pa.array([], pa.list_(pa.int32()))).append_column("exact", pa.array([], pa.bool_()))]
        for k in range(0, len(texts), 128):
            part = texts.slice(k, 128)
            codes = [np.frombuffer(unpress.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in part.column("codes").to_pylist()]
            every = np.concatenate(codes)
            n = sizes[every]
            ends = np.cumsum(n)
            flat = values[np.repeat(starts[every] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, codes)])].astype(np.int32)
            same = []
            for i, d in enumerate(part.column("digest").to_pylist()):
                back = b"".join([say[x] for x in flat[cuts[i] : cuts[i + 1]].tolist()])[1:]
                same.append(hashlib.md5(back).digest() == d)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32()))
            out.append(part.select(["r"]).append_column("ids", lists).append_column("exact", pa.array(same, pa.bool_())))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, text_col: str = "text", model: str | bytes = MODEL, kind: str = "bpe", carry: list[str] | None = None,
           frequent: int | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``ids`` (piece ids of the whole text) and ``exact`` (decoding gave back every byte).

    A null or empty text has no ids. A U+2581 in a text is kept by its bytes,
    which the library would make a space; else ids equal the library's.
    ``frequent`` is taken for older callers and changes nothing: frequent or
    rare, every unit takes the lattice. A column that carries an output's name comes back with
    ``_input`` behind it. Repeated rows get equal ids; an empty table gives an
    empty result.
    """
    spark: SparkSession = docs.sparkSession
    proto = read_model(model) if isinstance(model, str) else model
    rows = docs.select(packed(docs.columns if carry is None else carry, ["ids", "exact"]), column(text_col).alias("t"))
    schema = D.StructType([D.StructField("r", rows.schema["r"].dataType), *D.StructType.fromDDL("ids array<int>, exact boolean").fields])
    sent = spark.sparkContext.broadcast(proto)
    blocks = rows.mapInArrow(lean(_number(sent)), D.StructType([schema["r"], *D.StructType.fromDDL(_BLOCKS).fields])).repartition("block")
    # the exchange of the blocks serves the units and the texts, that of the units the lattice and the join; no column is left out of either, so that plans agree
    asked = blocks.mapInArrow(lean(_asked), "unit string, place long").where("unit IS NOT NULL").repartition(shuffle_partitions(spark), "unit")
    units = asked.groupBy("unit").agg(F.max("place").alias("p")).where("p >= 0")
    ids = _encoded(units, model_of(proto), kind).hint("shuffle_hash")
    known = asked.join(ids, "unit").select("place", "ids").mapInArrow(lean(_answers), "block long, pack binary")
    done = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_fill(sent), schema)
    return done.select("r.*", "ids", "exact")


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | bytes = MODEL) -> DataFrame:
    """``encoded`` plus ``decoded``, the text of its ids; null ids give null, no ids the empty text.

    A column named ``decoded`` comes back as ``decoded_input``; repeated rows get
    equal texts; an empty table gives an empty result.
    """
    proto = read_model(model) if isinstance(model, str) else model
    sent = encoded.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(sent.value)
        for b in batches:
            texts = [None if x is None else m.decode(x).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["r", "decoded"])

    rows = encoded.select(packed(encoded.columns, ["decoded"]), column(ids_col).alias("i"))
    return rows.mapInArrow(run, D.StructType([rows.schema["r"], D.StructField("decoded", D.StringType())])).select("r.*", "decoded")
