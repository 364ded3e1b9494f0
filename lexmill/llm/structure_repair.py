"""Conversation structure: faults of turns, and the cheapest edits that mend them.

Each conversation becomes a signature, one sign a row for its role's initial
and its fault. Distinct signatures, sorted, are walked as a prefix trie: the
dynamic programme's layers along the path from the root stay on a stack, so a
prefix that signatures share is computed once, and a signature's answer is
read off at its terminal node. Rows travel twice by conversation, once to be
told and once to be mended, and are streamed: a task holds 16 bytes for each
distinct row of the conversation at hand and its edits, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, key_of, lean, shuffle_partitions

_SPACE = " \t\n\x0b\x0c\r"
_OK, _TRUNCATED, _MUST_GO = 0, 1, 2
_ROLES = "sua"
#: Grammar ``(s?(ua)+)?`` over role initials: state by initial. 0: nothing yet, 1: after s, 2: after u, 3: after a.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: What a state waits for.
_WANTS = "uuau"
_END = {0: "", 1: "II", 2: "I", 3: ""}
_KEEP, _REROLE, _DELETE, _INSERT, _LEFT = 0, 2, 3, 2, 1


def _moves() -> dict[str, list[list[tuple[int, str, int]]]]:
    """By sign and state: what one row allows, as (next state, edits, cost)."""
    out = {}
    for r, role in enumerate([*_ROLES, None]):
        for fault in (_OK, _TRUNCATED, _MUST_GO):
            by_state = []
            for start in range(4):
                at, inserted, seen, found = start, "", set(), []
                while at not in seen:
                    seen.add(at)
                    paid = _INSERT * len(inserted)
                    found.append((at, inserted + "D", paid + _DELETE))
                    if fault != _MUST_GO:
                        left = _LEFT if fault == _TRUNCATED else 0
                        if role and _NEXT[role][at] is not None:
                            found.append((_NEXT[role][at], inserted + "K", paid + _KEEP + left))
                        found.append((_NEXT[_WANTS[at]][at], inserted + "R", paid + _REROLE + left))
                    at, inserted = _NEXT[_WANTS[at]][at], inserted + "I"
                by_state.append(found)
            out[chr(ord("a") + 3 * r + fault)] = by_state
    return out


_MOVES = _moves()


def _layer(last: dict, sign: str) -> dict:
    """State: (cost, rank of its edits among the layer's, state before, edits). Edits that end with a row are prefix-free, so ranks order them."""
    best: dict[int, tuple] = {}
    for state, (cost, rank, _, _) in last.items():
        for to, edits, more in _MOVES[sign][state]:
            new = (cost + more, rank, edits, state)
            if to not in best or new < best[to]:
                best[to] = new
    order = sorted(best, key=lambda s: best[s][1:3])
    return {s: (best[s][0], i, best[s][3], best[s][2]) for i, s in enumerate(order)}


def _answer(layers: list[dict]) -> tuple[int, str]:
    cost, _, end, state = min((c + _INSERT * len(_END[s]), rank, _END[s], s) for s, (c, rank, _, _) in layers[-1].items())
    edits = [end]
    for layer in reversed(layers[1:]):
        _, _, before, did = layer[state]
        edits.append(did)
        state = before
    return cost, "".join(reversed(edits))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, layers = "", [{0: (0, 0, 0, "")}]
    for batch in batches:
        signs = batch.column(0).to_pylist()
        costs, audits = [], []
        for sign in signs:
            same = 0
            for x, y in zip(path, sign, strict=False):
                if x != y:
                    break
                same += 1
            del layers[same + 1 :]
            for x in sign[same:]:
                layers.append(_layer(layers[-1], x))
            path = sign
            cost, audit = _answer(layers)
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for each distinct ``signature`` of ``signatures``: the least cost and its edits' initials, ties the least in ASCII."""
    distinct = signatures.select("signature").distinct()
    spread = distinct.repartitionByRange(shuffle_partitions(signatures.sparkSession), "signature").sortWithinPartitions("signature")
    return spread.mapInArrow(lean(_walk), "signature string, cost long, audit string")


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(column(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(key_of(conv_col).alias("k"), column(turn_col).cast("long").alias("t"), role.alias("role"), text.alias("text"))


_TOLD = "k long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _TOLD.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()]
    now, seen, signs, counts, last, turns, ends = None, set(), [], [0] * 4, "", 0, (None, None)

    def done() -> tuple:
        gaps = 0 if ends[0] is None else ends[1] - ends[0] + 1 - turns
        return (now, gaps, *counts, "".join(signs))

    for batch in batches:
        out = []
        for k, t, initial, blank, cut_off, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now:
                if now is not None:
                    out.append(done())
                now, seen, signs, counts, last, turns, ends = k, set(), [], [0] * 4, None, 0, (None, None)
            fault = 0 if blank else 1 if same in seen else 2 if cut_off else None
            seen.add(same)
            if fault is not None:
                counts[fault] += 1
            if last is not None and last + initial not in ("su", "ua", "au"):
                counts[3] += 1
            last = initial
            if t is not None:
                turns += t != ends[1]
                ends = (t if ends[0] is None else ends[0], t)
            role = _ROLES.find(initial) if initial else -1
            signs.append(chr(ord("a") + 3 * (role if role >= 0 else 3) + (_OK if fault is None else _TRUNCATED if fault == 2 else _MUST_GO)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)


def _tell_rows(plain: DataFrame) -> DataFrame:
    spaces = F.lit(_SPACE)
    trimmed = F.rtrim("text", spaces)
    placed = plain.repartition(shuffle_partitions(plain.sparkSession), "k").sortWithinPartitions("k", F.asc_nulls_first("t"), "role", "text")
    same = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    last = F.right(trimmed, F.lit(1))
    rows = placed.select("k", "t", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"), same.alias("same"))
    return rows.mapInArrow(lean(_tell), _TOLD)


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["k", "at", "edit", "t", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    now, audit, i, state, at = None, "", 0, 0, 0
    full = {"u": "user", "a": "assistant"}

    def inserts(out: list) -> None:
        nonlocal i, state, at
        while i < len(audit) and audit[i] == "I":
            out.append((now, at, "I", None, full[_WANTS[state]], ""))
            state, i, at = _NEXT[_WANTS[state]][state], i + 1, at + 1

    for batch in batches:
        out: list[tuple] = []
        for k, kind, t, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                inserts(out)
                now, audit, i, state, at = k, text, 0, 0, 0
                continue
            inserts(out)
            did, i = audit[i], i + 1
            if did == "D":
                continue
            if did == "R":
                role = full[_WANTS[state]]
            out.append((k, at, did, t, role, text))
            state, at = _NEXT[role[0]][state], at + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    out = []
    inserts(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, hashlib.sha256()
    for batch in batches:
        keys, found = [], []
        for k, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now:
                if now is not None:
                    keys.append(now)
                    found.append(sha.hexdigest())
                now, sha = k, hashlib.sha256()
            sha.update(f"{chr(10) if at else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["k", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["k", "sha"])


def _plans(plain: DataFrame) -> DataFrame:
    """What is told of each conversation, with its cheapest edits; many conversations may share one signature."""
    told = cut(_tell_rows(plain))
    return cut(told.join(cheapest_edits(told), "signature"))


def _mended(plain: DataFrame, plans: DataFrame) -> DataFrame:
    """The mended rows, each conversation's in order within one partition."""
    none = F.lit(None)
    first = plans.select("k", F.lit(0).alias("kind"), none.cast("long").alias("t"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = first.unionAll(plain.select("k", F.lit(1), "t", "role", "text"))
    placed = rows.repartition(shuffle_partitions(plain.sparkSession), "k").sortWithinPartitions("k", "kind", F.asc_nulls_first("t"), "role", "text")
    return placed.mapInArrow(lean(_mend), "k long, at long, edit string, t long, role string, text string")


def _id() -> F.Column:
    return F.when(F.col("k") != -(1 << 63), F.col("k")).alias("conv_id")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The mended conversations: (conv_id, position from 0, edit, turn, role, text).

    Rows are taken by turn, role and text, nulls first. Role initials become
    ``(s?(ua)+)?`` at the least cost: keep 0, change the role to user or assistant
    2, delete 3, insert an empty user or assistant row 2, and 1 for a truncated
    row that stays; blank and duplicate rows must go. ``edit`` is K, R or I, for
    inserted rows ``turn`` is null. A null role or text is one space, so such a
    text is blank. Conversation ids and turns are integers, null is an id of its
    own; repeated rows are duplicates; an empty table gives an empty result.
    Other columns are not read.
    """
    plain = _prepared(rows, conv_col, turn_col, role_col, text_col)
    return _mended(plain, _plans(plain)).select(_id(), F.col("at").alias("position"), "edit", F.col("t").alias("turn"), "role", "text")


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: faults, cost, edits and the SHA-256 of what ``repair`` makes of it.

    ``gaps`` are the missing numbers between the least and greatest turn. Of a
    row's faults the first counts: blank (white space only), duplicate (role and
    text, by 128 bits, seen earlier), truncated (last sign not ``.``, ``!`` or
    ``?``). ``illegal`` counts neighbours whose role initials aren't su, ua or au.
    ``audit`` has the edits' initials, D for deleted rows. Odd rows as in ``repair``.
    """
    plain = _prepared(rows, conv_col, turn_col, role_col, text_col)
    plans = _plans(plain)
    digests = _mended(plain, plans).select("k", "at", "role", "text").mapInArrow(lean(_digest), "k long, sha string")
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return plans.join(digests, "k", "left").select(_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``,
    3 repeats it with the same turn, 4 makes it the user's. Nulls count as one
    space, in the hashed text too; a null turn stays null.
    """
    said = [F.coalesce(column(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    h = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    hashed = rows.select("conv_id", "turn", said[2].alias("role"), said[3].alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hashed.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")
