"""Chat formatting: schema fingerprints select declarative mappings.

A record's layout is the set of its nested field paths that any mapping reads;
other fields don't count. The fingerprint, a hash of that set, picks the declared
mapping that turns the layout, of JSON or of typed columns, into canonical turns (role, text); the turns are then
written in one template. Marks are
``<|im_start|>role<|im_sep|>text<|im_end|>\\n``. Inside roles and texts the
backslash is doubled and one more is put behind the first character of each
control string, so no mark can be forged and reading back is exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import column, packed

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character of a control string of this or a common other template.
_TAILS = r"(?=\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
TURNS = "array<struct<role:string,text:string>>"

#: The text of a field: a string, or the texts of a list of parts, joined.
_CONTENT = """CASE WHEN schema_of_variant({0}) LIKE 'ARRAY%' THEN array_join(transform(variant_get({0}, '$', 'array<variant>'), p ->
    coalesce(try_variant_get(p, '$.text', 'string'), IF(schema_of_variant(p) = 'STRING', variant_get(p, '$', 'string'), NULL))), '')
    ELSE variant_get({0}, '$', 'string') END"""
#: Whether that is all of the field: no part is without text.
_WHOLE = """NOT coalesce(schema_of_variant({0}) LIKE 'ARRAY%' AND exists(variant_get({0}, '$', 'array<variant>'),
    p -> try_variant_get(p, '$.text', 'string') IS NULL AND schema_of_variant(p) <> 'STRING'), false)"""


class Listed(NamedTuple):
    """Turns are the items of the list ``field``: their ``role``, renamed by ``names``, and ``text``."""

    field: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


class Said(NamedTuple):
    """Fixed turns: a role and the fields whose texts, joined by an empty line, it says; fields but the first may be empty."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


#: Layout: the paths it reads (``[]``: in any item of a list) and the mapping to turns.
LAYOUTS: dict[str, tuple[tuple[str, ...], Listed | Said]] = {
    "messages": (("messages", "messages[].content", "messages[].role"), Listed("messages", "role", "content")),
    "turns": (("turns", "turns[].role", "turns[].text"), Listed("turns", "role", "text")),
    "from_value": (("conversations", "conversations[].from", "conversations[].value"), Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))),
    "prompt_response": (("prompt", "response"), Said((("user", ("prompt",)), ("assistant", ("response",))))),
    "prompt_completion": (("completion", "prompt"), Said((("user", ("prompt",)), ("assistant", ("completion",))))),
    "instruction": (("instruction", "output"), Said((("user", ("instruction",)), ("assistant", ("output",))))),
    "instruction_input": (("input", "instruction", "output"), Said((("user", ("instruction", "input")), ("assistant", ("output",))))),
}


def _variant_turns(mapping: Listed | Said) -> Column:
    """The turns of the variant ``v``, by a mapping."""
    if isinstance(mapping, Listed):
        who, said = f"variant_get(m, '$.{mapping.role}', 'string')", f"variant_get(m, '$.{mapping.text}', 'variant')"
        if mapping.names:
            who = f"CASE {who} " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in mapping.names) + f" ELSE {who} END"
        return F.expr(f"transform(variant_get(v, '$.{mapping.field}', 'array<variant>'), m -> "
                      f"named_struct('role', {who}, 'text', {_CONTENT.format(said)}, 'whole', {_WHOLE.format(said)}))")
    turns = []
    for role, fields in mapping.turns:
        at = [f"variant_get(v, '$.{x}', 'variant')" for x in fields]
        texts, whole = [_CONTENT.format(x) for x in at], " AND ".join(_WHOLE.format(x) for x in at)
        text = texts[0] if len(at) == 1 else f"concat_ws('\\n\\n', {texts[0]}, " + ", ".join(f"nullif({x}, '')" for x in texts[1:]) + ")"
        turns.append(f"named_struct('role', '{role}', 'text', {text}, 'whole', {whole})")
    return F.expr(f"array({', '.join(turns)})")


def _typed_turns(mapping: Listed | Said, at: Column) -> Column:
    """The turns of a struct with string fields, by a mapping."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if isinstance(mapping, Listed):
        def renamed(role: Column) -> Column:
            for x, y in mapping.names:
                role = F.when(role == x, y).otherwise(role)
            return role

        return F.transform(at[mapping.field], lambda m: turn(renamed(m[mapping.role]), m[mapping.text]))
    said = lambda fields: at[fields[0]] if len(fields) == 1 else F.concat_ws("\n\n", at[fields[0]], *[F.nullif(at[x], F.lit("")) for x in fields[1:]])
    return F.array(*[turn(F.lit(role), said(fields)) for role, fields in mapping.turns])


#: Lists without an item have none of the inner paths.
EMPTY = {"messages": "messages", "turns": "turns", "conversations": "from_value"}


def _holds(path: str) -> Column:
    """Whether the variant ``v`` holds a path; a JSON null is held."""
    if "[]" in path:
        field, inner = path.split("[].")
        return F.expr(f"exists(try_variant_get(v, '$.{field}', 'array<variant>'), m -> try_variant_get(m, '$.{inner}', 'variant') IS NOT NULL)")
    return F.expr(f"try_variant_get(v, '$.{path}', 'variant') IS NOT NULL" + (f" AND schema_of_variant(variant_get(v, '$.{path}', 'variant')) LIKE 'ARRAY%'" if path in EMPTY else ""))


def field_paths(layouts: dict[str, tuple[tuple[str, ...], Listed | Said]]) -> Column:
    """The sorted paths of the variant ``v`` that any of these layouts reads, joined by commas."""
    every = sorted({p for paths, _ in layouts.values() for p in paths})
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(_holds(p), F.lit(False)), F.lit(p)) for p in every])), ",")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, json_col: str = "record", layouts: dict[str, tuple[tuple[str, ...], Listed | Said]] | None = None) -> DataFrame:
    """``records`` plus ``layout``, ``turns`` and ``error``.

    Fields that no layout reads are ignored. A content may be a list of parts
    with a text. Null or absent roles and texts become empty; a list without
    messages gives no turns and is no error. Any other record has a null layout,
    no turns and says why in ``error``: ``null record``, ``not JSON``, ``not an
    object``, ``a part without text`` (in a list of parts, as an image) or
    ``unknown layout:`` and the known paths that it has. JSON beyond the limits of Spark's parser (20,000,000 signs a
    string, 128 MB a record) can't be told from other texts and is ``not JSON`` too; ``format_rows`` has no such limit. A column with an output's name comes back with ``_input`` behind it.
    Repeated rows get equal results; an empty table gives an empty one.
    """
    layouts = LAYOUTS if layouts is None else layouts
    names = ["layout", "turns", "error", "formatted", "loss_spans"]
    at = records.select(packed(records.columns, names), column(json_col).alias("j"))
    at = at.withColumn("v", F.try_parse_json("j"))
    at = at.withColumn("paths", field_paths(layouts)).withColumn("fp", fingerprint(F.col("paths")))
    kind = "array<struct<role:string,text:string,whole:boolean>>"
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(kind)
    for key, (paths, mapping) in layouts.items():
        hit = F.col("fp") == fingerprint(F.lit(",".join(sorted(paths))))
        name, turns = F.when(hit, F.lit(key)).otherwise(name), F.when(hit, _variant_turns(mapping).cast(kind)).otherwise(turns)
    for field, key in EMPTY.items():
        if key in layouts:
            none = (F.col("fp") == fingerprint(F.lit(field))) & F.expr(f"size(try_variant_get(v, '$.{field}', 'array<variant>')) = 0")
            name = F.when(none, F.lit(key)).otherwise(name)
    at = at.withColumns({"name": name, "said": turns}).withColumn("lost", F.coalesce(F.exists("said", lambda t: ~t["whole"]), F.lit(False)))
    clean = F.transform("said", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    known = F.col("name").isNotNull() & ~F.col("lost")
    why = (F.when(F.col("j").isNull(), "null record").when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
           .when(F.col("lost"), "a part without text").otherwise(F.concat(F.lit("unknown layout: "), "paths")))
    return at.select("r.*", F.when(known, F.col("name")).alias("layout"), F.when(known, F.coalesce(clean, F.array().cast(TURNS))).otherwise(F.array().cast(TURNS)).alias("turns"),
                     F.when(~known, why).alias("error"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _TAILS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + _TAILS, "$1"), F.lit("\\\\"), F.lit("\\"))


def render(turns: Column) -> Column:
    """The formatted text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Where the formatted text holds assistants' texts: array of (at, n), in code points."""
    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"))

    def add(x: Column, t: Column) -> Column:
        at = x["pos"] + len(START) + F.char_length(escape(t["role"])) + len(SEP)
        n = F.char_length(escape(t["text"]))
        mine = F.when(t["role"] == "assistant", F.array(F.struct(at.alias("at"), n.alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
        return F.struct((at + n + len(END)).alias("pos"), F.concat(x["spans"], mine).alias("spans"))

    return F.aggregate(turns, first, add)["spans"]


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1_000_000_000)

    def turn(p: Column) -> Column:
        x = F.split(p, r"<\|im_(?:sep|end)\|>")
        return F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["at"] + 1, s["n"]))), "")


def _schema_paths(t: D.DataType, at: str = "") -> list[str]:
    """The field paths of a type, as in ``LAYOUTS``."""
    if isinstance(t, D.StructType):
        return [p for f in t.fields for p in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    inner = _schema_paths(t.elementType, f"{at}[]") if isinstance(t, D.ArrayType) else []
    return [at, *inner]


def messages_of(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, messages): each conversation's rows, by turn, as an array of (role, content).

    Equal turn numbers are ordered by role and text; a null turn comes first; null roles and texts are empty.
    """
    line = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(line)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(id_col).agg(messages.alias("messages"))


def records_of(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, record): each conversation's rows, by turn, as a JSON record of the ``messages`` layout."""
    return messages_of(rows, id_col).select(id_col, F.to_json(F.struct("messages")).alias("record"))


def typed_turns(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` plus ``layout`` and ``turns`` of typed columns ``fields``: the fingerprint of their nested paths selects the mapping.

    Null roles and texts become empty. A type that no layout reads is an error.
    """
    typed = D.StructType([rows.schema[f] for f in fields])
    paths = sorted(_schema_paths(typed))
    at = rows.withColumn("fp", fingerprint(F.lit(",".join(paths))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, (known, mapping) in LAYOUTS.items():
        if set(known) <= set(paths):  # others can't be built on these columns
            hit = F.col("fp") == fingerprint(F.lit(",".join(sorted(known))))
            name, turns = F.when(hit, F.lit(key)).otherwise(name), F.when(hit, _typed_turns(mapping, F.struct(*[column(f) for f in fields]))).otherwise(turns)
    none = F.raise_error(F.lit("unknown layout: " + ",".join(paths)))
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return at.withColumns({"layout": F.coalesce(name, none.cast("string")), "turns": clean}).drop("fp")


def format_rows(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, ``layout``, ``turns``, ``formatted``, ``loss_spans``) of each conversation's rows; the fingerprint of their schema selects the mapping.

    Nothing is written as JSON, so neither a long text nor a long conversation meets the parser's limits. Columns of
    ``rows`` other than the id, turn, role and text aren't looked at; an empty table gives an empty result.
    """
    at = typed_turns(messages_of(rows, id_col), ["messages"]).select(id_col, "layout", "turns")
    return at.withColumns({"formatted": render(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def format_chats(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` plus ``layout``, ``turns``, ``error``, ``formatted`` and ``loss_spans``; what ``canonical_turns`` says holds here."""
    at = canonical_turns(records, json_col)
    return at.withColumns({"formatted": render(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})
