"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records arrive in unlike layouts (message lists, prompt and response, instruction and input, ...). The
nested field paths of a record, hashed, are its fingerprint; the fingerprint selects a declarative
mapping, and the mapping's expressions give the canonical turns (role, text).

A formatted turn is ``<turn>### role: text</turn>`` and a line end. Inside roles and texts four
characters are written as two: ``\\`` as ``\\b``, ``<`` as ``\\l``, ``#`` as ``\\h``, ``:`` as ``\\c``. No
marker can then arise inside a text, a split at the markers is exact, and reading back restores every
character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>### ", "</turn>\n"
#: Escapes in the order of writing; they are undone in the opposite order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
LOSS_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that identify it and the SQL expression of its turns over ``__record``."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _get(path: str) -> str:
    return f"coalesce(try_variant_get(__record, '{path}', 'string'), '')"


def _listed(path: str, role: str, text: str) -> str:
    return (
        f"transform(coalesce(try_variant_get(__record, '{path}', 'array<struct<{role}:string,{text}:string>>'), array()),"
        f" x -> named_struct('role', coalesce(x.`{role}`, ''), 'text', coalesce(x.`{text}`, '')))"
    )


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


#: Layouts that are understood. A field path is ``a.b``, a list item ``a[]``.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), _listed("$.messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), _listed("$.turns", "role", "text")),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), _listed("$.conversations", "from", "value")),
    Mapping("prompt_response", ("prompt", "response"), f"array({_turn('user', _get('$.prompt'))}, {_turn('assistant', _get('$.response'))})"),
    Mapping("prompt_completion", ("completion", "prompt"), f"array({_turn('user', _get('$.prompt'))}, {_turn('assistant', _get('$.completion'))})"),
    Mapping("instruction", ("instruction", "output"), f"array({_turn('user', _get('$.instruction'))}, {_turn('assistant', _get('$.output'))})"),
    Mapping(
        "instruction_input",
        ("input", "instruction", "output"),
        f"array({_turn('user', 'concat_ws(chr(10), ' + _get('$.instruction') + ', nullif(' + _get('$.input') + ', chr(39)||chr(39)))')}, {_turn('assistant', _get('$.output'))})".replace("chr(39)||chr(39)", "''"),
    ),
)


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a variant, joined by commas.

    They are read off the variant's schema: types are dropped, a list of objects contributes ``[]``.
    Supports objects whose values are scalars, or lists of flat objects.
    """
    shape = F.schema_of_variant(record)
    shape = F.regexp_replace(shape, r"^OBJECT<(.*)>$", "$1")
    # items: a: ARRAY<OBJECT<x: STRING, y: STRING>> becomes a[].x and a[].y
    item = F.regexp_extract_all(shape, F.lit(r"(`[^`]*`|[^,:<> ]+): (ARRAY<OBJECT<[^<>]*>>|OBJECT<[^<>]*>|[A-Z]+(?:\([^)]*\))?(?:<[^<>]*>)?)"), F.lit(0))

    def paths(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(x, r"^(`[^`]*`|[^:]+): ", 1), "`", "")
        inner = F.regexp_extract_all(F.regexp_extract(x, r"OBJECT<([^<>]*)>", 1), F.lit(r"(`[^`]*`|[^,: ]+): "), F.lit(1))
        mark = F.when(x.contains(": ARRAY<OBJECT<"), "[].").otherwise(".")
        return F.when(F.size(inner) > 0, F.transform(inner, lambda y: F.concat(name, mark, F.regexp_replace(y, "`", "")))).otherwise(F.array(name))

    return F.array_join(F.array_sort(F.flatten(F.transform(item, paths))), ",")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, record: str, extra: tuple[Mapping, ...] = ()) -> DataFrame:
    """Add ``turns`` and ``layout`` to ``records``, whose column ``record`` is a variant.

    The record's field paths, hashed, select the mapping. A null record and a record of an unknown layout
    have null ``turns`` and ``layout``; null texts and roles are empty. Lists keep their order. A record is one row
    with all its texts, however long; repeated rows are formatted alike; columns named ``turns`` and ``layout`` are
    replaced. An empty table gives an empty result.
    """
    found = records.drop("turns", "layout").withColumn("__print", fingerprint(field_paths(F.col(record)))).withColumn("__record", F.col(record))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in (*MAPPINGS, *extra):
        chosen = F.col("__print") == fingerprint(F.lit(",".join(sorted(m.paths))))
        turns, layout = F.when(chosen, F.expr(m.turns).cast(TURNS)).otherwise(turns), F.when(chosen, m.name).otherwise(layout)
    return found.withColumns({"turns": turns, "layout": layout}).drop("__print", "__record")


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mixed: bool = False) -> DataFrame:
    """One record per conversation from a table with one row per turn: ``id, record`` (a variant).

    The layout is ``turns``, or with ``mixed`` it goes by the id: ``messages``, ``conversations`` with from and value,
    ``prompt`` and ``response`` where a user's turn and an assistant's are all there is, or ``turns``.

    Turns are ordered by turn, role and text, so ties and repeated rows have one order; a null turn comes
    first, null roles and texts are empty, and null ids form one conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    as_list = lambda name, role, text: F.to_variant_object(F.struct(F.transform("all", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text))).alias(name)))
    record = as_list("turns", "role", "text")
    if mixed:
        kind, one, two = F.pmod(F.col("id"), F.lit(4)), F.get("all", F.lit(0)), F.get("all", F.lit(1))
        pair = (F.size("all") == 2) & (one["role"] == "user") & (two["role"] == LOSS_ROLE)
        both = F.to_variant_object(F.struct(one["text"].alias("prompt"), two["text"].alias("response")))
        record = F.when(kind == 0, as_list("messages", "role", "content")).when(kind == 1, as_list("conversations", "from", "value")).when((kind == 2) & pair, both).otherwise(record)
    return listed.select("id", record.alias("record"))


def escaped(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def formatted(turns: Column) -> Column:
    """The training text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(": "), escaped(t["text"]), F.lit(CLOSE))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted text, with ``start`` and ``length`` (code points) of each escaped text in it."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    raw = F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ":", 1)).alias("role"),
            F.substr(p, F.locate(":", p) + F.lit(2)).alias("coded"),
            F.locate(":", p).alias("colon"),
            F.char_length(p).alias("chars"),
        ),
    )
    start = lambda acc, p: F.struct((acc["at"] + p["chars"] + F.lit(len(CLOSE))).alias("at"), F.concat(acc["out"], F.array(F.struct(p["role"].alias("role"), unescaped(p["coded"]).alias("text"), (acc["at"] + p["colon"] + F.lit(1)).alias("start"), F.char_length(p["coded"]).alias("length")))).alias("out"))
    empty = F.array().cast("array<struct<role:string,text:string,start:int,length:int>>")
    return F.aggregate(raw, F.struct(F.lit(0).alias("at"), empty.alias("out")), start, lambda acc: acc["out"])


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``formatted`` (text) and ``loss_spans`` (start and length of each assistant text in it).

    Rows of unknown layouts keep null in both. Loss spans are ordered and never touch markers.
    """
    out = canonical_turns(records, record).withColumn("formatted", formatted(F.col("turns")))
    spans = F.transform(F.filter(read_back(F.col("formatted")), lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.withColumn("loss_spans", spans)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + F.lit(1), s["length"]))), "")
