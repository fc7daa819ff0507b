"""Chat formatting by schema fingerprints; DataFrame functions only.

Records come as VARIANT values in many layouts.  The field paths of a record
(without its scalar types) are hashed; the hash selects a declarative mapping
that yields canonical turns (role, text).  Turns are written with a reversible
template and can be read back, with the loss mask over assistant texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout by example, and where its turns are.

    ``fields``: (role, path) per turn, in order; a turn whose value is null is
    left out.  ``each``: path of an array of messages with ``role`` and
    ``text`` keys.  ``row``: the record is itself one turn with these keys.
    """

    name: str
    example: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    row: bool = False


#: The layouts known without further ado.
MAPPINGS = (
    Mapping("row", '{"conv_id":1,"turn":0,"role":"a","text":"b"}', row=True, text="text"),
    Mapping("messages", '{"messages":[{"role":"a","content":"b"}]}', each="messages"),
    Mapping("conversations", '{"conversations":[{"from":"a","value":"b"}]}', each="conversations", role="from", text="value"),
    Mapping("nested_chat", '{"chat":{"turns":[{"speaker":"a","utterance":"b"}]}}', each="chat.turns", role="speaker", text="utterance"),
    Mapping("instruction", '{"instruction":"a","output":"b"}', (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", '{"instruction":"a","input":"b","output":"c"}', (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_completion", '{"prompt":"a","completion":"b"}', (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", '{"prompt":"a","response":"b"}', (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt", '{"system":"s","prompt":"a","response":"b"}', (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", '{"question":"a","answer":"b"}', (("user", "question"), ("assistant", "answer"))),
)

#: Role names of other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def paths(record: Column) -> Column:
    """Nested field paths of a VARIANT as text: its schema without scalar types, keys in order."""
    schema = F.schema_of_variant(record)
    bare = F.regexp_replace(schema, r": (?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|BINARY|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\([0-9]+,[0-9]+\))(?=[,>])", "")
    return F.regexp_replace(bare, r"ARRAY<(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT)>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    """64-bit hash of the field paths; null for a null record."""
    return F.when(record.isNotNull(), F.xxhash64(paths(record)))


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _turns(record: Column, m: Mapping) -> Column:
    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        for old, new in ROLES.items():
            role = F.when(role == old, new).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if m.row:
        return F.array(turn(_get(record, m.role), _get(record, m.text)))
    if m.each:
        return F.coalesce(F.transform(_get(record, m.each, "array<variant>"), lambda x: turn(_get(x, m.role), _get(x, m.text))), F.array().cast(TURN))
    found = F.array(*[F.when(_get(record, path).isNotNull(), turn(F.lit(role), _get(record, path))) for role, path in m.fields])
    return F.filter(found, lambda t: t.isNotNull())


def canonical(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with fingerprint, layout and turns of its VARIANT column.

    A layout without a mapping, and a null record: layout null, no turns; the
    row stays.  Null texts are empty, null roles are ''.  Clashing columns are
    replaced.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("fingerprint", "layout", "turns")])
    df = df.withColumn("fingerprint", fingerprint(F.col(record_col)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    for m in reversed(mappings):
        here = F.col("fingerprint") == fingerprint(F.parse_json(F.lit(m.example)))
        layout = F.when(here, m.name).otherwise(layout)
        turns = F.when(here, _turns(F.col(record_col), m)).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns})


# Escapes: a backslash, and the characters that start or end a mark, become a
# backslash and a letter; so no mark can be inside an escaped text.
_ESCAPES = (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, header: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, coded in _ESCAPES if header else _ESCAPES[:2]:
        out = F.replace(out, F.lit(raw), F.lit(coded))
    return out


def unescape(text: Column, header: bool = False) -> Column:
    """Pieces between doubled backslashes hold only single escapes."""

    def piece(p: Column) -> Column:
        for raw, coded in _ESCAPES if header else _ESCAPES[:2]:
            p = F.replace(p, F.lit(coded), F.lit(raw))
        return p

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")).otherwise(text)


def template(turns: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(COLON), escape(t["text"]), F.lit(CLOSE))), "")


def _pieces(formatted: Column) -> Column:
    return F.filter(F.split(formatted, CLOSE), lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """Turns back from the formatted text."""

    def turn(p: Column) -> Column:
        at = F.instr(p, COLON)
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), True).alias("role"), unescape(F.substring(p, at + len(COLON), F.length(p))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def loss_mask(formatted: Column) -> Column:
    """Spans (start, end in code points, end exclusive) of the escaped assistant texts within the formatted text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    head = OPEN + "assistant" + COLON

    def add(state: Column, p: Column) -> Column:
        begin, end = state["at"] + len(head), state["at"] + F.length(p)
        spans = F.when(F.startswith(p, F.lit(head)), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(_pieces(formatted), start, add, lambda s: s["spans"])


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_chats(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with turns, formatted text and loss_mask, one record per conversation."""
    out = canonical(df, record_col, mappings).withColumn("formatted", template(F.col("turns")))
    return out.withColumn("loss_mask", loss_mask(F.col("formatted")))


def format_rows(rows: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per conv_id of a table with a row per turn (conv_id, turn, role, text): turns, formatted, loss_mask.

    Rows go by turn, null turns first, equal turns by role and text; repeated
    rows stay.  Null texts are empty; rows with a null conv_id are one
    conversation.  A conversation becomes one text, so its rows meet in one task.
    """
    known = rows.select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"), "turn")
    single = canonical(known, "record", mappings).select("conv_id", F.struct("turn", F.col("turns")[0].alias("said")).alias("t"))
    grouped = single.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["said"]).alias("turns"))
    out = grouped.withColumn("formatted", template(F.col("turns")))
    return out.withColumn("loss_mask", loss_mask(F.col("formatted")))
