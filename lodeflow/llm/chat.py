"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is the set of its nested field paths that any mapping knows; other fields (an id, a source) are kept aside. The
fingerprint, a SHA-256 of those paths in order, is looked up among the mappings' fingerprints, and the declarative mapping found
turns the layout (prompt and response, instruction with input, lists of messages, rows by turn) into canonical turns: an array
of (role, text). A JSON record's paths are read from its own schema and hashed row by row, a typed frame's once from its schema.

The template writes each turn as ``### role: text</turn>`` and a newline. A backslash is doubled, ``##`` becomes ``#\\#`` and
``</turn>`` becomes ``<\\/turn>`` in roles and texts (and ``:`` becomes ``\\:`` in roles), so no text holds a mark, and taking
one backslash before any character away reads it back.

Defined cases: null roles and texts of rows by turn are empty, and ``formatted`` writes any null as empty; turns sort by turn
(nulls first), then role, then text; rows that repeat are turns of their own; an empty table gives no conversation; a layout
that no mapping has gives null turns and its fingerprint, for a mapping to be declared; a list without elements has no fields;
very long texts are formatted whole; other columns are kept aside, those named as a result (turns, fingerprint) are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.llm.common import free_name

TURNS = "array<struct<role:string,text:string>>"
END = "</turn>"


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; ``[]`` stands for the elements of a list."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(found: list[str]) -> str:
    """SHA-256 of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """A layout: (role, path of the text) for each turn in order, or the paths of a list's roles and texts.

    ``lead`` names a path whose text is put before the first turn's, after an empty line where both are there.
    """

    said: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str] | None = None
    lead: str | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        return self.listed or (*([self.lead] if self.lead else []), *(path for _, path in self.said))

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.fields))

    def turns(self, record: Column) -> Column:
        """The turns of a record, a struct with the layout's fields."""
        if self.listed:
            (head, role), (_, text) = (f.split("[].") for f in self.listed)
            name = lambda r: F.when(r == "human", "user").when(r.isin("gpt", "bot"), "assistant").otherwise(r)
            return F.transform(record[head], lambda x: F.struct(name(x[role]).alias("role"), x[text].cast("string").alias("text")))
        made = []
        for role, path in self.said:
            text = record[path].cast("string")
            if self.lead and not made:
                text = F.array_join(F.filter(F.array(record[self.lead].cast("string"), text), lambda x: x != ""), "\n\n")
            made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        return F.array(*made)


MAPPINGS: tuple[Mapping, ...] = (
    Mapping((("user", "prompt"), ("assistant", "response"))),
    Mapping((("user", "prompt"), ("assistant", "completion"))),
    Mapping((("user", "question"), ("assistant", "answer"))),
    Mapping((("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping((("system", "system"), ("user", "question"), ("assistant", "response"))),
    Mapping((("user", "instruction"), ("assistant", "output"))),
    Mapping((("user", "instruction"), ("assistant", "response"))),
    Mapping((("user", "input"), ("assistant", "output")), lead="instruction"),
    Mapping(listed=("messages[].role", "messages[].content")),
    Mapping(listed=("conversations[].from", "conversations[].value")),
    Mapping(listed=("turns[].role", "turns[].text")),
)
#: Rows by turn: one row of the frame is a turn of the conversation that conv_id names.
BY_TURN = ("conv_id", "turn", "role", "text")


def layouts(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """The mappings by fingerprint; no two may share one."""
    out = {m.fingerprint: m for m in mappings}
    if len(out) < len(mappings):
        raise ValueError("two mappings have the same field paths")
    return out


def _known(mappings: tuple[Mapping, ...]) -> set[str]:
    return {f for m in mappings for f in m.fields}


def _json_schema(fields: tuple[str, ...]) -> str:
    """DDL of a layout's fields, all of them strings."""
    flat = [f for f in fields if "[]." not in f]
    nested: dict[str, list[str]] = {}
    for f in fields:
        if "[]." in f:
            a, b = f.split("[].")
            nested.setdefault(a, []).append(b)
    return ", ".join([*(f"`{f}` string" for f in flat), *(f"`{a}` array<struct<{', '.join(f'`{b}`:string' for b in bs)}>>" for a, bs in nested.items())])


def typed_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A typed frame's records as turns: the columns besides the layout's stay. Rows by turn become one row for each conv_id."""
    found = paths(df.schema)
    if fingerprint([p for p in found if p in BY_TURN]) == fingerprint(list(BY_TURN)):
        own = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    known = _known(mappings)
    best = layouts(mappings).get(fingerprint([p for p in found if p in known]))
    if best is None:
        return df.select(*(c for c in df.columns if c != "turns"), F.lit(None).cast(TURNS).alias("turns"))
    used = {f.split("[]")[0].split(".")[0] for f in best.fields}
    return df.select(*(c for c in df.columns if c not in used and c != "turns"), best.turns(F.struct(*sorted(used))).alias("turns"))


_NAME = r"(?:`(?:[^`]|``)*+`|[^\s<>,:`]++): "


def json_paths(record: Column) -> Column:
    """The nested field paths of JSON records, from the record's own schema; null for what isn't JSON.

    The schema's text is read from left to right with a stack of names, lists and objects: a kind of value ends a path. Elements
    of a list count together, so a list has the fields of all its elements.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    parts = F.regexp_extract_all(schema, F.lit(rf"({_NAME}|OBJECT<|ARRAY<|>|[A-Z]++(?:\([0-9, ]++\))?)"), F.lit(1))
    none = F.array().cast("array<string>")
    up = lambda stack: F.slice(stack, F.lit(1), F.size(stack) - 1)
    # a value that has ended leaves the stack, and the name it belongs to with it
    ended = lambda stack: F.when(F.element_at(F.concat(F.array(F.lit("[]")), stack), -1).isin("[]", "{"), stack).otherwise(up(stack))
    path = lambda stack: F.regexp_replace(F.array_join(F.filter(stack, lambda x: x != "{"), "."), r"\.\[\]", "[]")

    def read(s: Column, x: Column) -> Column:
        stack, out = s["stack"], s["out"]
        name = F.regexp_replace(F.regexp_replace(x, r"^`?|`?: $", ""), "``", "`")
        opens = F.when(x == "OBJECT<", "{").when(x == "ARRAY<", "[]").when(x.endswith(": "), name)
        return F.when(opens.isNotNull(), F.struct(F.concat(stack, F.array(opens)).alias("stack"), out.alias("out"))).when(
            x == ">", F.struct(ended(up(stack)).alias("stack"), out.alias("out"))
        ).otherwise(F.struct(ended(stack).alias("stack"), F.concat(out, F.array(path(stack))).alias("out")))

    return F.aggregate(parts, F.struct(none.alias("stack"), none.alias("out")), read, lambda s: F.array_distinct(s["out"]))


def json_turns(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """JSON records of mixed layouts: adds the row's fingerprint and its turns; what isn't JSON has neither."""
    by = layouts(mappings)
    known = F.array(*(F.lit(p) for p in sorted(_known(mappings))))
    name = free_name(df.columns, "layout")
    own = F.sha2(F.array_join(F.array_sort(F.array_intersect(json_paths(F.col(record)), known)), "\n"), 256)
    out = df.withColumn(name, own)
    turns = F.lit(None).cast(TURNS)
    for found, m in by.items():
        turns = F.when(F.col(name) == found, m.turns(F.from_json(F.col(record), _json_schema(m.fields)))).otherwise(turns)
    return out.select(*(c for c in df.columns if c not in ("fingerprint", "turns")), F.col(name).alias("fingerprint"), turns.alias("turns"))


def escaped(text: Column, *, role: bool = False) -> Column:
    """``text`` without any control string of the template."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescaped(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """Turns in the template, as one string."""
    one = F.transform(turns, lambda t: F.concat(F.lit("### "), escaped(F.coalesce(t["role"], F.lit("")), role=True), F.lit(": "), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(f"{END}\n")))
    return F.array_join(one, "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    marked = F.filter(F.split(text, f"{END}\n", -1), lambda x: x != "")
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(marked, lambda x: F.struct(unescaped(F.regexp_extract(x, head, 1)).alias("role"), unescaped(F.regexp_extract(x, head, 2)).alias("text")))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each text of the role once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digests(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Figures of (key, turns), all read back from the formatted strings."""
    out = conversations.select(key, formatted(F.col("turns")).alias("formatted")).withColumn("turns", read_back(F.col("formatted")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return out.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
