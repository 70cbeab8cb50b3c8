"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records of many layouts come as JSON or as a struct column. Each record's nested field paths (``schema_of_variant``
without the scalar types, in a fixed order) are hashed; the hash selects a declarative mapping that gives canonical
turns ``array<struct<role, text>>``. A record of a schema that no mapping names is given to the first mapping whose
leading paths it has. Of a struct only the skeleton, its fields without their texts, becomes a variant, so its
texts may be of any size. JSON of more than ``VARIANT_BYTES`` is too large for a variant; it is read by the fields
that the layouts name, and its layout found by leading paths alone. Turns are put into one template; texts are escaped so that no control string can occur
in them, and can be read back. The loss mask is the list of (start, length) of assistant texts, in code points.

Defined results: malformed JSON has layout ``malformed``, a layout nobody knows ``unknown``; both have no turns
and an empty text. JSON over ``VARIANT_BYTES`` has a null fingerprint; it is never ``malformed`` for its size. A null text or role is an empty one. Equal rows are equal turns. Rows of a conversation go by
turn, then role, then text, nulls first; rows with a null conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .common import stored

TURNS = "array<struct<role string, text string>>"
#: JSON up to this size is read as a variant (which Spark bounds, and which may be a few times as large as its JSON).
VARIANT_BYTES = 4 << 20
#: Other names of roles, for layouts that have their own.
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How to read one kind of record.

    name: of the layout. shapes: the nested field paths of its records, one for each set of optional fields.
    leading: paths that a record of an unnamed schema must have. turns: a mapping to turns, either
    (array path, role field, text field) or (role, path) pairs, of which absent or empty ones are left out.
    """

    name: str
    shapes: tuple[str, ...]
    leading: tuple[str, ...]
    turns: tuple

    def expression(self, v: Column) -> Column:
        """The turns of a variant."""
        if isinstance(self.turns[0], str):
            path, role, text = self.turns
            return self._items(F.try_variant_get(v, path, f"array<struct<`{role}` string, `{text}` string>>"))
        return self._parts([(role, F.try_variant_get(v, path, "string")) for role, path in self.turns])

    def of_struct(self, record: Column, kind: StructType) -> Column | None:
        """The turns of a struct, or None if its type lacks the fields."""
        if isinstance(self.turns[0], str):
            path, role, text = self.turns
            items = kind[path[2:]].dataType if path[2:] in kind.names else None
            if not isinstance(items, ArrayType) or not isinstance(items.elementType, StructType) or not {role, text} <= set(items.elementType.names):
                return None
            return self._items(F.transform(record[path[2:]], lambda x: F.struct(x[role].cast("string").alias(role), x[text].cast("string").alias(text))))
        if not {p[2:] for p in self.leading} <= set(kind.names):
            return None
        return self._parts([(role, record[path[2:]].cast("string")) for role, path in self.turns if path[2:] in kind.names])

    def _items(self, items: Column) -> Column:
        _, role, text = self.turns
        named = lambda x: x[role] if role == "role" else F.coalesce(*(F.when(F.lower(x[role]) == k, F.lit(r)) for k, r in ROLES.items()), x[role])
        return F.transform(items, lambda x: F.struct(F.coalesce(named(x), F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))).cast(TURNS)

    def _parts(self, found: list[tuple[str, Column]]) -> Column:
        every = F.filter(F.array(*(F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in found)), lambda x: F.coalesce(x["text"], F.lit("")) != "")
        return F.when(found[-1][1].isNotNull(), every).cast(TURNS)


LAYOUTS = (
    Layout("messages", ("{messages[{content,role}]}", "{id,messages[{content,role}]}", "{messages[{content,role}],source}"), ("$.messages[0].role", "$.messages[0].content"), ("$.messages", "role", "content")),
    Layout("shares", ("{conversations[{from,value}]}", "{conversations[{from,value}],id}"), ("$.conversations[0].from", "$.conversations[0].value"), ("$.conversations", "from", "value")),
    Layout("dialogue", ("{turns[{role,text}]}", "{id,turns[{role,text}]}"), ("$.turns[0].role", "$.turns[0].text"), ("$.turns", "role", "text")),
    Layout("instruction", ("{instruction,output}", "{input,instruction,output}", "{input,instruction,output,system}", "{instruction,output,system}"), ("$.instruction", "$.output"),
           (("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("prompt", ("{completion,prompt}", "{completion,prompt,system}"), ("$.prompt", "$.completion"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("response", ("{prompt,response}", "{prompt,response,system}"), ("$.prompt", "$.response"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", ("{answer,question}", "{answer,context,question}"), ("$.question", "$.answer"), (("user", "$.context"), ("user", "$.question"), ("assistant", "$.answer"))),
)


#: All fields that layouts name, and where a text that is no JSON goes.
_CORRUPT = "_corrupt"
WIDE = StructType()
for _lay in LAYOUTS:
    if isinstance(_lay.turns[0], str):
        WIDE.add(_lay.turns[0][2:], ArrayType(StructType().add(_lay.turns[1], StringType()).add(_lay.turns[2], StringType())))
for _path in sorted({path[2:] for lay in LAYOUTS if not isinstance(lay.turns[0], str) for _, path in lay.turns}):
    WIDE.add(_path, StringType())
WIDE.add(_CORRUPT, StringType())


def field_paths(v: Column) -> Column:
    """The nested field paths of a variant, without scalar types: ``{messages[{content,role}]}``."""
    s = F.schema_of_variant(v)
    s = F.regexp_replace(s, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "")
    s = F.regexp_replace(F.regexp_replace(s, "(: )?OBJECT<", "{"), "(: )?ARRAY<", "[")
    # Closing marks are equal for both kinds; which one it is follows from the opening ones.
    return F.replace(F.regexp_replace(s, ", ", ","), F.lit(">"), F.lit("}"))


def fingerprint(v: Column) -> Column:
    return F.md5(field_paths(v))


def _known(shape: str) -> str:
    return hashlib.md5(shape.replace("]", "}").encode()).hexdigest()


def canonical(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to rows with a JSON text or a struct."""
    kind = records.schema[record_col].dataType
    record, v = F.col(record_col), F.col("_v")
    if isinstance(kind, StructType):
        taken = records.withColumn("_v", F.try_parse_json(F.to_json(_skeleton(record, kind))))
        mapped = {lay.name: lay.of_struct(record, kind) for lay in LAYOUTS}
        malformed, large = record.isNull(), F.lit(False)
    else:
        large = F.octet_length(record_col) > VARIANT_BYTES
        taken = records.withColumn("_v", F.when(~large, F.try_parse_json(record)))
        taken = taken.withColumn("_r", F.from_json(F.when(large, record), WIDE, {"columnNameOfCorruptRecord": _CORRUPT, "maxStringLen": str(2**31 - 1)}))
        malformed = F.when(large, F.col(f"_r.{_CORRUPT}").isNotNull()).otherwise(v.isNull())
        mapped = {lay.name: F.when(large, lay.of_struct(F.col("_r"), WIDE)).otherwise(lay.expression(v)) for lay in LAYOUTS}
    named = F.coalesce(*(F.when(F.col("fingerprint").isin([_known(s) for s in lay.shapes]), F.lit(lay.name)) for lay in LAYOUTS))
    leading = F.coalesce(*(F.when(_all(F.try_variant_get(v, p, "string").isNotNull() for p in lay.leading), F.lit(lay.name)) for lay in LAYOUTS))
    if not isinstance(kind, StructType):
        wide = F.coalesce(*(F.when(_all(_at(F.col("_r"), p).isNotNull() for p in lay.leading), F.lit(lay.name)) for lay in LAYOUTS))
        leading = F.when(large, wide).otherwise(leading)
    taken = taken.withColumn("fingerprint", fingerprint(v))
    taken = taken.withColumn("layout", F.when(malformed, F.lit("malformed")).otherwise(F.coalesce(named, leading, F.lit("unknown"))))
    turns = F.coalesce(*(F.when(F.col("layout") == name, found) for name, found in mapped.items() if found is not None), F.array().cast(TURNS))
    return taken.withColumn("turns", turns).drop("_v", "_r")


def _skeleton(c: Column, kind: DataType) -> Column:
    """``c`` with each text, number or date emptied, and of an array's elements each kind once."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(_skeleton(c[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.array_distinct(F.transform(c, lambda x: _skeleton(x, kind.elementType)))
    return F.when(c.isNotNull(), F.lit(""))


def _at(record: Column, path: str) -> Column:
    """What lies at a path like ``$.messages[0].role`` in a struct."""
    for step in path[2:].replace("[0]", ".[0]").split("."):
        record = F.get(record, 0) if step == "[0]" else record[step]
    return record


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# The template. In escaped texts each backslash begins an escape, and "<" doesn't occur.
_OPEN, _MID, _CLOSE = '<turn role="', '">\n', "\n</turn>\n"
_TEXT = (("\\", "\\s"), ("<", "\\l"))
_ROLE = (*_TEXT, ('"', "\\q"), ("\n", "\\n"))


def _escaped(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _plain(c: Column, pairs) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def formatted(canonical_records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (start from 0 and length in code points of each assistant text)."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(_OPEN), _escaped(t["role"], _ROLE), F.lit(_MID)).alias("head"), _escaped(t["text"], _TEXT).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = canonical_records.withColumn("_p", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def step(acc, p):
        begin, size = acc["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(_CLOSE)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return out.withColumn("loss_mask", F.aggregate("_p", start, step, lambda acc: acc["spans"])).drop("_p")


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, _CLOSE), lambda p: p != "")

    def turn(p):
        end = F.locate(_MID, p)
        return F.struct(_plain(F.substring(p, F.lit(len(_OPEN) + 1), end - len(_OPEN) - 1), _ROLE).alias("role"), _plain(F.substring(p, end + len(_MID), F.length(p)), _TEXT).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: _plain(F.substring(text, m["start"] + 1, m["length"]), _TEXT)), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: the rows of each conversation as a struct of the layout ``messages``."""
    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("r"))
    grouped = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    message = lambda r: F.struct(F.coalesce(r["role"], F.lit("")).alias("role"), F.coalesce(r["text"], F.lit("")).alias("content"))
    return grouped.select("conv_id", F.struct(F.transform("rs", message).alias("messages")).alias("record"))


def digests(output: DataFrame) -> DataFrame:
    """What a formatted output holds, read back from ``formatted`` and ``loss_mask``."""
    read = output.select("conv_id", "formatted", "loss_mask").withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def stored_output(rows: DataFrame) -> DataFrame:
    """The conversations of turn rows, canonical and formatted, written and read again."""
    return stored(formatted(canonical(conversation_records(rows))).select("conv_id", "layout", "formatted", "loss_mask"), "chat")
