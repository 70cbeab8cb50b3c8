"""Cleaning and checking of published strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the gate; line breaks and tabs are control characters too, as published strings have one line.
TAGS, ENTITIES, CONTROLS = r"[<>]", r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});", r"[\x00-\x1F\x7F]"
SPACES = r"[\s\x0B\x85\p{Z}]+"
SCHEMES = r"(?i)javascript:|vbscript:|data:text/html"
TOKENS = r"\b(?:nvapi-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{20,}|gh[opsu]_[A-Za-z0-9]{20,})"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which there is no built-in."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def sanitize(text: Column, compose: bool = True) -> Column:
    out = nfc(text) if compose else text
    for pattern in (TAGS, ENTITIES, CONTROLS):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, SPACES, " "))


def violations(text: Column) -> Column:
    """Names of the rules that a string breaks."""
    rules = (("angle", TAGS), ("control", CONTROLS), ("entity", ENTITIES), ("scheme", SCHEMES), ("token", TOKENS))
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules)))


def thinking(answer: Column, mark: str = "</think>") -> Column:
    """struct<thought, answer>: what stands before the first mark, and the rest, trimmed; without a mark all is answer."""
    at = F.locate(mark, answer)
    return F.struct(F.when(at > 0, F.substring(answer, F.lit(1), at - 1)).otherwise("").alias("thought"), F.trim(F.when(at > 0, F.substring(answer, at + len(mark), F.length(answer))).otherwise(answer)).alias("answer"))


def with_nulls(document: Column, names: list[str]) -> Column:
    """A JSON object to which the named fields, which must be there, come back as nulls where they are missing."""
    missing = F.array_join(F.filter(F.array(*map(F.lit, names)), lambda n: ~F.array_contains(F.json_object_keys(document), n)), '":null,"')
    joint = F.when(document == "{}", "").otherwise(",")
    return F.when(missing == "", document).otherwise(F.concat(F.substring(document, F.lit(1), F.length(document) - 1), joint, F.lit('"'), missing, F.lit('":null}')))


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def is_lineage_url(url: Column) -> Column:
    return is_http(url) & ~url.contains("?") & (F.size(violations(url)) == 0)


#: Most characters and steps of a path; the tolerance of claimed numbers.
PATH_CHARS, PATH_STEPS, NEAR, NEAR_SHARE = 300, 16, 0.05, 0.02
_IDENT = r"[\p{L}\p{N}_]+"
_STEP = rf"{_IDENT}|\[\s*[0-9]+\s*\]|\[\s*{_IDENT}\s*=[^\]]*\]"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed_path(path: Column) -> Column:
    """struct<root, steps: array<struct<kind, name, value>>> of a path; null if it is malformed.

    A path is a root and any number of keys, ``[index]`` and ``[field=value]``; dots stand between keys. Keys may begin with a
    digit, values hold anything but a closing bracket."""
    sound = (F.length(path) <= PATH_CHARS) & path.rlike(rf"^\.*{_IDENT}(?:\.|{_STEP})*$")
    parts = F.regexp_extract_all(path, F.lit(f"({_STEP})"), F.lit(1))

    def step(p):
        inner = F.trim(F.substring(p, F.lit(2), F.length(p) - 2))
        kind = F.when(~p.startswith("["), "key").when(inner.rlike("^[0-9]+$"), "index").otherwise("select")
        name = F.when(kind == "key", p).when(kind == "index", inner).otherwise(F.trim(F.substring_index(inner, "=", 1)))
        return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "select", F.substring(inner, F.locate("=", inner) + 1, F.length(inner))).alias("value"))

    return F.when(sound & (F.size(parts) <= PATH_STEPS), F.struct(F.get(parts, 0).alias("root"), F.transform(F.slice(parts, 2, PATH_STEPS), step).alias("steps")))


def scalar(value: Column) -> Column:
    """struct<kind, text> of a VARIANT that is a number, string, boolean or JSON null (text ``None``); null for anything else."""
    made = F.schema_of_variant(value)
    kind = F.when(made == "VOID", "null").when(made == "BOOLEAN", "boolean").when(made == "STRING", "string").when(made.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("None")).alias("text")))


def _equals(item: Column, text: Column) -> Column:
    """Whether a field has the value of a selector: as a number if the field is one, as text if it is text."""
    own = scalar(item)
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    as_kind = F.when(own["kind"] == "boolean", F.lower(own["text"]) == F.lower(F.trim(text))).when(own["kind"] == "number", own["text"].try_cast("double") == number).otherwise(own["text"] == text)
    return F.coalesce(as_kind, F.lit(False))


def followed(document: Column, steps: Column) -> Column:
    """The scalar that steps lead to in a JSON text, as :func:`scalar` has it; null if they lead nowhere or to a container.
    Values are VARIANT on the way, so types survive. A selector takes the first item that matches."""
    def entered(at, s):
        items = F.try_variant_get(at, "$", "array<variant>")
        fields = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
        chosen = F.get(F.filter(items, lambda x: _equals(F.try_element_at(fields(x), s["name"]), s["value"])), 0)
        return (F.when(s["kind"] == "key", F.try_element_at(fields(at), s["name"]))
                .when(s["kind"] == "index", F.get(items, s["name"].try_cast("int"))).otherwise(chosen))

    return scalar(F.aggregate(steps, F.try_parse_json(document), entered))


def follow(document: Column, steps: Column) -> Column:
    """:func:`followed` as text."""
    return followed(document, steps)["text"]


def resolve_path(document: Column, path: str) -> Column:
    """The scalar at one path of a JSON text, as text; null if there is none or the path is malformed."""
    return follow(document, parsed_path(F.lit(path))["steps"])


def claimed(value: Column) -> Column:
    """A claimed value, as JSON text, typed like what it is held against; what isn't JSON is a string."""
    return F.coalesce(scalar(F.try_parse_json(value)), F.when(value.isNotNull(), F.struct(F.lit("string").alias("kind"), value.alias("text"))))


def scalars_match(a: Column, b: Column) -> Column:
    """Whether a claimed scalar is the true one: numbers within 0.05 or 2 percent, a boolean only if both are."""
    x, y = a["text"].try_cast("double"), b["text"].try_cast("double")
    either, both = ((a["kind"] == "boolean") | (b["kind"] == "boolean")), ((a["kind"] == "number") & (b["kind"] == "number"))
    return F.when(either, (a["kind"] == b["kind"]) & (a["text"] == b["text"])).when(both, F.abs(x - y) <= F.greatest(F.lit(NEAR), NEAR_SHARE * F.abs(y))).otherwise(a["text"] == b["text"])


def values_match(a: Column, b: Column) -> Column:
    """:func:`scalars_match` of JSON texts."""
    return scalars_match(claimed(a), claimed(b))
