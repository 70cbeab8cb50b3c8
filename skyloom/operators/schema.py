"""JSON Schemas as one Column, and folders of documents held against their schemas and their manifest.

A schema is compiled once into an expression over VARIANT that lists what a document violates, each with its path
(``$.wards[3].pm25: maximum``), so a folder of any size is checked where its files are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contract

#: JSON types by the kinds of VARIANT.
KINDS = {"null": "^VOID$", "boolean": "^BOOLEAN$", "string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "object": "^OBJECT", "array": "^ARRAY"}
FORMATS: dict[str, Callable[[Column], Column]] = {"date": contract.iso_date, "date-time": contract.iso_time}


def _none() -> Column:
    return F.array().cast("array<string>")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.flatten(F.transform(F.array(value), use))


def _followed(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen or not ref.startswith("#/"):
            raise ValueError(f"{ref}: only definitions of the same schema that don't hold themselves")
        seen, found = (*seen, ref), root
        for part in ref[2:].split("/"):
            found = found[part]
        schema = found | {k: v for k, v in schema.items() if k != "$ref"}
    return schema, seen


def violations(document: Column, schema: dict) -> Column:
    """What a JSON text violates of a schema, as an array of ``path: rule`` in the schema's order; a text that is no JSON: ``$: json``.

    Known are type, enum, const, minimum, maximum and their exclusive forms, minLength, maxLength, pattern, format (date,
    date-time), required, properties, additionalProperties, items, minItems, maxItems, anyOf and ``$ref`` within the schema."""
    parsed = F.try_parse_json(document)
    return F.when(parsed.isNull(), F.array(F.lit("$: json"))).otherwise(_bound(parsed, lambda v: _violations(v, schema, schema, F.lit("$"), ())))


def _violations(value: Column, schema: dict, root: dict, path: Column, seen: tuple[str, ...]) -> Column:
    schema, seen = _followed(schema, root, seen)
    kind = F.schema_of_variant(value)
    is_ = lambda name: kind.rlike(KINDS[name])
    said = lambda rule: F.array(F.concat(path, F.lit(f": {rule}")))
    unless = lambda ok, rule: F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(said(rule))
    parts: list[Column] = []
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    rules = {"minimum": lambda v: number >= v, "maximum": lambda v: number <= v, "exclusiveMinimum": lambda v: number > v, "exclusiveMaximum": lambda v: number < v}
    for rule, holds in rules.items():
        if rule in schema:
            parts.append(F.when(is_("number"), unless(holds(F.lit(float(schema[rule]))), rule)).otherwise(_none()))
    texts = {"minLength": lambda v: F.length(text) >= v, "maxLength": lambda v: F.length(text) <= v, "pattern": lambda v: text.rlike(v), "format": lambda v: FORMATS[v](text) if v in FORMATS else F.lit(True)}
    for rule, holds in texts.items():
        if rule in schema:
            parts.append(F.when(is_("string"), unless(holds(schema[rule]), rule)).otherwise(_none()))
    for rule, listed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if listed is not None:
            parts.append(unless(_one_of(value, kind, listed), rule))
    if "anyOf" in schema:
        fits = F.lit(False)
        for option in schema["anyOf"]:
            fits = fits | (F.size(_violations(value, option, root, path, seen)) == 0)
        parts.append(unless(fits, "anyOf"))
    if {"properties", "required", "additionalProperties"} & set(schema):
        parts.append(F.when(is_("object"), _bound(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _object(m, schema, root, path, seen))).otherwise(_none()))
    if {"items", "minItems", "maxItems"} & set(schema):
        parts.append(F.when(is_("array"), _bound(F.try_variant_get(value, "$", "array<variant>"), lambda a: _array(a, schema, root, path, seen))).otherwise(_none()))
    whole = F.concat(*parts) if parts else _none()
    if "type" not in schema:
        return whole
    allowed = F.lit(False)
    for name in [schema["type"]] if isinstance(schema["type"], str) else schema["type"]:
        allowed = allowed | ((is_("number") & (number == F.floor(number))) if name == "integer" else is_(name))
    return F.when(allowed, whole).otherwise(said("type"))


def _one_of(value: Column, kind: Column, listed: list) -> Column:
    out, text, number = F.lit(False), F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    for x in listed:
        if x is None:
            out = out | (kind == "VOID")
        elif isinstance(x, bool):
            out = out | ((kind == "BOOLEAN") & (text == str(x).lower()))
        elif isinstance(x, (int, float)):
            out = out | (kind.rlike(KINDS["number"]) & (number == float(x)))
        else:
            out = out | ((kind == "STRING") & (text == x))
    return out


def _object(fields: Column, schema: dict, root: dict, path: Column, seen: tuple[str, ...]) -> Column:
    has = lambda name: F.map_contains_key(fields, F.lit(name))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    parts = [F.when(has(n), _none()).otherwise(F.array(F.concat(at(n), F.lit(": required")))) for n in schema.get("required", ())]
    known = schema.get("properties", {})
    for name, own in known.items():
        parts.append(F.when(has(name), _property(F.try_element_at(fields, F.lit(name)), own, root, at(name), seen)).otherwise(_none()))
    more = schema.get("additionalProperties", True)
    others = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
    if more is False:
        parts.append(F.sort_array(F.transform(others, lambda e: F.concat(path, F.lit("."), e["key"], F.lit(": additional")))))
    elif isinstance(more, dict):
        parts.append(F.sort_array(F.flatten(F.transform(others, lambda e: _violations(e["value"], more, root, F.concat(path, F.lit("."), e["key"]), seen)))))
    return F.concat(*parts) if parts else _none()


def _property(value: Column, schema: dict, root: dict, path: Column, seen: tuple[str, ...]) -> Column:
    return _bound(value, lambda v: _violations(v, schema, root, path, seen))


def _array(items: Column, schema: dict, root: dict, path: Column, seen: tuple[str, ...]) -> Column:
    parts = []
    for rule, holds in (("minItems", lambda n: F.size(items) >= n), ("maxItems", lambda n: F.size(items) <= n)):
        if rule in schema:
            parts.append(F.when(holds(schema[rule]), _none()).otherwise(F.array(F.concat(path, F.lit(f": {rule}")))))
    if "items" in schema:
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        parts.append(F.flatten(F.transform(items, lambda v, i: _violations(v, schema["items"], root, place(i), seen))))
    return F.concat(*parts)


def folder_problems(spark: SparkSession, root: str, schemas: dict[str, dict], manifest: str = "manifest.json") -> DataFrame:
    """``file`` (below ``root``) and ``problem`` of each: violations of the file's schema (by its name without folders), files
    that the manifest declares and that aren't there, and those that are there undeclared. The manifest's own file is
    ``{"cities": {city: {"files": {name: file}}}}``; files beside it are of no city."""
    base = root.rstrip("/")
    found = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(base)
             .select(F.regexp_replace(F.expr("_metadata.file_path"), r"^.*?" + _quoted(base.split("://")[-1]) + "/", "").alias("file"), F.col("value").alias("document")))
    name = F.element_at(F.split("file", "/"), -1)
    broken = F.when(F.try_parse_json("document").isNull(), F.array(F.lit("$: json"))).otherwise(_none())
    for file, schema in schemas.items():
        broken = F.when(name == file, violations(F.col("document"), schema)).otherwise(broken)
    wrong = found.select("file", F.explode(broken).alias("problem"))
    listed = found.where(F.col("file") == manifest).select(F.explode(F.from_json("document", "cities map<string, struct<files: map<string,string>>>")["cities"]).alias("city", "c"))
    declared = listed.select("city", F.explode(F.map_values("c.files")).alias("f")).select(F.concat_ws("/", "city", "f").alias("file")).distinct()
    present = found.where(F.col("file").contains("/")).select("file")
    gone = declared.join(present, "file", "left_anti").select("file", F.lit("missing").alias("problem"))
    extra = present.join(declared, "file", "left_anti").select("file", F.lit("undeclared").alias("problem"))
    no_manifest = found.agg(F.count_if(F.col("file") == manifest).alias("n")).where("n = 0").select(F.lit(manifest).alias("file"), F.lit("missing").alias("problem"))
    return wrong.unionByName(gone).unionByName(extra).unionByName(no_manifest)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def gate_folder(spark: SparkSession, root: str, schemas: dict[str, dict], manifest: str = "manifest.json", shown: int = 50) -> int:
    """Prints up to ``shown`` problems and returns an exit code: 0 if there is none."""
    problems = folder_problems(spark, root, schemas, manifest).orderBy("file", "problem").limit(shown).collect()
    for p in problems:
        print(f"{p.file}: {p.problem}")
    return int(bool(problems))
