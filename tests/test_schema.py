import json

import pytest
from pyspark.sql import functions as F

from skyloom.operators import schema

NOWCAST = {
    "type": "object", "required": ["generated_at", "wards"], "additionalProperties": False,
    "$defs": {"pm": {"type": "number", "minimum": 0, "maximum": 2000}, "clean": {"type": "string", "pattern": "^[^<>\\x00-\\x1f]*$"}},
    "properties": {
        "generated_at": {"type": "string", "format": "date-time"}, "fixture": {"type": "boolean"},
        "wards": {"type": "array", "minItems": 1, "items": {
            "type": "object", "required": ["ward_id", "pm25_p50"], "additionalProperties": False,
            "properties": {"ward_id": {"type": "string", "pattern": "^[a-z]+_[0-9]{3}$"}, "name": {"$ref": "#/$defs/clean"}, "pm25_p50": {"$ref": "#/$defs/pm"}, "confidence": {"enum": ["low", "med", "high"]},
                           "rank": {"type": ["integer", "null"], "exclusiveMinimum": 0}, "extra": {"type": "object", "additionalProperties": {"$ref": "#/$defs/pm"}}, "either": {"anyOf": [{"type": "null"}, {"type": "string", "maxLength": 2}]}},
        }},
    },
}
GOOD = {"generated_at": "2024-01-01T00:00:00Z", "wards": [{"ward_id": "delhi_001", "name": "A", "pm25_p50": 40.5, "confidence": "low", "rank": None, "extra": {"a": 1}, "either": "ab"}]}


def ward(**changes):
    return {**GOOD, "wards": [GOOD["wards"][0], {**GOOD["wards"][0], **changes}]}


CASES = [
    (GOOD, []), (ward(pm25_p50=99999), ["$.wards[1].pm25_p50: maximum"]), (ward(name="<script>x"), ["$.wards[1].name: pattern"]), (ward(ward_id="x"), ["$.wards[1].ward_id: pattern"]),
    (ward(pm25_p50="40"), ["$.wards[1].pm25_p50: type"]), (ward(rank=1.5), ["$.wards[1].rank: type"]), (ward(rank=0), ["$.wards[1].rank: exclusiveMinimum"]), (ward(rank=3.0), []), (ward(confidence="sure"), ["$.wards[1].confidence: enum"]),
    (ward(extra={"a": 1, "b": -1, "c": None}), ["$.wards[1].extra.b: minimum", "$.wards[1].extra.c: type"]), (ward(either=None), []), (ward(either="abc"), ["$.wards[1].either: anyOf"]), (ward(secret=1, more=2), ["$.wards[1].more: additional", "$.wards[1].secret: additional"]),
    ({"generated_at": "yesterday", "wards": []}, ["$.generated_at: format", "$.wards: minItems"]), ({"wards": [{}]}, ["$.generated_at: required", "$.wards[0].ward_id: required", "$.wards[0].pm25_p50: required"]),
    ({**GOOD, "fixture": 1}, ["$.fixture: type"]), ([], ["$: type"]), (None, ["$: type"]), ({**GOOD, "wards": {}}, ["$.wards: type"]),
]


def test_cases(spark):
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in enumerate(CASES)] + [(-1, "{not json"), (-2, None)], "k int, d string")
    got = {r.k: r.v for r in rows.select("k", schema.violations(F.col("d"), NOWCAST).alias("v")).collect()}
    assert got[-1] == got[-2] == ["$: json"]
    assert [(d, want, got[k]) for k, (d, want) in enumerate(CASES) if got[k] != want] == []


def test_references_that_hold_themselves():
    loop = {"$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}, "$ref": "#/$defs/a"}
    with pytest.raises(ValueError):
        schema._followed({"$ref": "#/$defs/a"}, loop, ("#/$defs/a",))


def test_folder(spark, tmp_path, capsys):
    put = lambda name, doc: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc)))
    put("delhi/nowcast.json", GOOD)
    put("manifest.json", {"cities": {"delhi": {"files": {"nowcast": "nowcast.json"}}}})
    schemas = {"nowcast.json": NOWCAST, "receipts.json": {"properties": {"lineage": {"items": {"properties": {"url": {"pattern": "^[^?]*$"}}}}}}}
    assert schema.gate_folder(spark, str(tmp_path), schemas) == 0 and capsys.readouterr().out == ""
    put("delhi/nowcast.json", ward(pm25_p50=99999, name="<b>"))
    put("receipts.json", {"lineage": [{"url": "https://x/y"}, {"url": "https://x/y?api-key=1"}]})
    put("mumbai/nowcast.json", "{broken")
    put("manifest.json", {"cities": {"delhi": {"files": {"nowcast": "nowcast.json", "ledger": "ledger.json"}}}})
    assert schema.gate_folder(spark, str(tmp_path), schemas) == 1
    assert capsys.readouterr().out.splitlines() == ["delhi/ledger.json: missing", "delhi/nowcast.json: $.wards[1].name: pattern", "delhi/nowcast.json: $.wards[1].pm25_p50: maximum", "mumbai/nowcast.json: $: json", "mumbai/nowcast.json: undeclared", "receipts.json: $.lineage[1].url: pattern"]
    (tmp_path / "manifest.json").unlink()
    assert "manifest.json" in {r.file for r in schema.folder_problems(spark, str(tmp_path), schemas).collect()}
