"""Expected values come from the grammar and the anchors of FIXTURES F5, not from the code."""

import json

import pytest
from pyspark.sql import functions as F

from skyloom.functions import text
from skyloom.operators import contract, gate

FORECAST = {"wards": [{"ward_id": "delhi_001", "series": []}, {"ward_id": "delhi_042", "series": [{"h": 24, "pm25_p90": 412.0}, {"h": 48, "pm25_p90": 3}]}]}
DOCS = {
    "forecast": FORECAST,
    "enforcement": {"ranked": [{"priority_score": 88.0}, {"priority_score": 12}]},
    "receipts": {"cities": {"delhi": {"forecast": {"24": {"skill_pct": 23.6}}}}},
    "interventions": {"effects": [{"stage_transition": "GRAP-II to GRAP-III", "effect_ugm3": -18.0}]},
    "fires": {"clusters": [{"cluster_id": "delhi_fc0", "frp_total": 128.4}]},
    "attribution": {"wards": [{"ward_id": "delhi_042", "shares": {"traffic": 0.4}}]},
    "r": {"w": [{"id": "007", "v": 1}, {"id": 7, "v": 2}, {"id": True, "v": 3}, {"id": "[x", "v": "[not a list"}, {"id": "n", "v": None}, 5, [1]], "e": [], "flag": False, "x y": 1},
}
GOOD = {
    "forecast.wards[ward_id=delhi_042].series[h=24].pm25_p90": ("number", 412.0),
    "enforcement.ranked[0].priority_score": ("number", 88.0),
    "receipts.cities.delhi.forecast.24.skill_pct": ("number", 23.6),
    "interventions.effects[stage_transition=GRAP-II to GRAP-III].effect_ugm3": ("number", -18.0),
    "fires.clusters[cluster_id=delhi_fc0].frp_total": ("number", 128.4),
    "forecast.wards[ward_id=delhi_042].series[h=48.0].pm25_p90": ("number", 3.0),
    "r.w[id=007].v": ("number", 1.0), "r.w[id=7].v": ("number", 2.0), "r.w[id=7.0].v": ("number", 2.0), "r.w[id=True].v": ("number", 3.0), "r.w[id=true].v": ("number", 3.0),
    "r.w[id=[x].v": ("string", "[not a list"), "r.w[id=n].v": ("null", "None"), "r.flag": ("boolean", "false"), "r..flag": ("boolean", "false"), "r.w[ 0 ].v": ("number", 1.0), "r.w[5]": ("number", 5.0),
}
NOWHERE = ["attribution.wards[ward_id=delhi_042].shares", "forecast.wards[ward_id=delhi_999].pm25_p90", "r.w", "r.w[99].v", "r.w.v", "r.flag.x", "r.e[0]", "r.cities[0]", "r.w[id=8].v"]
MALFORMED = ["", " ", "a[]", "a[b]", "a[[0]]", "a[=v]", "a[0", "a b", "a-b.c", "[0].a", ".".join(["a"] * 40), "a." + "b" * 300]


@pytest.fixture(scope="module")
def truths(spark):
    artifacts = spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCS.items()], "root string, document string")
    refs = spark.createDataFrame([(p,) for p in (*GOOD, *NOWHERE, *MALFORMED)] + [(None,)], "path string")
    return {r.path: (r.kind, r.truth) for r in gate.resolved(artifacts, refs).collect()}


@pytest.mark.parametrize("path", GOOD)
def test_leads_to_a_scalar(truths, path):
    kind, value = truths[path]
    assert kind == GOOD[path][0] and (float(value) if kind == "number" else value) == GOOD[path][1]


def test_leads_nowhere(truths):
    assert set(truths) == set(GOOD)


def test_malformed(spark):
    got = spark.createDataFrame([(p,) for p in MALFORMED], "p string").select("p", text.parsed_path(F.col("p")).alias("r")).collect()
    assert [r.p for r in got if r.r is not None] == []


def test_values(spark):
    cases = [("412.0", "412.3", True), ("412.0", "480.0", False), ("true", "1", False), ("1", "true", False), ("true", "true", True), ("0.02", "0.06", True), ("100", "101.9", True), ("100", "103", False), ('"Poor"', '"Poor"', True), ("Poor", '"Poor"', True), ('"7"', "7", True), ('"007"', "7", False), ("null", "null", True)]
    got = spark.createDataFrame(cases, "a string, b string, want boolean").select("a", "b", "want", text.values_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b) for r in got if r.got != r.want] == []


def test_audit_and_repair(spark):
    artifacts = spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCS.items()], "root string, document string")
    p = list(GOOD)
    refs = spark.createDataFrame([(1, p[0], "412.3", False), (1, p[1], "88", False), (2, p[0], "480", False), (3, p[0], "480", True), (4, "forecast.none", "1", False)], "brief_id int, path string, value string, stale boolean")
    assert {r.brief_id: r.ok for r in gate.audited(refs, artifacts).collect()} == {1: True, 2: False, 4: False}
    kept = {r.brief_id: [x["value"] for x in r.refs] for r in gate.verified(refs.select("brief_id").distinct(), refs, artifacts).collect()}
    assert {k: sorted(map(float, v)) for k, v in kept.items()} == {1: [88.0, 412.0], 2: [412.0], 3: [412.0]}


def test_strings_of_the_gate(spark):
    cases = [("two\nlines", "control"), ("a\ttab", "control"), ("\r", "control"), ("&frac12; cup", "entity"), ("&#60;", "entity"), ("&#x3c;", "entity"), ("&#3c;", "entity"), ("fish & chips;", None), ("&a;", None), ("a < b", "angle"), ("plain", None), ("task-force", None)]
    got = spark.createDataFrame(cases, "s string, want string").select("s", "want", text.violations(F.col("s")).alias("v"), text.sanitize(F.col("s")).alias("c")).withColumn("left", text.violations(F.col("c"))).collect()
    assert [r.s for r in got if r.v != ([r.want] if r.want else [])] == [] and not any(r.left for r in got)
    assert {r.s: r.c for r in got}["&frac12; cup"] == "cup" and {r.s: r.c for r in got}["two\nlines"] == "two lines"


@pytest.mark.parametrize("said", ["<think>so", "a </THINK> b", "<Think >", "key nvapi-1", "sk-abcdefgh"])
def test_leaks(spark, said):
    with pytest.raises(Exception, match="leaks"):
        contract.gated(spark.createDataFrame([(said,)], "document string")).collect()


def test_no_leak(spark):
    assert contract.gated(spark.createDataFrame([("we think <thinking> hard",)], "document string")).count() == 1
