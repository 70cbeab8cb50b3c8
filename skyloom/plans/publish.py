"""Publishing a city: its documents in the order of what they rest on, written as JSON, and lookups over what was written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract
from . import documents as docs

#: Surfaces with what they need; those of deep cities are left out elsewhere.
NEEDS = {"nowcast": (), "forecast": ("nowcast",), "attribution": (), "enforcement": ("attribution", "nowcast"), "advisories": ("nowcast",), "ledger": ("nowcast",), "replay": ()}
DEEP = {"attribution", "enforcement", "ledger", "replay"}
LISTS = {"enforcement": "ranked"}


def order(tier: str) -> list[str]:
    """Surfaces of a city's tier, each after those it needs."""
    out: list[str] = []
    for name, needs in NEEDS.items():
        if tier == "deep" or name not in DEEP:
            if missing := [n for n in needs if n not in out]:
                raise ValueError(f"{name} before {missing[0]}")
            out.append(name)
    return out


def publish(spark: SparkSession, sf_dir: str, root: str, tier: str = "deep") -> list[str]:
    """Writes a city's documents as ``root/<surface>`` (one JSON line each), gated; returns their names."""
    made = {
        "nowcast": lambda: docs.nowcast(spark, sf_dir), "forecast": lambda: docs.forecast_wards(docs.forecast(spark, sf_dir)), "attribution": lambda: docs.attribution(spark, sf_dir),
        "enforcement": lambda: docs.enforcement(spark, sf_dir), "advisories": lambda: docs.advisories(docs.nowcast(spark, sf_dir), F.lit(None).cast("string")), "ledger": lambda: docs.ledger(spark, sf_dir),
    }
    done = []
    for name in order(tier):
        if name in made:
            doc = docs.ledger_document(spark, sf_dir) if name == "ledger" else docs.document(made[name](), LISTS.get(name, "wards"))
            contract.gated(doc).coalesce(1).write.mode("overwrite").text(f"{root}/{name}")
            done.append(name)
    return done


def loaded(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.text(f"{root}/{name}").select(F.col("value").alias("document"))


def call(spark: SparkSession, root: str, tool: str, **args) -> dict:
    """A lookup by name for agents: an unknown tool, wrong arguments or a missing document are an answer, not an error."""
    name = tool.removeprefix("get_")
    if not tool.startswith("get_") or name not in NEEDS:
        return {"error": f"unknown tool {tool}"}
    if unknown := sorted(set(args) - {"ward_id", "top"}):
        return {"error": f"unknown argument {unknown[0]}"}
    try:
        doc = loaded(spark, root, name).first()
    except Exception as e:  # noqa: BLE001  (whatever store the folder is in)
        return {"available": False, "error": type(e).__name__}
    if doc is None:
        return {"available": False}
    if name == "ledger" and "ward_id" not in args:
        whole = json.loads(doc.document)
        return {"available": True, "totals": whole.get("totals"), "counterfactuals": whole.get("counterfactuals", [])}
    listed = f"$.{LISTS.get(name, 'wards')}"
    rows = spark.createDataFrame([(doc.document,)], "document string").select(F.explode(F.from_json(F.get_json_object("document", listed), "array<string>")).alias("entry"))
    if "ward_id" in args:
        rows = rows.where(F.get_json_object("entry", "$.ward_id") == args["ward_id"])
    return {"available": True, "entries": [r.entry for r in rows.limit(int(args.get("top", 12))).collect()]}
