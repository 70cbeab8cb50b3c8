"""The contract of published documents: each rule a condition on a row, and the checks of whole documents and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import aqi, text

SHARE_SLACK = 0.02
PM_MOST, INDEX_MOST = 2000.0, 500.0


def believable(pm: Column, index: Column) -> Column:
    return pm.between(0.0, PM_MOST) & index.between(0.0, INDEX_MOST)


def ordered(p50: Column, p90: Column) -> Column:
    return p90 >= p50


def category_fits(index: Column, category: Column) -> Column:
    return category.eqNullSafe(aqi.category(index))


def interval_holds(low: Column, point: Column, high: Column) -> Column:
    return (low <= point) & (point <= high)


def shares_whole(shares: list[Column]) -> Column:
    total = sum(shares[1:], shares[0])
    return total.between(1 - SHARE_SLACK, 1 + SHARE_SLACK)


def one_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def clean(value: Column) -> Column:
    return F.size(text.violations(value)) == 0


def known_fields(document: Column, names: tuple[str, ...]) -> Column:
    """No other fields than these at the top of a JSON object."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, names)))) == 0, F.lit(False))


def iso_date(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value).isNotNull()


def iso_time(value: Column) -> Column:
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return shaped & F.try_to_date(F.substring(value, 1, 10)).isNotNull()


def city_keys(found: Column) -> Column:
    """All keys of a map are names of cities."""
    return F.forall(F.map_keys(found), lambda k: k.rlike("^[a-z]+$"))


def window_sound(begin: Column, end: Column, refs: Column) -> Column:
    """A trigger window is in order, and its brief has references, all resolved."""
    return (begin < end) & (F.size(refs) > 0) & F.forall(refs, lambda r: F.coalesce(r, F.lit(False)))


def by_schema(row: dict[str, Column], schema: dict) -> Column:
    """A condition from a declarative schema: ``required`` names, and by property ``enum``, ``minimum``, ``maximum``, ``pattern``."""
    found = [row[n].isNotNull() for n in schema.get("required", ())]
    for name, rule in schema.get("properties", {}).items():
        v = row[name]
        if "enum" in rule:
            found.append(v.isNull() | v.isin(*rule["enum"]))
        if "minimum" in rule:
            found.append(v.isNull() | (v >= rule["minimum"]))
        if "maximum" in rule:
            found.append(v.isNull() | (v <= rule["maximum"]))
        if "pattern" in rule:
            found.append(v.isNull() | v.cast("string").rlike(rule["pattern"]))
    out = F.lit(True)
    for c in found:
        out = out & c
    return F.coalesce(out, F.lit(False))


def missing_files(declared: DataFrame, present: DataFrame) -> DataFrame:
    """What a manifest declares and is not there (``missing``), and what is there and not declared (``extra``)."""
    keys = ["city", "file"]
    gone = declared.join(present, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    return gone.unionByName(present.join(declared, keys, "left_anti").select(*keys, F.lit("extra").alias("problem")))


def schema_differences(df: DataFrame, declared: StructType) -> list[tuple[str, str | None, str | None]]:
    """(field, declared, found) where the types differ."""
    want, have = ({f.name: f.dataType.simpleString() for f in s} for s in (declared, df.schema))
    return [(n, want.get(n), have.get(n)) for n in sorted({*want, *have}) if want.get(n) != have.get(n)]


LEAKS = r"(?i:</?think\b)|nvapi-|sk-[A-Za-z0-9]{8}"


def gated(documents: DataFrame, column: str = "document") -> DataFrame:
    """The documents; the plan raises at one that shows a model's thoughts or a key's beginning."""
    return documents.withColumn(column, F.when(F.col(column).rlike(LEAKS), F.raise_error(F.lit("a document leaks a thought or a key"))).otherwise(F.col(column)))


def stale_kept(before: DataFrame, after: DataFrame, key: str = "city") -> DataFrame:
    """Each city's new document, or its last one marked stale."""
    old = before.join(after.select(key), key, "left_anti").withColumn("stale", F.lit(True))
    return after.withColumn("stale", F.lit(False)).unionByName(old)


def merged_log(before: DataFrame, after: DataFrame, key: str = "city") -> DataFrame:
    """Runs of the processed cities replace their old ones; the others stay."""
    return before.join(after.select(key).distinct(), key, "left_anti").unionByName(after)
