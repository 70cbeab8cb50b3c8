"""Air-quality index of the national scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concentration and index ranges of the six bands of each pollutant.
BREAKPOINTS = {
    "pm25": ((0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400), (250, 380, 401, 500)),
    "pm10": ((0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200), (251, 350, 201, 300), (351, 430, 301, 400), (430, 510, 401, 500)),
    "no2": ((0, 40, 0, 50), (41, 80, 51, 100), (81, 180, 101, 200), (181, 280, 201, 300), (281, 400, 301, 400), (400, 520, 401, 500)),
    "so2": ((0, 40, 0, 50), (41, 80, 51, 100), (81, 380, 101, 200), (381, 800, 201, 300), (801, 1600, 301, 400), (1600, 2400, 401, 500)),
    "nh3": ((0, 200, 0, 50), (201, 400, 51, 100), (401, 800, 101, 200), (801, 1200, 201, 300), (1200, 1800, 301, 400), (1800, 2400, 401, 500)),
    "o3": ((0, 50, 0, 50), (51, 100, 51, 100), (101, 168, 101, 200), (169, 208, 201, 300), (209, 748, 301, 400), (748, 1287, 401, 500)),
    "co": ((0, 1.0, 0, 50), (1.1, 2.0, 51, 100), (2.1, 10, 101, 200), (10, 17, 201, 300), (17, 34, 301, 400), (34, 51, 401, 500)),
    "pb": ((0, 0.5, 0, 50), (0.5, 1.0, 51, 100), (1.1, 2.0, 101, 200), (2.1, 3.0, 201, 300), (3.1, 3.5, 301, 400), (3.5, 3.9, 401, 500)),
}
CATEGORIES = (("Good", 50), ("Satisfactory", 100), ("Moderate", 200), ("Poor", 300), ("Very Poor", 400), ("Severe", None))
PARTICULATES, LEAST_POLLUTANTS = ("pm25", "pm10"), 3


def sub_index(pollutant: str, value: Column) -> Column:
    """Index of a concentration: null if missing or negative, 500 beyond the last band."""
    out = F.lit(500)
    for lo, hi, index_lo, index_hi in reversed(BREAKPOINTS[pollutant]):
        part = F.greatest(F.lit(0.0), value - float(lo)) / float(hi - lo)
        out = F.when(value <= float(hi), F.bround(index_lo + part * float(index_hi - index_lo), 0).cast("int")).otherwise(out)
    return F.when((value >= 0) & ~F.isnan(value), out)


def category(index: Column) -> Column:
    out = F.lit(CATEGORIES[-1][0])
    for name, top in reversed(CATEGORIES[:-1]):
        out = F.when(index <= top, F.lit(name)).otherwise(out)
    return F.when(index.isNotNull(), out)


def headline(mean24: Column) -> Column:
    """struct<subindex24h, category, label> of a mean of 24 hours of PM2.5; null without one."""
    i = sub_index("pm25", mean24)
    return F.get(F.transform(F.array(i), lambda x: F.when(x.isNotNull(), F.struct(x.alias("subindex24h"), category(x).alias("category"), F.lit("PM2.5, mean of 24 hours").alias("label")))), 0)


def full_index(values: dict[str, Column]) -> Column:
    """struct<aqi, dominant, category>: the greatest index if there are three pollutants with a particulate; the first of equals."""
    def judged(ix):
        at = {p: F.get(ix, k) for k, p in enumerate(values)}
        there = reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in at.values()))
        particulate = reduce(lambda a, b: a | b, (at[p].isNotNull() for p in PARTICULATES if p in at), F.lit(False))
        top = F.array_max(ix)
        named = F.element_at(F.array(*map(F.lit, values)), F.array_position(ix, top).cast("int"))
        return F.when((there >= LEAST_POLLUTANTS) & particulate, F.struct(top.alias("aqi"), named.alias("dominant"), category(top).alias("category")))

    # The indices are the one element of an array, so that none is worked out again where it is named.
    return F.get(F.transform(F.array(F.array(*(sub_index(p, v) for p, v in values.items()))), judged), 0)


def breakpoint_rows() -> list[tuple]:
    """pollutant, category, conc_lo, conc_hi, index_lo, index_hi, extrapolated (the last band's top is)."""
    return [(p, CATEGORIES[k][0], float(lo), float(hi), ilo, ihi, k == len(bands) - 1) for p, bands in BREAKPOINTS.items() for k, (lo, hi, ilo, ihi) in enumerate(bands)]
