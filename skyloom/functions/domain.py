"""Scalar functions of weather, sources, priorities and health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published parameters of the mortality model, the adult share and rate, and the daily norm.
GEMM, TMREL, ADULTS, RATE_PER_1000, NORM = {"theta": 0.1430, "alpha": 1.6, "mu": 15.5, "nu": 36.8}, 2.4, 0.66, 9.0, 60.0
SHARES = ("traffic", "industry", "biomass", "dust", "residential_other")


def wind_vector(speed: Column, wind_from: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(wind_from)), -speed * F.cos(F.radians(wind_from))


def risk_level(index: Column) -> Column:
    return F.when(index <= 100, "low").when(index <= 200, "moderate").when(index <= 300, "high").when(index.isNotNull(), "severe")


def distance_confidence(km: Column) -> Column:
    return F.when(km <= 3, "high").when(km <= 9, "med").otherwise("low")


def unit(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))), F.lit(0.0))


def source_shares(road: Column, built: Column, industry_km: Column, frp: Column, cpf_nw: Column, cpf_industry: Column) -> Column:
    """The five shares, rounded to 3 digits, what rounding leaves added to the largest (the first of equals)."""
    near = 1.0 / F.greatest(F.lit(0.5), industry_km)
    raw = F.array(0.20 + 0.9 * unit(road), 0.12 + 1.4 * near / (near + 0.5) + 0.6 * unit(cpf_industry), 0.08 + 1.2 * unit(cpf_nw) + 0.5 * unit(frp / 200.0),
                  0.18 + 0.5 * (1.0 - unit(built)), 0.12 + 0.8 * unit(built))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    rounded = F.get(F.transform(F.array(total), lambda t: F.transform(raw, lambda r: F.round(r / t, 3))), 0)

    def settled(s):
        top, drift = F.array_position(s, F.array_max(s)), F.round(1.0 - F.aggregate(s, F.lit(0.0), lambda a, b: a + b), 3)
        return F.transform(s, lambda x, i: F.when(i == top - 1, F.round(x + drift, 3)).otherwise(x))

    done = F.get(F.transform(F.array(rounded), settled), 0)
    return F.get(F.transform(F.array(done), lambda s: F.struct(*(F.get(s, i).alias(name) for i, name in enumerate(SHARES)))), 0)


def share_confidence(top: Column) -> Column:
    return F.when(top > 0.38, "high").when(top > 0.30, "med").otherwise("low")


def priority(index: Column, days: Column, exceedance: Column, population: Column, largest: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.10 * index + 3.0 * days + 0.25 * exceedance + 25.0 * population / largest)), 1)


def hazard_ratio(pm25: Column) -> Column:
    z = F.greatest(F.lit(0.0), pm25 - TMREL)
    return F.exp(GEMM["theta"] * F.log(1 + z / GEMM["alpha"]) / (1 + F.exp(-(z - GEMM["mu"]) / GEMM["nu"])))


def attributable(pm25: Column) -> Column:
    return (hazard_ratio(pm25) - 1) / hazard_ratio(pm25)


def avoided_deaths(actual: Column, otherwise: Column, population: Column) -> Column:
    return population * ADULTS * (RATE_PER_1000 / 1000) * (attributable(otherwise) - attributable(actual))
