"""Effects of dated measures on a daily series: what came after less what came before, its interval and a placebo test.

All is drawn by hashes of seed, day and number, so that results repeat and can be said in SQL. A series has a row a day and
an event some tens of them: each event is one row with its days as arrays, and resampling takes place within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days before and after an event, days kept free around events, placebo days, resamples, days of a block.
WINDOW, GAP, PLACEBOS, RESAMPLES, BLOCK = 10, 21, 300, 600, 3
#: A reduction counts if at most this share of placebos is lower.
PASSES = 0.20


def drawn(*parts: Column) -> Column:
    """A number of 32 bits from the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def windows(daily: DataFrame, days: DataFrame, window: int = WINDOW) -> DataFrame:
    """``days`` (column ``day``, distinct) with ``pre`` and ``post``: the values of the days before, and of the day and those after.
    ``daily``: ``x`` (days since 1970), ``v``. Each day meets its own dates in an equi-join."""
    dates = days.select("day", F.explode(F.sequence(F.col("day") - window, F.col("day") + window - 1)).alias("x"))
    value = F.struct("x", "v")
    list_ = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, value))), lambda r: r["v"])
    return dates.join(daily.where("v is not null"), "x").groupBy("day").agg(list_(F.col("x") < F.col("day")).alias("pre"), list_(F.col("x") >= F.col("day")).alias("post"))


def mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), F.size(values).cast("double"))


def percentile(values: Column, share: float) -> Column:
    """Between the two nearest of sorted ``values``, in proportion."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def resampled(values: Column, day: Column, side: str, k: Column, block: int, seed: int) -> Column:
    """Mean of a moving-block resample: blocks begin where they are drawn, the last is cut to the length."""
    size = F.size(values)
    begin = lambda b: (drawn(F.lit(seed), day, F.lit(side), k, b) % F.greatest(F.lit(1), size - block + 1)).cast("int")
    begins = F.transform(F.sequence(F.lit(0), F.ceil(size / block).cast("int") - 1), begin)
    parts = F.flatten(F.transform(begins, lambda b: F.slice(values, b + 1, F.lit(block))))
    return mean(F.slice(parts, F.lit(1), size))


def intervals(found: DataFrame, block: int = BLOCK, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """:func:`windows` with ``lo`` and ``hi``, the 2.5th and 97.5th percentile of the resampled difference; without enough days none."""
    enough = (F.size("pre") >= block) & (F.size("post") >= block)
    each = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda k: resampled(F.col("post"), F.col("day"), "post", k, block, seed) - resampled(F.col("pre"), F.col("day"), "pre", k, block, seed))
    # Worked out once a row: both bounds read the same array.
    return found.withColumn("_e", F.when(enough, F.sort_array(each))).withColumns({"lo": percentile(F.col("_e"), 0.025), "hi": percentile(F.col("_e"), 0.975)}).drop("_e")


def placebos(daily: DataFrame, events: DataFrame, window: int = WINDOW, gap: int = GAP, most: int = PLACEBOS, seed: int = 0) -> DataFrame:
    """``e``: the difference at each of up to ``most`` days that lie at least ``window`` days from the series' ends and more than
    ``gap`` days from every event, those with the least hashes. A day without values on a side has none (null)."""
    span = daily.agg((F.min("x") + window).alias("lo"), (F.max("x") - window).alias("hi")).where("lo <= hi")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    near = events.select(F.explode(F.sequence(F.col("day") - gap, F.col("day") + gap)).alias("day")).distinct()
    taken = every.join(near, "day", "left_anti").orderBy(drawn(F.lit(seed), F.col("day")), "day").limit(most)
    return taken.join(windows(daily, taken, window), "day", "left").select((mean(F.col("post")) - mean(F.col("pre"))).alias("e"))


def effects(daily: DataFrame, events: DataFrame, window: int = WINDOW, seed: int = 0) -> DataFrame:
    """``label``, ``day``, ``effect``, ``ci_low``, ``ci_high``, ``placebo_pass``, ``percentile``, ``n_days`` of each event (``label``,
    ``day``); those with fewer than ``window`` days, or too few on a side, are left out. The interval is widened to hold the effect."""
    own = intervals(windows(daily, events.select("day").distinct(), window), seed=seed).withColumn("real", mean(F.col("post")) - mean(F.col("pre"))).withColumn("n_days", F.size("pre") + F.size("post"))
    pool = placebos(daily, events, window, seed=seed).agg(F.collect_list(F.coalesce("e", F.lit(float("inf")))).alias("pool"))  # PLACEBOS at most
    kept = own.where((F.col("n_days") >= window) & F.col("lo").isNotNull()).crossJoin(F.broadcast(pool))
    share = F.try_divide(F.size(F.filter("pool", lambda e: e < F.col("real"))), F.size("pool"))
    r1 = lambda c: F.round(c, 1)
    rows = kept.select("day", r1(F.col("real")).alias("effect"), r1(F.col("lo")).alias("lo"), r1(F.col("hi")).alias("hi"), share.alias("percentile"), F.coalesce((F.col("real") < 0) & (share <= PASSES), F.lit(False)).alias("placebo_pass"), "n_days")
    return events.join(rows, "day").select("label", "day", "effect", F.least("lo", "effect").alias("ci_low"), F.greatest("hi", "effect").alias("ci_high"), "placebo_pass", F.round("percentile", 6).alias("percentile"), F.col("n_days").cast("long").alias("n_days"))


def season(found: DataFrame) -> DataFrame:
    """One row ``eff``, ``e_lo``, ``e_hi``: means over the events that pass their placebo test, or over all if none does."""
    cols = (("effect", "eff"), ("ci_low", "e_lo"), ("ci_high", "e_hi"))
    return found.agg(*(F.coalesce(F.avg(F.when(F.col("placebo_pass"), F.col(c))), F.avg(c)).alias(n) for c, n in cols))


def active_hours(calendar: DataFrame, stages: tuple[str, ...] = ("III", "IV"), least: float = 24.0) -> DataFrame:
    """One row ``hours``: those in which the biting stages were in force; open ends don't count. ``calendar``: stage, start, end (timestamps)."""
    hours = F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / 3600.0
    return calendar.where(F.col("stage").isin(*stages) & F.col("end").isNotNull()).agg(F.greatest(F.coalesce(F.sum(hours), F.lit(0.0)), F.lit(least)).alias("hours"))
