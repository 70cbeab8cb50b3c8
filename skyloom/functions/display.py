"""Values as they are shown: ages, local times, numbers with Indian grouping, colours, safe links, redacted logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of an effect from a strong decrease to a strong increase, by its share of the largest.
STOPS = ((-1.0, (33, 102, 172)), (0.0, (240, 240, 240)), (1.0, (178, 24, 43)))
SECRETS = r"(?i)(api[-_]?key|token|secret|password|access[-_]?key)"


def data_age(seconds: Column) -> Column:
    """How long ago, in words."""
    minutes, hours = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)), seconds / 3600
    short = F.when(minutes <= 1, "just now").otherwise(F.concat(minutes.cast("string"), F.lit("m ago")))
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return (F.when(seconds.isNull(), "unknown").when(seconds < 0, "scheduled").when(hours < 1, short)
            .when(hours < 24, F.concat(whole(hours), F.lit("h ago"))).otherwise(F.concat(whole(hours / 24), F.lit("d ago"))))


def ist(ts_utc: Column) -> Column:
    """A UTC time (without zone) as local date and time."""
    return F.concat(F.date_format(F.timestamp_add("MINUTE", F.lit(330), ts_utc), "dd MMM yyyy, h:mm a"), F.lit(" IST"))


def _parts(n: Column, digits: int) -> tuple[Column, Column]:
    text = F.format_string(f"%.{digits}f", F.abs(F.round(n, digits)))
    return F.split_part(text, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", "")


def number(n: Column, digits: int = 0) -> Column:
    """Grouped by thousands, then by hundreds; no trailing zeros; ``-`` for none."""
    whole, rest = _parts(n, digits)
    shown = F.concat(F.regexp_replace(whole, r"(\d)(?=(\d\d)*\d{3}$)", "$1,"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(n.isNull() | F.isnan(n), "-").otherwise(F.concat(F.when(F.round(n, digits) < 0, "-").otherwise(""), shown))


def signed(n: Column, digits: int = 1) -> Column:
    return F.when(F.round(n, digits) > 0, F.concat(F.lit("+"), number(n, digits))).otherwise(number(n, digits))


def interval(low: Column, high: Column, digits: int = 0) -> Column:
    return F.concat(number(low, digits), F.lit(" to "), number(high, digits))


def diverging(value: Column, largest: Column) -> Column:
    """array<int> of red, green and blue for a signed value, its share of the largest (1 at least) cut to -1 to 1."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / F.greatest(F.lit(1.0), largest)))

    def between(lo, hi):
        f = (x - lo[0]) / (hi[0] - lo[0])
        return F.array(*(F.floor(F.lit(float(a)) + f * float(b - a) + 0.5).cast("int") for a, b in zip(lo[1], hi[1], strict=True)))

    return F.when(x <= 0, between(STOPS[0], STOPS[1])).otherwise(between(STOPS[1], STOPS[2]))


def safe_href(url: Column) -> Column:
    """A web address, or null for any other scheme."""
    return F.when(url.rlike(r"(?i)^https?://[^\s/]"), url)


def redacted(event: Column) -> Column:
    """A map whose values are hidden where the key names a secret."""
    return F.transform_values(event, lambda k, v: F.when(k.rlike(SECRETS), F.lit("***")).otherwise(v))
