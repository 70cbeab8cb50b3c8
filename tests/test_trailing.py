import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.operators import relational as rel


@pytest.mark.parametrize(("width", "parts"), [(86_400, 24), (60, 60), (7, 1)])
def test_equals_the_window(spark, width, parts):
    rng = np.random.default_rng(3)
    n = 3000
    band = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 6, n))
    at = rng.integers(-width * 3, width * 4, n)
    at[:200] = width  # many rows of one time
    at[200:230] = rng.choice([0, width, -width, width - 1, 1], 30)
    value = [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 1000, n)]
    rows = [(k, None if b == 5 else int(b), int(a), v) for k, (b, a, v) in enumerate(zip(band, at, value, strict=True))] + [(n, 1, None, 5.0), (n + 1, 9, 4, None)]
    frame = spark.createDataFrame(rows, "id long, band long, at long, v double")
    w = Window.partitionBy("band").orderBy("at").rangeBetween(1 - width, 0)
    want = {tuple(r) for r in frame.where("at is not null").select("band", "at", F.count(F.lit(1)).over(w), F.sum("v").over(w)).collect()}
    got = [tuple(r) for r in rel.trailing_totals(frame, ["band"], "at", "v", width, parts).collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_parts_divide(spark):
    with pytest.raises(ValueError, match="divide"):
        rel.trailing_totals(spark.createDataFrame([], "k long, at long, v double"), ["k"], "at", "v", 10, 3)
