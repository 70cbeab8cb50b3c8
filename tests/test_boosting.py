import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import boosting as B

SMALL = B.Settings(rounds=10, depth=3, rate=0.3, least=5)


def some_rows(n=600, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 24, n).astype(float), rng.uniform(0, 10, n)
    y = 20 * a + 5 * np.sin(b / 4) * c + rng.exponential(8, n)
    a[rng.random(n) < 0.1] = np.nan
    return [(i, int(i % 4), None if math.isnan(a[i]) else float(a[i]), float(b[i]), float(c[i]), None if i % 50 == 7 else float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(some_rows(), "id long, station int, a double, b double, c double, y double").repartition(3).cache()


def plain(x, y, u, alpha, settings, member):
    """One model, one tree after the other, on arrays."""
    x, y, u = x[member], y[member], u[member]

    def value(r, lo, hi):
        if alpha is None:
            return r.mean()
        k = np.clip(((r - lo) / max(hi - lo, 1e-12) * B.RESIDUAL_CELLS).astype(int), 0, B.RESIDUAL_CELLS - 1)
        wanted, before = alpha * len(r), 0
        for c in range(B.RESIDUAL_CELLS):
            here = (k == c).sum()
            if here and before + here >= wanted - 1e-9:
                return lo + (hi - lo) * (c + (wanted - before) / here) / B.RESIDUAL_CELLS
            before += here

    f = np.full(len(y), value(y, y.min(), y.max()))
    base, trees = f[0], []
    for k in range(settings.rounds):
        on, allowed = B._uniform(u, k) < settings.rows, B._allowed(settings, k, x.shape[1])

        def grow(ids, level, lo, hi):
            r = y[ids] - f[ids]
            if level == settings.depth:
                return settings.rate * value(r, lo, hi) if len(ids) else 0.0
            lo, hi = (r.min(), r.max()) if len(ids) else (0, 0)
            g = r if alpha is None else (r > 0) - (1 - alpha)
            best = (1e-9, None)
            for missing in (True, False):
                for j in np.flatnonzero(allowed):
                    for b in range(1, B.BINS):
                        left = np.where(x[ids, j] == 0, missing, x[ids, j] <= b)
                        p, q = left.sum(), (~left).sum()
                        if p >= settings.least and q >= settings.least:
                            gain = round(g[left].sum() ** 2 / p + g[~left].sum() ** 2 / q - g.sum() ** 2 / len(g), 9)
                            if gain > best[0]:
                                best = (gain, (j, b, missing))
            if best[1] is None:
                return (None, grow(ids, level + 1, lo, hi), None)
            j, b, missing = best[1]
            left = np.where(x[ids, j] == 0, missing, x[ids, j] <= b)
            return (best[1], grow(ids[left], level + 1, lo, hi), grow(ids[~left], level + 1, lo, hi))

        tree = grow(np.flatnonzero(on), 0, 0, 0)
        trees.append(tree)
        f = f + np.array([apply(tree, v) for v in x])
    return base, trees


def apply(tree, v):
    while isinstance(tree, tuple):
        if tree[0] is None:
            tree = tree[1]
        else:
            j, b, missing = tree[0]
            tree = tree[1] if (missing if v[j] == 0 else v[j] <= b) else tree[2]
    return tree


def arrays(rows, model):
    kept = rows.where("y is not null").withColumn("u", F.xxhash64(F.lit(7), "id")).toArrow()
    batch = kept.combine_chunks().to_batches()[0]
    return model.binned(batch), *(batch.column(c).to_numpy() for c in ("y", "u", "station", "id"))


@pytest.mark.parametrize("alpha", [0.5, 0.9, None])
def test_equals_a_plain_version(spark, rows, alpha):
    model = B.train(rows, ["a", "b", "c"], "y", [alpha], ["id"], SMALL)
    x, y, u, _, ids = arrays(rows, model)
    base, trees = plain(x, y, u, alpha, SMALL, np.ones(len(y), bool))
    want = dict(zip(ids.tolist(), (base + np.array([sum(apply(t, v) for t in trees) for v in x])).tolist(), strict=True))
    got = {r.id: r.p for r in model.predict(rows, ["id"], ["p"]).collect()}
    assert len(got) == 600 and max(abs(got[k] - v) for k, v in want.items()) < 1e-6


def test_folds_together_equal_folds_alone(spark, rows):
    model = B.train(rows, ["a", "b", "c"], "y", [0.5], ["id"], SMALL, group="station", mode="out")
    got = {r.id: r.p for r in model.predict_own(rows, ["id"], "station", "p").collect()}
    x, y, u, station, ids = arrays(rows, model)
    for s in range(4):
        base, trees = plain(x, y, u, 0.5, SMALL, station != s)
        for i in np.flatnonzero(station == s)[:40]:
            assert abs(got[int(ids[i])] - base - sum(apply(t, x[i]) for t in trees)) < 1e-6
    own = B.train(rows.where("station = 2"), ["a", "b", "c"], "y", [0.5], ["id"], SMALL, edges=model.edges)
    both = B.train(rows, ["a", "b", "c"], "y", [0.5], ["id"], SMALL, group="station", mode="own", edges=model.edges)
    alone = {r.id: r.p for r in own.predict(rows.where("station = 2"), ["id"], ["p"]).collect()}
    together = {r.id: r.p for r in both.predict_own(rows.where("station = 2"), ["id"], "station", "p").collect()}
    assert all(abs(alone[k] - together[k]) < 1e-9 for k in alone)


def test_quantiles_on_rows_not_seen(spark):
    frame = spark.createDataFrame(some_rows(4000, 5), "id long, station int, a double, b double, c double, y double")
    learn, held = frame.where("id % 4 <> 0"), frame.where("id % 4 = 0 and y is not null")
    model = B.train(learn, ["a", "b", "c"], "y", [0.5, 0.9], ["id"], B.Settings(rounds=40, depth=4, rate=0.2))
    got = np.array([(r.y, r.p50, r.p90) for r in model.predict(held, ["id", "y"], ["p50", "p90"]).collect()])
    loss = lambda p, a: np.maximum(a * (got[:, 0] - p), (a - 1) * (got[:, 0] - p)).mean()
    flat = np.quantile(got[:, 0], [0.5, 0.9])
    assert loss(got[:, 1], 0.5) < 0.55 * loss(flat[0], 0.5) and loss(got[:, 2], 0.9) < 0.7 * loss(flat[1], 0.9)
    assert 0.83 < (got[:, 0] <= got[:, 2]).mean() < 0.96 and 0.42 < (got[:, 0] <= got[:, 1]).mean() < 0.58


def test_mean_over_is_the_mean_over_all_rows(spark, rows):
    model = B.train(rows, ["a", "b", "c"], "y", [None], ["id"], SMALL)
    some = rows.where("id < 25")
    got = {r.id: r.n for r in model.mean_over(rows, some, ["id"], ["a", "c"], "n").collect()}
    every = some.select("id", "b").crossJoin(rows.select("a", "c"))
    want = {r.id: r.m for r in model.predict(every, ["id"], ["p"]).groupBy("id").agg(F.avg("p").alias("m")).collect()}
    assert len(got) == 25 and max(abs(got[k] - want[k]) for k in want) < 1e-6
    by = B.train(rows, ["a", "b", "c"], "y", [None], ["id"], SMALL, group="station", mode="own")
    got = {r.id: r.n for r in by.mean_over(rows, some, ["id"], ["a", "c"], "n", "station").collect()}
    every = some.select("id", "b", "station").join(rows.select("a", "c", "station"), "station")
    want = {r.id: r.m for r in by.predict_own(every, ["id"], "station", "p").groupBy("id").agg(F.avg("p").alias("m")).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_few_rows_and_one_value(spark):
    frame = spark.createDataFrame([(k, 1.0 if k else None, 3.0) for k in range(8)], "id long, a double, y double")
    got = B.train(frame, ["a"], "y", [0.5, 0.9], ["id"], SMALL).predict(frame, ["id"], ["p50", "p90"]).collect()
    assert all(abs(r.p50 - 3) < 1e-9 and abs(r.p90 - 3) < 1e-9 for r in got)
