"""Gradient boosting for quantiles and means, many models in one pass.

Rows stay where they are. For each level of a round's trees every task adds up, for each node, feature and bin, how many of
its rows there are and how far they pull; Spark sums these tables and the driver picks the splits from what does not grow
with the rows: models times nodes times features times bins. Leaves are refitted to the quantile of their residuals, from
mergeable histograms of these, or to their mean.

Several models grow together: quantiles, a model for each group (``own``), or one for each group left out (``out``), whose
tables are those of all rows but the group's. So cross-validation over stations is as many passes as one model.

Values are held as numbers of bins; a missing value is a bin of its own, sent to the better side at each split. The current
estimates lie with the rows and are written anew every ``KEPT`` rounds; trees since then are applied on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import Steps

#: Bins of a feature, cells of a residual histogram, rounds between tables of estimates.
BINS, RESIDUAL_CELLS, KEPT = 64, 512, 8


@dataclass(frozen=True)
class Settings:
    rounds: int = 60
    depth: int = 4
    rate: float = 0.1
    #: Least rows of a leaf; shares of rows and features that a round looks at.
    least: int = 20
    rows: float = 0.8
    features: float = 0.8
    seed: int = 7


@dataclass
class Trees:
    """A round's trees, one a model: nodes level by level, the two children of node i at 2i+1 and 2i+2. ``feature`` -1: not split."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        n = (1 << depth) - 1
        return cls(np.full((models, n), -1, np.int32), np.zeros((models, n), np.int32), np.ones((models, n), np.bool_), np.zeros((models, n + 1)))

    def places(self, x: np.ndarray, m: int, depth: int) -> np.ndarray:
        """The node of each row at a depth, counted from 0 at its left."""
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(depth):
            i = (1 << level) - 1 + at
            bin_ = x[every, np.maximum(self.feature[m, i], 0)]
            left = np.where(bin_ == 0, self.missing_left[m, i], bin_ <= self.bin[m, i]) | (self.feature[m, i] < 0)
            at = 2 * at + ~left
        return at

    def shares(self, x: np.ndarray, m: int, depth: int, fixed: np.ndarray) -> np.ndarray:
        """For each row and leaf whether the row can reach the leaf, if only the ``fixed`` features are known: splits on others lead both ways."""
        on = np.ones((len(x), 1), np.bool_)
        for level in range(depth):
            out = np.zeros((len(x), 2 << level), np.bool_)
            for k in range(1 << level):
                i = (1 << level) - 1 + k
                f = self.feature[m, i]
                if f < 0:
                    out[:, 2 * k] = on[:, k]
                elif not fixed[f]:
                    out[:, 2 * k] = out[:, 2 * k + 1] = on[:, k]
                else:
                    left = np.where(x[:, f] == 0, self.missing_left[m, i], x[:, f] <= self.bin[m, i])
                    out[:, 2 * k], out[:, 2 * k + 1] = on[:, k] & left, on[:, k] & ~left
            on = out
        return on


@dataclass
class Boosted:
    """Trained models. ``alphas``: a quantile each, None for a mean. ``groups``: None, or the group that each model is about."""

    features: list[str]
    edges: list[np.ndarray]
    alphas: list[float | None]
    groups: list | None
    settings: Settings
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trees: list[Trees] = field(default_factory=list)

    def scores(self, x: np.ndarray, m: int) -> np.ndarray:
        out = np.full(len(x), self.base[m])
        for t in self.trees:
            out += t.leaf[m, t.places(x, m, self.settings.depth)]
        return out

    def predict(self, df: DataFrame, key: list[str], names: list[str]) -> DataFrame:
        """``key`` and an estimate of each model under ``names``."""
        model = self

        def work(batch, x):
            return [pa.array(model.scores(x, m)) for m in range(len(model.base))]

        return _mapped(df, self, key, names, work)

    def predict_own(self, df: DataFrame, key: list[str], group: str, name: str) -> DataFrame:
        """``key`` and the estimate of the model about the row's group; rows of other groups have none."""
        model, place = self, {g: m for m, g in enumerate(self.groups)}

        def work(batch, x):
            of = np.array([place.get(g, -1) for g in batch.column(group).to_pylist()], np.int64)
            out = np.full(len(x), np.nan)
            for m in np.unique(of[of >= 0]):
                out[of == m] = model.scores(x[of == m], m)
            return [pa.array(out, mask=of < 0)]

        return _mapped(df, self, list(dict.fromkeys([*key, group])), [name], work).select(*key, name)

    def mean_over(self, pool: DataFrame, df: DataFrame, key: list[str], drawn: list[str], name: str, group: str | None = None) -> DataFrame:
        """``key`` and each row's exact mean estimate, if its ``drawn`` features were those of any row of ``pool``, all alike.

        A leaf of a tree is a box of conditions. How many rows of the pool fulfil a leaf's conditions on the drawn features is
        counted once; a row's mean is then the sum, over the leaves that its other features can reach, of value and share.
        No row meets another. ``group``: each row's own model and its own group's pool."""
        model, free = self, np.array([f in drawn for f in self.features])
        shape = (len(self.base), len(self.trees), 1 << self.settings.depth)
        place = {g: m for m, g in enumerate(self.groups)} if group else {}
        of = (lambda batch: np.array([place.get(g, -1) for g in batch.column(group).to_pylist()], np.int64)) if group else lambda batch: np.zeros(batch.num_rows, np.int64)

        def count(batches):
            total, sizes = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
            for batch in batches:
                x, who = model.binned(batch), of(batch)
                for m in np.unique(who[who >= 0]):
                    mine = x[who == m]
                    sizes[m] += len(mine)
                    for k, t in enumerate(model.trees):
                        total[m, k] += t.shares(mine, m, model.settings.depth, free).sum(axis=0)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cell, -1 - np.arange(shape[0])])), pa.array(np.concatenate([total.ravel()[cell], sizes]))], ["cell", "n"])

        columns = [*self.features, *([group] if group else [])]
        counted = pool.select(*columns).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # leaves of all trees
        cell, n = (np.asarray(counted.column(c)) for c in ("cell", "n"))
        weight, sizes = np.zeros(shape), np.ones(shape[0])
        weight.ravel()[cell[cell >= 0]] = n[cell >= 0]
        sizes[-1 - cell[cell < 0]] = np.maximum(n[cell < 0], 1)
        weight /= sizes[:, None, None]

        def work(batch, x):
            who, out = of(batch), np.full(len(x), np.nan)
            for m in np.unique(who[who >= 0]):
                mine = x[who == m]
                total = np.full(len(mine), model.base[m])
                for k, t in enumerate(model.trees):
                    total += t.shares(mine, m, model.settings.depth, ~free) @ (weight[m, k] * t.leaf[m])
                out[who == m] = total
            return [pa.array(out, mask=who < 0)]

        return _mapped(df, self, list(dict.fromkeys([*key, *([group] if group else [])])), [name], work).select(*key, name)

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bins of the features, 0 where missing."""
        x = np.zeros((batch.num_rows, len(self.features)), np.int64)
        for k, (name, edges) in enumerate(zip(self.features, self.edges, strict=True)):
            v = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            x[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(edges, v, "left"))
        return x


def _mapped(df: DataFrame, model: Boosted, key: list[str], names: list[str], work: Callable) -> DataFrame:
    columns = list(dict.fromkeys([*key, *model.features]))
    schema = StructType([df.schema[k] for k in key])
    for n in names:
        schema = schema.add(n, "double")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *work(batch, model.binned(batch))], [*key, *names])

    numbers = [F.col(f"`{c}`").cast("double").alias(c) if c in model.features and c not in key else F.col(f"`{c}`") for c in columns]
    return df.select(*numbers).mapInArrow(mapped, schema)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins: distinct quantiles of its values."""
    shares = F.array(*(F.lit(k / (bins - 1)) for k in range(1, bins - 1)))
    row = df.agg(*(F.percentile_approx(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")), shares, 10_000).alias(f) for f in features)).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def train(df: DataFrame, features: list[str], label: str, alphas: list[float | None], key: list[str], settings: Settings = Settings(), group: str | None = None, mode: str = "all", edges: list[np.ndarray] | None = None, groups: list | None = None) -> Boosted:
    """Models of ``label``: one for each of ``alphas`` (``mode="all"``), or with one alpha one for each value of ``group``, learned
    from the group's rows (``"own"``) or from all others (``"out"``). Rows without a label are left out. ``key``: what tells rows
    apart for the sampling of rows. ``groups``: the values of ``group``, if only some are wanted."""
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    if mode != "all" and groups is None:
        groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]  # a row a group
    alphas = list(alphas) if mode == "all" else list(alphas) * len(groups)
    model = Boosted(features, bin_edges(rows, features) if edges is None else edges, alphas, None if mode == "all" else groups, settings)
    count, steps, depth = len(alphas), Steps(spark, "boosting"), settings.depth
    place = {} if mode == "all" else {g: m for m, g in enumerate(groups)}

    def encode(batches):
        for batch in batches:
            x = model.binned(batch).astype(np.uint8)
            of = np.zeros(len(x), np.int32) if mode == "all" else np.array([place.get(g, -1) for g in batch.column("_group").to_pylist()], np.int32)
            flat = pa.Array.from_buffers(pa.binary(len(features)), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, batch.column("_y"), batch.column("_u"), pa.array(of)], ["x", "y", "u", "of"])

    named = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    drawn = F.col(group).alias("_group") if group else F.lit(0).alias("_group")
    state = steps.staged(rows.select(*named, F.col(label).cast("double").alias("_y"), F.xxhash64(F.lit(settings.seed), *key).alias("_u"), drawn)
                         .mapInArrow(encode, "x binary, y double, u bigint, of int").withColumn("f", F.lit(None).cast("array<double>")))
    span = state.groupBy("of").agg(F.min("y"), F.max("y"), F.count(F.lit(1))).collect()  # a row a group
    low, high = np.zeros(count), np.zeros(count)
    for m in range(count):
        mine = [s for s in span if mode == "all" or (s[0] == m) == (mode == "own")]
        low[m], high[m] = (min(s[1] for s in mine), max(s[2] for s in mine)) if mine else (0.0, 0.0)

    def member(of, m):
        return np.ones(len(of), np.bool_) if mode == "all" else of == m if mode == "own" else of != m

    def summed(tree: Trees | None, since: list[Trees], kernel: Callable, base: np.ndarray, round_: int) -> tuple[np.ndarray, ...]:
        """Cells of all models: ``m``, ``cell``, ``n``, ``s``, ``lo``, ``hi``, in one pass over the rows."""
        def work(batches):
            n, s, lo, hi = {}, {}, {}, {}
            for batch in batches:
                x, y, u, of, f = _state(batch, len(features), count, base)
                looked = _uniform(u, round_) < settings.rows if round_ >= 0 else np.ones(len(y), np.bool_)
                for m in range(count):
                    on = looked & member(of, m)
                    if on.any():
                        xm, now = x[on], f[on, m].copy()
                        for t in since:
                            now += t.leaf[m, t.places(xm, m, depth)]
                        for store, part, how in zip((n, s, lo, hi), kernel(m, xm, y[on] - now), (np.add, np.add, np.minimum, np.maximum), strict=True):
                            store[m] = how(store[m], part) if m in store else part
            for m in n:
                cell = np.flatnonzero(n[m])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), m)), pa.array(cell), pa.array(n[m][cell].astype(np.int64)), pa.array(s[m][cell].astype(float)), pa.array(lo[m][cell].astype(float)), pa.array(hi[m][cell].astype(float))], ["m", "cell", "n", "s", "lo", "hi"])

        got = state.mapInArrow(work, "m bigint, cell bigint, n bigint, s double, lo double, hi double").groupBy("m", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        return tuple(np.asarray(got.column(c)) for c in ("m", "cell", "n", "s", "lo", "hi"))

    def leaves(tree: Trees | None, since, base, round_, ranges) -> np.ndarray:
        """The quantile or mean of the residuals of each leaf (of all rows, without a tree)."""
        size = 1 << depth if tree is not None else 1
        quantile = np.array([a is not None for a in alphas])

        def kernel(m, x, r):
            at = tree.places(x, m, depth) if tree is not None else np.zeros(len(x), np.int64)
            if quantile[m]:
                lo, width = ranges[0][m][at], np.maximum(ranges[1][m][at] - ranges[0][m][at], 1e-12)
                at = at * RESIDUAL_CELLS + np.clip(((r - lo) / width * RESIDUAL_CELLS).astype(np.int64), 0, RESIDUAL_CELLS - 1)
            n = np.bincount(at, minlength=size * (RESIDUAL_CELLS if quantile[m] else 1))
            return n, np.bincount(at, r, len(n)), np.zeros(len(n)), np.zeros(len(n))

        m, cell, n, s, _, _ = summed(tree, since, kernel, base, round_)
        out = np.zeros((count, size))
        for k in range(count):
            own = m == k
            if not quantile[k]:
                out[k, cell[own]] = s[own] / n[own]
                continue
            table = np.zeros((size, RESIDUAL_CELLS))
            table.ravel()[cell[own]] = n[own]
            for leaf in np.flatnonzero(table.sum(axis=1)):
                upto = np.cumsum(table[leaf])
                wanted = alphas[k] * upto[-1]
                c = int(np.searchsorted(upto, wanted - 1e-9, "left"))
                part = (wanted - (upto[c] - table[leaf, c])) / table[leaf, c]
                out[k, leaf] = ranges[0][k][leaf] + (ranges[1][k][leaf] - ranges[0][k][leaf]) * (c + part) / RESIDUAL_CELLS
        return out

    model.base = leaves(None, [], np.zeros(count), -1, (low[:, None], high[:, None]))[:, 0]
    since: list[Trees] = []
    for round_ in range(settings.rounds):
        tree = Trees.empty(count, depth)
        allowed = _allowed(settings, round_, len(features))
        ranges = (np.zeros((count, 1)), np.zeros((count, 1)))
        for level in range(depth):
            nodes, width = 1 << level, len(features) * (BINS + 1)

            def kernel(m, x, r, tree=tree, level=level, nodes=nodes, width=width):
                at = tree.places(x, m, level)
                pull = r if alphas[m] is None else (r > 0).astype(float)
                cell = (at[:, None] * width + np.arange(len(features)) * (BINS + 1) + x).ravel()
                # Behind the histograms a cell a node: the range of its residuals.
                n = np.concatenate([np.bincount(cell, minlength=nodes * width), np.bincount(at, minlength=nodes)])
                s = np.concatenate([np.bincount(cell, np.repeat(pull, len(features)), nodes * width), np.bincount(at, pull, nodes)])
                lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
                np.minimum.at(lo, nodes * width + at, r)
                np.maximum.at(hi, nodes * width + at, r)
                return n, s, lo, hi

            m, cell, n, s, lo, hi = summed(tree, since, kernel, model.base, round_)
            ranges = (np.zeros((count, nodes)), np.zeros((count, nodes)))
            for k in range(count):
                own = m == k
                table, pulls = np.zeros(nodes * (width + 1)), np.zeros(nodes * (width + 1))
                table[cell[own]], pulls[cell[own]] = n[own], s[own]
                last = own & (cell >= nodes * width)
                ranges[0][k][cell[last] - nodes * width], ranges[1][k][cell[last] - nodes * width] = lo[last], hi[last]
                shape = (nodes, len(features), BINS + 1)
                _split(tree, k, level, table[:nodes * width].reshape(shape), pulls[:nodes * width].reshape(shape), alphas[k], allowed, settings.least)
        ranges = tuple(np.repeat(r, 2, axis=1) for r in ranges)
        tree.leaf = settings.rate * leaves(tree, since, model.base, round_, ranges)
        model.trees.append(tree)
        since.append(tree)
        if len(since) == KEPT and round_ + 1 < settings.rounds:
            before, state = state, _advanced(steps, state, list(since), len(features), count, model.base, depth)
            steps.dropped(before)
            since.clear()
    steps.dropped(state)
    return model


def _state(batch: pa.RecordBatch, features: int, models: int, base: np.ndarray) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(n, features).astype(np.int64)
    f = batch.column("f")
    now = np.tile(base, (n, 1)) if f.null_count == n else f.flatten().to_numpy(zero_copy_only=False).reshape(n, models)
    return x, batch.column("y").to_numpy(), batch.column("u").to_numpy(), batch.column("of").to_numpy(), now


def _advanced(steps: Steps, state: DataFrame, since: list[Trees], features: int, models: int, base: np.ndarray, depth: int) -> DataFrame:
    """The rows with their estimates after the trees ``since``."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, _, _, _, f = _state(batch, features, models, base)
                f = f.copy()
                for m in range(models):
                    for t in since:
                        f[:, m] += t.leaf[m, t.places(x, m, depth)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, models), pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "u", "of")), lists], ["x", "y", "u", "of", "f"])

    return steps.staged(state.mapInArrow(work, "x binary, y double, u bigint, of int, f array<double>"))


def _uniform(u: np.ndarray, k: int) -> np.ndarray:
    """Numbers from 0 to 1 drawn by hash, the same for a row and round wherever it lies."""
    h = (u.astype(np.int64).view(np.uint64) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def _allowed(settings: Settings, round_: int, features: int) -> np.ndarray:
    """The features that a round looks at: those whose numbers are the least."""
    drawn = _uniform(np.arange(features, dtype=np.int64) * 7919 + settings.seed, round_ + 1_000_000)
    out = np.zeros(features, np.bool_)
    out[np.argsort(drawn, kind="stable")[:max(1, round(settings.features * features))]] = True
    return out


def _split(tree: Trees, m: int, level: int, n: np.ndarray, s: np.ndarray, alpha: float | None, allowed: np.ndarray, least: int) -> None:
    """The best split of each node of a level, from histograms by node, feature and bin."""
    pull = s if alpha is None else s - (1 - alpha) * n
    total_n, total = n.sum(axis=2), pull.sum(axis=2)
    best, chosen = np.full(len(n), 1e-9), {}
    for missing_left in (True, False):
        left_n, left = np.cumsum(n[:, :, 1:-1], axis=2), np.cumsum(pull[:, :, 1:-1], axis=2)
        if missing_left:
            left_n, left = left_n + n[:, :, :1], left + pull[:, :, :1]
        right_n, right = total_n[:, :, None] - left_n, total[:, :, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left**2 / left_n + right**2 / right_n - (total**2 / total_n)[:, :, None]
        gain = np.where((left_n >= least) & (right_n >= least) & allowed[None, :, None], np.round(gain, 9), -np.inf)
        flat = gain.reshape(len(n), -1)
        at = np.argmax(flat, axis=1)
        for node in range(len(n)):
            if flat[node, at[node]] > best[node]:
                best[node], chosen[node] = flat[node, at[node]], (at[node] // gain.shape[2], at[node] % gain.shape[2] + 1, missing_left)
    for node, (f, b, missing_left) in chosen.items():
        i = (1 << level) - 1 + node
        tree.feature[m, i], tree.bin[m, i], tree.missing_left[m, i] = f, b, missing_left
