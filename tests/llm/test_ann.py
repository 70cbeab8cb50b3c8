import numpy as np

from skyloom.llm import ann


def brute(ids, x, every, k):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ v
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    want = brute(data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(float), 20, 20)
    got = ann.nearest(rows, 20, 20, shard_rows=500).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == list(range(1, 21))
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
        total += 20
    assert set(got.query_id) == set(want) and hits / total > 0.95


def test_norms_that_differ(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)) * rng.lognormal(0, 1, (900, 1))
    rows = spark.createDataFrame([(i, v.tolist(), "e") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    want = brute(np.arange(900), x, 20, 5)
    got = ann.nearest(rows, 20, 5, shard_rows=400).toPandas()
    assert np.mean([len(set(g.vec_id) & {i for i, _ in want[q]}) / 5 for q, g in got.groupby("query_id")]) > 0.95


def test_odd_rows(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [])]
    good = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (40, [0.0, 2.0]), (9, [3.0, 4.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 9, 3.0), (20, 2, 21, 1.0), (20, 3, 22, 1.0), (20, 4, 40, 0.0), (40, 1, 9, 8.0), (40, 2, 20, 0.0), (40, 3, 21, 0.0), (40, 4, 22, 0.0)]
    assert ann.nearest(df.limit(0), 20, 20).collect() == []


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0]) for i in range(5)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20, shard_rows=700).where("query_id = 40").orderBy("rank").collect()
    # (i, 1) scores i + 2: 5004 scores 6; 5003 and all equal vectors score 5, the smallest ids first.
    assert [(r.vec_id, r.score) for r in got] == [(5004, 6.0), *((i, 5.0) for i in range(19))]


def recall(got, x, every, k):
    """Share of the true nearest by exact order; vectors are scaled so that no product overflows."""
    want = brute(np.arange(len(x)), x, every, k)
    return np.mean([len(set(g.vec_id) & {i for i, _ in want[q]}) / k for q, g in got.groupby("query_id")])


def test_one_vector_far_longer_than_others(spark):
    rng = np.random.default_rng(1)
    for factor in (1e3, 1e4, 1e12):
        x = rng.normal(size=(1500, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[7] *= factor
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert recall(ann.nearest(rows, 20, 20, shard_rows=800).toPandas(), x, 20, 20) > 0.95


def test_products_beyond_double_precision(spark):
    x = np.random.default_rng(2).normal(size=(1200, 16))
    for factor in (1e200, 1.0):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * factor)], "vec_id long, embedding array<double>")
        got = ann.nearest(rows, 20, 10, shard_rows=600).toPandas()
        assert recall(got, x, 20, 10) > 0.95
        assert (got.score > 0).all() and np.isinf(got.score).all() == (factor > 1)


def test_dealing():
    assert ann.dealing([], 100, 10) == []
    assert ann.dealing([(5, 3), (-2, 4), (6, 950), (9, 1)], 400, 10) == [(-2, 0, 1), (5, 0, 1), (6, 1, 3), (9, 4, 1)]


def test_work_of_a_shard(monkeypatch):
    n, rows, pairs = 3000, [], []
    x = np.random.default_rng(4).normal(size=(n, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    prune, distances = ann.prune, ann.Graph._distances
    monkeypatch.setattr(ann, "prune", lambda v, centre, *a, **k: rows.append(len(centre)) or prune(v, centre, *a, **k))
    monkeypatch.setattr(ann.Graph, "_distances", lambda g, q, nodes: pairs.append(nodes.size) or distances(g, q, nodes))
    graph = ann.build(x)
    # A neighbour of new vectors is pruned only once it has more edges than there is room for, not for each batch of them.
    assert sum(rows) < 4 * n
    assert graph.edges.shape[1] == ann.DEGREE and (graph.edges < n).all()
    pairs.clear()
    found, dist = graph.search(x[:200], 100)
    # Distances are taken to nodes that a query has not met, which are fewer than the neighbours that it is shown.
    assert sum(pairs) < 0.75 * 200 * 100 * ann.DEGREE
    d = ((x[:200, None].astype(float) - x[None]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1)[:, :20]
    assert np.mean([len(set(f[:20].tolist()) & set(w.tolist())) / 20 for f, w in zip(found, want, strict=True)]) > 0.97
    assert (np.diff(dist, axis=1) >= 0).all() and np.allclose(dist, np.take_along_axis(d, found, 1), atol=1e-5)


def test_few_clusters():
    n, rng = 8000, np.random.default_rng(1)
    centres = rng.normal(size=(5, 64))
    x = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[rng.integers(0, 5, n)] + rng.normal(size=(n, 64)) / 40
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, asked, got = ann.Index(ann.pack_index(np.arange(n), x)), np.arange(0, n, 40), {}
    for q, v, _, _ in index.search(asked, x[asked], 20, ann.SEARCH_BEAM):
        got.setdefault(q, set()).add(v)
    want = brute(np.arange(n), x, 40, 20)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) > 0.95


def test_a_graph_of_more_vectors_than_are_compared(monkeypatch):
    monkeypatch.setattr(ann, "FEW", 500, raising=False)
    x = np.random.default_rng(6).normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = ann.build(x).search(x[:200], 100)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f[:20].tolist()) & set(w.tolist())) / 20 for f, w in zip(found, want, strict=True)]) > 0.97


def test_fewer_nodes_than_the_beam_is_wide():
    x = np.random.default_rng(5).normal(size=(7, 4)).astype(np.float32)
    found, dist = ann.build(x).search(x[:3], 12)
    assert (np.sort(found[:, :7], axis=1) == np.arange(7)).all() and (found[:, 7:] == -1).all() and np.isinf(dist[:, 7:]).all()
