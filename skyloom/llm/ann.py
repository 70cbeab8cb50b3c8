"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to bands of lengths within a factor of 2, and in a band to shards by a hash of their id, of
``SHARD_BYTES`` at most (smaller ones while cores are free). In a shard, vectors enter a directed graph in batches: a greedy search (up to ``FEW`` vectors, a comparison with all of
them) proposes neighbours, and relaxed pruning keeps a neighbour only if no kept one is nearer to it by the factor
1/``ALPHA``; reverse edges are pruned the same way, once a node has more than there is room for. A query searches each
shard's graph with a beam, from the medoid and nodes by chance, so that it gets into clusters to which no edges lead; the
best of all shards are ranked by exact scores in double precision.

The largest inner product is found as the smallest distance once each vector has one more component that makes
all lengths of its shard equal; as these are alike, single precision does for the walk through the graph, however
long or short the vectors of other bands are. Bands that hold no more vectors than the beam is wide are put
together, as all of a graph that small is visited. Equal vectors are one node with many ids. Every row is indexed;
nothing is sampled. The index of a shard is read once for each ``QUERY_BLOCK`` queries, which stream past it.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part, nor do null ids. Of rows with one id, the smallest vector counts. Ties go to the smaller
id; a query never finds its own id. A product beyond double precision scores infinite, but is ranked by its true size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, stored

#: Bytes of a shard's vectors at most, vectors below which it is not made smaller, queries that one task takes to a shard.
SHARD_BYTES, SHARD_LEAST, QUERY_BLOCK = 64 << 20, 8192, 100_000
#: Edges of a node, width of the beam in building and in searching, nodes expanded at a time, relaxation of pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, STRIDE, ALPHA = 32, 64, 160, 4, 1.2
#: Edges that a node may have while its graph is built: only beyond them is it pruned to DEGREE again.
ROOM = 48
#: Vectors in a graph up to which those that enter are compared with all of it, ``_BLOCK`` at a time. That takes no more
#: time than a walk and misses no neighbour.
FEW = 131_072
#: Nodes at which each search enters: the medoid and others by chance, as few edges lead from one cluster to another.
ENTRIES = 256
_BATCH, _BLOCK = 256, 16384


class Graph:
    """A shard's vectors (with the added component), edges (-1: none) and the nodes at which searches enter."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.x, self.edges, self.entries = x, edges, entries
        self.norms = np.einsum("nd,nd->n", x, x)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For a block of queries the ids (-1: none) and distances of the nearest nodes met, nearest first."""
        many, n = len(q), len(self.x)
        met = np.zeros((many, n + 1), bool)  # the last column stands for "no edge"
        met[:, n] = True
        met[:, self.entries] = True
        # A candidate is one integer of its distance, its node and whether it was expanded, so that one sort ranks them.
        none = _candidates(np.array([np.inf]), np.array([n]))[0]
        own = self.x[self.entries]
        first = self.norms[self.entries] - 2 * q @ own.T + np.einsum("qd,qd->q", q, q)[:, None]
        first = np.sort(_candidates(first, np.broadcast_to(self.entries, first.shape)), axis=1)[:, :beam]
        held = np.full((many, beam), none)
        held[:, :first.shape[1]] = first
        active = np.arange(many)
        while len(active):
            # The first STRIDE unexpanded nodes of each query.
            mine = held[active]
            waiting = mine & 1 == 0
            order = np.cumsum(waiting, axis=1, dtype=np.int32)
            row, col = np.nonzero(waiting & (order <= STRIDE))
            nodes = np.full((len(active), STRIDE), n)
            nodes[row, order[row, col] - 1] = _nodes(mine[row, col])
            mine[row, col] |= 1
            near = np.where(nodes[:, :, None] < n, self.edges[np.minimum(nodes, n - 1)], n).reshape(len(active), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[met[active[:, None], near]] = n
            near.sort(axis=1)
            near = near[:, :max(1, int((near < n).sum(axis=1).max()))]
            met[active[:, None], near] = True
            more = _candidates(self._distances(q[active], near), near)
            mine = np.sort(np.concatenate([mine, more], axis=1), axis=1)[:, :beam]
            held[active] = mine
            active = active[(mine & 1 == 0).any(axis=1)]
        found = _nodes(held)
        return np.where(found < n, found, -1), (held >> 32).astype(np.int32).view(np.float32)

    def _distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        at = np.minimum(nodes, len(self.x) - 1)
        d = self.norms[at] - 2 * np.matmul(self.x[at], q[:, :, None])[:, :, 0] + np.einsum("qd,qd->q", q, q)[:, None]
        return np.where(nodes < len(self.x), d, np.inf)


def _candidates(distances: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Candidates as integers: the bits of a float that is not negative order as it does. The last bit says that there is
    nothing to expand: it is set later for expanded nodes, and here for infinite distances, which are no nodes."""
    return np.maximum(distances, 0).astype(np.float32).view(np.int32).astype(np.int64) << 32 | nodes << 1 | np.isinf(distances)


def _nodes(candidates: np.ndarray) -> np.ndarray:
    return (candidates & 0xFFFFFFFF) >> 1


def prune(x: np.ndarray, centre: np.ndarray, nodes: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Relaxed pruning of candidate rows (-1: none) for the points ``centre``: edges, nearest first."""
    many, width = nodes.shape
    own = x[np.maximum(nodes, 0)]
    norms = np.einsum("mcd,mcd->mc", own, own)
    p = x[centre]
    to_p = norms - 2 * np.matmul(own, p[:, :, None])[:, :, 0] + np.einsum("md,md->m", p, p)[:, None]
    between = np.matmul(own, own.transpose(0, 2, 1))
    between *= -2
    between += norms[:, :, None]
    between += norms[:, None, :]
    between *= alpha * alpha
    alive = (nodes >= 0) & (nodes != centre[:, None])
    out = np.full((many, degree), -1)
    rows = np.arange(many)
    for k in range(degree):
        d = np.where(alive, to_p, np.inf)
        best = d.argmin(axis=1)
        found = np.isfinite(d[rows, best])
        if not found.any():
            break
        out[found, k] = nodes[rows[found], best[found]]
        alive &= ~(found[:, None] & (between[rows, best] <= to_p))
        alive[rows, best] = False
    return out


def build(x: np.ndarray) -> Graph:
    """The graph of distinct vectors."""
    n = len(x)
    rng = np.random.default_rng(n)
    edges = np.full((n, ROOM), -1)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = rng.permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    graph = Graph(x, edges, order[:ENTRIES])
    at = 1
    while at < n:
        batch = order[at:at + min(_BATCH, max(1, at))]
        near = _nearest(x, batch, order[:at]) if at <= FEW else graph.search(x[batch], min(BUILD_BEAM, n))[0]
        at += len(batch)
        # Points of one batch don't find each other in the graph yet: each is also offered its nearest ones here.
        mates = _mates(x, batch)
        edges[batch, :DEGREE] = prune(x, batch, _unique(np.concatenate([near, mates], axis=1)))
        _reverse(x, edges, batch)
    wide = np.flatnonzero((edges >= 0).sum(axis=1) > DEGREE)
    for lo in range(0, len(wide), 512):
        nodes = wide[lo:lo + 512]
        edges[nodes, :DEGREE] = prune(x, nodes, edges[nodes])
    graph.edges = edges[:, :DEGREE].copy()
    _reach(graph)
    return graph


def _nearest(x: np.ndarray, batch: np.ndarray, entered: np.ndarray, k: int = BUILD_BEAM) -> np.ndarray:
    found, far = [], []
    for lo in range(0, len(entered), _BLOCK):
        nodes = entered[lo:lo + _BLOCK]
        own = x[nodes]
        d = np.einsum("nd,nd->n", own, own) - 2 * x[batch] @ own.T
        best = np.argpartition(d, min(k, len(nodes)) - 1, axis=1)[:, :k]
        found.append(nodes[best])
        far.append(np.take_along_axis(d, best, 1))
    nodes, d = np.concatenate(found, axis=1), np.concatenate(far, axis=1)
    return np.take_along_axis(nodes, np.argsort(d, axis=1)[:, :k], 1)


def _mates(x: np.ndarray, batch: np.ndarray, k: int = 8) -> np.ndarray:
    own = x[batch]
    d = np.einsum("nd,nd->n", own, own)[None, :] - 2 * own @ own.T
    np.fill_diagonal(d, np.inf)
    return batch[np.argsort(d, axis=1)[:, :min(k, len(batch) - 1)]]


def _unique(nodes: np.ndarray) -> np.ndarray:
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return nodes


def _reverse(x: np.ndarray, edges: np.ndarray, batch: np.ndarray) -> None:
    source = np.repeat(batch, edges.shape[1])
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, begin, size = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 512):
        some, width = slice(lo, lo + 512), int(size[lo:lo + 512].max())
        take = np.arange(width)[None, :] < size[some][:, None]
        more = np.where(take, source[np.minimum(begin[some][:, None] + np.arange(width), len(source) - 1)], -1)
        every = _unique(np.concatenate([edges[nodes[some]], more], axis=1))
        count = (every >= 0).sum(axis=1)
        every = np.sort(every, axis=1)[:, ::-1]
        full = count > edges.shape[1]
        own = np.full((len(count), edges.shape[1]), -1)
        own[:, :min(every.shape[1], edges.shape[1])] = every[:, :edges.shape[1]]
        if full.any():
            own[full] = -1
            own[full, :DEGREE] = prune(x, nodes[some][full], every[full][:, :int(count.max())])
        edges[nodes[some]] = own


def _reach(graph: Graph) -> None:
    """Adds edges until every node can be reached from the entries."""
    n = len(graph.x)
    seen = np.zeros(n, bool)
    seen[graph.entries] = True
    front = graph.entries
    while True:
        while len(front):
            near = graph.edges[front].ravel()
            near = np.unique(near[near >= 0])
            front = near[~seen[near]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return
        # The lost node hangs on to the nearest reached one, in an added column if that one's edges are all taken.
        near, _ = graph.search(graph.x[lost[:1]], min(BUILD_BEAM, n))
        to = int(near[0][near[0] >= 0][0])
        free = np.flatnonzero(graph.edges[to] < 0)
        if not len(free):
            graph.edges = np.concatenate([graph.edges, np.full((n, 4), -1)], axis=1)
            free = np.flatnonzero(graph.edges[to] < 0)
        graph.edges[to, free[0]] = lost[0]
        seen[lost[0]] = True
        front = lost[:1]


def pack_index(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A shard's index: distinct vectors in double precision, their ids in order, and the graph."""
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    starts = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
    near_one = np.ldexp(distinct, -int(np.frexp(np.abs(distinct).max())[1]))  # squares neither overflow nor vanish
    near_one /= np.sqrt((near_one * near_one).sum(axis=1).max())
    more = np.sqrt(np.clip(1 - (near_one * near_one).sum(axis=1), 0, None))
    graph = build(np.concatenate([near_one, more[:, None]], axis=1).astype(np.float32))
    out = io.BytesIO()
    np.savez(out, x=distinct, ids=ids[order], starts=starts, edges=graph.edges.astype(np.int32), entries=graph.entries, points=graph.x)
    return out.getvalue()


class Index:
    """A shard's index as ``pack_index`` gave it."""

    def __init__(self, data: bytes):
        f = np.load(io.BytesIO(data))
        self.x, self.ids, self.starts = f["x"], f["ids"], f["starts"]
        self.graph = Graph(f["points"], f["edges"].astype(np.int64), f["entries"])
        self.exponent = int(np.frexp(np.abs(self.x).max())[1])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float, float]]:
        """(query id, vector id, score, size beyond double precision) of each query's best k in the shard."""
        beam = int(beam * max(1, len(self.x) / _BLOCK) ** 0.5)  # a larger graph hides more from a narrow beam
        for lo in range(0, len(queries), _BATCH):
            q, names = queries[lo:lo + _BATCH], query_ids[lo:lo + _BATCH]
            unit = q / np.abs(q).max(axis=1, keepdims=True)
            unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            near, _ = self.graph.search(np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32), min(max(beam, k + 1), max(2, len(self.x))))
            for name, vector, nodes in zip(names.tolist(), q, near, strict=True):
                nodes = nodes[nodes >= 0]
                found = []
                for score, size, node in zip(*self._scores(nodes, vector), nodes.tolist(), strict=True):
                    some = self.ids[self.starts[node]:min(self.starts[node + 1], self.starts[node] + k + 1)].tolist()
                    found += [(-score, -size, i) for i in some if i != name]
                for score, size, i in sorted(found)[:k]:
                    yield name, i, -score, -size

    def _scores(self, nodes: np.ndarray, vector: np.ndarray) -> tuple[list[float], list[float]]:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = self.x[nodes] @ vector
            size = np.zeros(len(nodes))
            beyond = ~np.isfinite(scores)
            if beyond.any():
                e = int(np.frexp(np.abs(vector).max())[1])
                small = np.ldexp(self.x[nodes[beyond]], -self.exponent) @ np.ldexp(vector, -e)
                scores[beyond] = np.ldexp(small, self.exponent + e)
                size[beyond] = np.sign(small) * np.maximum(0, np.log2(np.maximum(np.abs(small), 1e-300)) + self.exponent + e)
                size[np.isfinite(scores)] = 0
        return scores.tolist(), size.tolist()


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (double precision) of the rows that take part, one for each id."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    picked = picked.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = picked.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return picked.where(F.size("embedding") == (usual.dims if usual else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _banded(vectors: DataFrame) -> DataFrame:
    """Adds ``band``: the length's logarithm, rounded."""
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("_top")) * (x / F.col("_top")))
    return vectors.withColumn("_top", top).withColumn("band", F.floor(F.log2("_top") + F.log2(square) / 2 + 0.5).cast("int")).drop("_top")


def dealing(bands: list[tuple[int, int]], per_shard: int, beam: int) -> list[tuple[int, int, int]]:
    """(band, its first shard, its number of shards) of (band, vectors): small bands in order share one."""
    out, shard, held, n = [], 0, [], 0
    for band, count in [*sorted(bands), (0, None)]:
        if held and (count is None or n + count > beam):
            shards = max(1, -(-n // per_shard))
            out += [(b, shard, shards) for b in held]
            shard, held, n = shard + shards, [], 0
        held.append(band)
        n += count or 0
    return out


_INDEX = pa.schema([("shard", pa.int32()), ("content", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("size", pa.float64())])


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch."""
    ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
    return ids, batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def nearest(rows: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM, shard_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each vector whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = stored(_banded(valid_vectors(rows, id_col, vector_col)), "ann-vectors")
    bands = vectors.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"), F.max(F.size("embedding")).alias("dims")).collect()  # a row a power of two
    n, asked, dims = sum(r.n for r in bands), sum(r.asked for r in bands), max((r.dims for r in bands), default=1)
    cores = spark.sparkContext.defaultParallelism
    per_shard = shard_rows or min(max(-(-n // cores), SHARD_LEAST), max(1, SHARD_BYTES // (8 * dims)))
    table = dealing([(r.band, r.n) for r in bands], per_shard, beam)
    shards = max((first + many for _, first, many in table), default=1)
    blocks = max(1, -(-asked // QUERY_BLOCK))

    def indexed(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            ids, x = _vectors(batch)
            of = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            for shard in np.unique(of).tolist():
                parts.setdefault(shard, []).append((ids[of == shard], x[of == shard]))
        for shard, found in parts.items():
            yield shard, pack_index(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]))

    dealt = (vectors.join(F.broadcast(spark.createDataFrame(table, "band int, first int, many int")), "band")
             .select("vec_id", "embedding", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("shard")))
    index = stored(dealt.repartitionById(shards, "shard").mapInArrow(lambda b: batches_of(indexed(b), _INDEX, 1), "shard int, content binary"), "ann-index")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    units = index.select("shard", numbers(blocks).alias("block"), F.lit(0).alias("kind"), "content", none.cast("long").alias("vec_id"), none.cast("array<double>").alias("embedding"))
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        numbers(shards).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), none.cast("binary").alias("content"), "vec_id", "embedding")

    def searched(batches):
        unit, opened = None, None
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("unit")).to_numpy()
            content = batch.column(batch.schema.get_field_index("content"))
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if content[lo].is_valid:  # a unit's index comes before its queries
                    unit, opened, lo = of[lo], Index(content[lo].as_py()), lo + 1
                if lo < hi and unit == of[lo]:
                    yield from opened.search(*_vectors(batch.slice(lo, hi - lo)), k, beam)

    met = (units.unionByName(queries).withColumn("unit", F.col("shard") * F.lit(blocks) + F.col("block")).select("unit", "kind", "content", "vec_id", "embedding")
           .repartitionById(shards * blocks, "unit").sortWithinPartitions("unit", "kind"))
    found = met.mapInArrow(lambda b: batches_of(searched(b), _FOUND), "query_id long, vec_id long, score double, size double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
