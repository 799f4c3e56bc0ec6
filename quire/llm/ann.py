"""Operator 8: approximate nearest neighbours by learned partitions.

On a bounded sample a k-nearest-neighbour graph is cut into balanced parts, and a small classifier learns to tell a
vector's part; its biases are set so that it deals rows evenly. Every row goes to its most probable part. A second
classifier of the same form learns in which parts a vector's neighbours are. A query goes to its most probable parts
until their probability reaches a bound, which is set on sampled vectors held back from training, so that the asked
recall is reached, and on to further parts until they hold at least k other rows. The rows there are ranked by exact
inner product in double precision.

The number of parts grows with the root of the table, so that parts and a query's list of parts grow alike. Parts have
no cap: a part's rows are split into blocks, as many as its size needs, and a query meets all of them. How many parts a
query needs depends on how much the vectors cluster: without any clusters most parts are probed.

Vectors that are null or zero, hold null or non-finite numbers, or are not as long as most take no part. Equal scores
go to the smaller id. Rows of null id take no part. Rows of equal id count as one, whose best score counts. Other
columns of the input are left alone. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType

from .text import small_batches, stored

#: Vectors that the partitions are learned from, at most: those of lowest xxhash64(id), and 64 for each part.
SAMPLE_ROWS = 65_536
#: Parts, at most; fewer for smaller tables.
MOST_PARTS = 1_024
RECALL = 0.95
BLOCK_ROWS, BLOCK_QUERIES = 2_000, 500


def parts_for(rows: int) -> int:
    """A power of two, about the root of the rows."""
    return 1 << min(int(np.log2(max(rows, 1)) / 2), int(np.log2(MOST_PARTS)))


@dataclass
class Net:
    """A classifier with one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


@dataclass
class Router:
    rows: Net  # tells a row's part
    queries: Net  # tells where a query's neighbours are
    reach: float  # probability that a query's parts have together

    @property
    def parts(self) -> int:
        return len(self.rows.b2)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.rows.logits(x).argmax(1)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each query, most probable first, and the probability of those before each."""
        z = self.queries.logits(x)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, 1) - p

    def probes(self, x: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the parts to try: up to `reach`, and until they hold more than k rows."""
        order, before = self.ranked(x)
        held = np.cumsum(sizes[order], 1) - sizes[order]
        tried = (before < self.reach) | (held <= k)
        return [o[t & (sizes[o] > 0)] for o, t in zip(order, tried, strict=True)]


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k rows of largest inner product with each row (of those in `of`) but itself."""
    k, of = min(k, len(x) - 1), np.arange(len(x)) if of is None else of
    out = np.empty((len(of), k), np.int64)
    for a in range(0, len(of), 256):
        own = of[a : a + 256]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + 256] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Balanced parts with few cut edges: median splits along main directions, then moves to the part of most neighbours."""
    part = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            new[own[np.argsort(x[own] @ main, kind="stable")[len(own) // 2 :]]] += 1
        part = new
    most = int(np.ceil(len(x) / parts * slack))
    edges = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.bincount(edges[0] * parts + part[edges[1]], minlength=len(x) * parts) + np.bincount(edges[1] * parts + part[edges[0]], minlength=len(x) * parts)
        votes = votes.reshape(len(x), parts)
        want = votes.argmax(1)
        gain = votes[rows, want] - votes[rows, part]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.lexsort((-gain[movers], want[movers]))]  # by the part they want, largest gain first
        first = np.searchsorted(want[movers], want[movers], "left")
        room = most - np.bincount(part, minlength=parts)
        movers = movers[np.arange(len(movers)) - first < room[want[movers]]]
        part[movers] = want[movers]
        if len(movers) < len(x) // 200:
            break
    return part


def _train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 15) -> Net:
    """Least cross entropy of target distributions, by Adam. x: unit vectors."""
    parts, dim = target.shape[1], x.shape[1]
    values = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ values[0] + values[1], 0)
            z = h @ values[2] + values[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ values[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                values[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Net(*values)


def _shares(part: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Of each row, how its neighbours lie in parts."""
    rows = np.repeat(np.arange(len(near)), near.shape[1])
    return np.bincount(rows * parts + part[near].ravel(), minlength=len(near) * parts).reshape(-1, parts) / near.shape[1]


def _balanced(net: Net, x: np.ndarray, rounds: int = 30) -> Net:
    """Biases by which rows are dealt evenly."""
    z = net.logits(x)
    bias = np.zeros(z.shape[1])
    even = len(x) / z.shape[1]
    for k in range(rounds):
        sizes = np.bincount((z + bias).argmax(1), minlength=len(bias))
        bias -= 0.5 * 0.93**k * np.log((sizes + 0.1 * even) / (1.1 * even))
    return Net(net.w1, net.b1, net.w2, net.b2 + bias)


def fit(x: np.ndarray, parts: int, recall: float = RECALL, k: int = 20, seed: int = 3) -> Router:
    """parts: a power of two. A seventh of the rows is held back to set how far a query reaches."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if len(x) else 1
    if parts < 2 or len(x) < 4 * parts or len(x) <= 2 * k:
        one = Net(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
        return Router(one, one, 1.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mixed = rng.permutation(len(x))
    taught, held = np.sort(mixed[len(x) // 7 :]), np.sort(mixed[: len(x) // 7])
    own = unit[taught]
    near = neighbours(x[taught], k)
    part = cut_graph(own, near[:, :10], parts)
    target = 0.5 * _shares(part, near[:, :10], parts)
    target[np.arange(len(own)), part] += 0.5
    rows = _balanced(_train(own, target, rng), own)
    queries = _train(own, _shares(rows.logits(own).argmax(1), near, parts), rng)
    router = Router(rows, queries, 1.0)
    near = neighbours(x, k, held)
    order, before = router.ranked(x[held])
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(place, router.part(x)[near], 1), 1)  # reach at which a neighbour is met
    router.reach = min(1.0, float(np.quantile(needed, recall)) + 1e-9)
    return router


def usable(vector: Column, dim: int) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == dim) & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _packed(kind: str, dtype):
    def pack(table: pa.Table) -> pa.Table:
        x = np.array(table["x"].combine_chunks().flatten(), dtype)
        return pa.table({"part": table["part"][:1], kind: table[kind][:1], "ids": pa.array([np.array(table["id"], np.int64).tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary())})

    return pack


def best_of(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of each query, a pair's best score only; ties to the smaller id."""
    order = np.lexsort((-s, ids, q))
    q, ids, s = q[order], ids[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, s = q[new], ids[new], s[new]
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], ids[keep], s[keep]


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample_rows: int = SAMPLE_ROWS, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query (rows where `queries` holds) among all other rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[vector].dataType
    name, dtype = ("float", np.float32) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else ("double", np.float64)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("x"), queries.alias("asks")).where("id is not null")
    sizes = rows.where("x is not null").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, n = sizes[0] if sizes else (0, 0)
    rows = rows.where(usable(F.col("x"), dim)).withColumn("x", F.transform("x", lambda v: v.cast(name)))
    wanted = parts or parts_for(n)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample_rows, 64 * wanted)).select("x").collect()
    router = fit(np.array([r[0] for r in sample], float).reshape(-1, max(dim, 1)), wanted, recall, k)
    n_parts = router.parts

    def vectors(batch) -> np.ndarray:
        return np.array(batch.column("x").flatten(), np.float64).reshape(len(batch), -1)

    def route(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.part(vectors(batch)).astype(np.int32))], ["id", "x", "asks", "part"])

    routed = stored(rows.mapInArrow(route, f"id bigint, x array<{name}>, asks boolean, part int"), "ann")
    count = {r[0]: r[1] for r in routed.groupBy("part").count().collect()}  # a number for each part
    held = np.array([count.get(p, 0) for p in range(n_parts)])

    def ask(batches):
        for batch in batches:
            if len(batch):
                tried = [t.tolist() for t in router.probes(vectors(batch), held, k)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(tried, pa.list_(pa.int32()))], ["id", "x", "tried"])

    asked = stored(routed.where("asks").select("id", "x").mapInArrow(ask, f"id bigint, x array<{name}>, tried array<int>"), "asked").select("id", "x", F.explode("tried").alias("part"))
    many = {r[0]: r[1] for r in asked.groupBy("part").count().collect()}

    def blocks(sizes: dict[int, int], size: int) -> Column:
        return F.greatest(F.get(F.array(*[F.lit(-(-sizes.get(p, 0) // size)) for p in range(n_parts)]), F.col("part")), F.lit(1))

    packed = routed.withColumn("block", F.pmod(F.xxhash64("id", "x"), blocks(count, BLOCK_ROWS)).cast("int"))
    packed = packed.select("part", "block", "id", "x").groupBy("part", "block").applyInArrow(_packed("block", dtype), "part int, block int, ids binary, xs binary")
    asking = asked.withColumn("ask", F.pmod(F.xxhash64("id", "x"), blocks(many, BLOCK_QUERIES)).cast("int"))
    asking = asking.groupBy("part", "ask").applyInArrow(_packed("ask", dtype), "part int, ask int, ids binary, xs binary")
    asking = asking.select("part", "ask", F.col("ids").alias("qids"), F.col("xs").alias("qs"), F.explode(F.sequence(F.lit(0), (blocks(count, BLOCK_ROWS) - 1).cast("int"))).alias("block"))
    pairs = asking.join(packed, ["part", "block"])

    def rank(batches):
        found, size = [], 0
        for batch in batches:
            for qids, qs, ids, xs in zip(*(batch.column(c).to_pylist() for c in ("qids", "qs", "ids", "xs")), strict=True):
                qids, ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                s = np.frombuffer(qs, dtype).reshape(len(qids), -1).astype(np.float64) @ np.frombuffer(xs, dtype).reshape(len(ids), -1).astype(np.float64).T
                s[qids[:, None] == ids[None]] = -np.inf
                most = k + len(ids) - len(np.unique(ids))  # rows of one id may come first
                least = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most] if most < len(ids) else -np.inf
                q, c = np.nonzero((s >= least) & (s > -np.inf))
                found.append((qids[q], ids[c], s[q, c]))
                size += len(q)
                if size > 2_000_000:
                    found = [best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), k)]
                    size = len(found[0][0])
        if found:
            q, ids, s = best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
            for a in range(0, len(q), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (q, ids, s)], ["query_id", "vec_id", "score"])

    found = pairs.select("qids", "qs", "ids", "xs").mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
