"""Approximate nearest neighbours with balanced posting lists.

* Centroids are fitted on a bounded sample (``SAMPLE_PER_LIST`` vectors a list, in an
  order by hash) with a size penalty, which keeps the lists balanced.
* Every vector is indexed: in the list of its nearest centroid, and, near a boundary, in
  up to ``REPLICAS`` lists: those whose centroid is at most ``CLOSURE`` times as far, and
  not much nearer to a centroid already taken than to the vector (``APART``).
* Centroids are searched through an in-memory graph (each one linked with its nearest
  ones, both ways, and with a few far ones) by best-first search.
* Of the lists found, a query probes those whose centroid's distance is at most a ratio
  times its base: the distance up to which the nearest lists hold k candidates beside the
  query itself (usually that of the nearest list; farther where the query lies on the
  centroid of a few vectors).  The ratio is the one that reaches ``RECALL`` of the nearest
  neighbours of ``TRIALS`` sample vectors within the sample: where vectors lie in tight
  clusters it prunes most lists, in isotropic noise few.
* A query that still has fewer than k results (repeated ids, small tables) is compared
  with every vector.

Lists of more than ``LIST_ROWS`` vectors (many equal vectors, which no clustering can
part) are dealt over several parts by id; queries go to all parts.  A list that more than
``QUERY_ROWS`` queries probe gets them in several parts as well, and its vectors go to each.
So no task gets an unbounded list.  Every part returns its ten nearest of each query, which
are merged.

The number of lists grows with the square root of the rows, so the centroids (and their
graph) stay small: 100 million vectors have 10,000, fitted on 640,000 in blocks.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the first one's.  Equal distances go to the smaller id.  A
repeated id keeps its nearest row, and a repeated query the nearest to any of its rows.
Without vectors the result is empty.  Only vec_id and embedding are read, so other columns
may have any name.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import map_batches, written

LISTS_PER_ROOT, SAMPLE_PER_LIST, ROUNDS = 1.0, 64, 8
REPLICAS, CLOSURE, APART = 4, 1.08, 0.25
LINKS, FAR, TRIALS, RECALL = 16, 4, 256, 0.98
#: Vectors of a list's part, and queries of a part, that meet in one task.
LIST_ROWS, QUERY_ROWS = 4096, 8192
#: Rows of a block of distances.
_BLOCK = 2048
SCHEMA = "query_id long, vec_id long, score double"


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded form; for choosing lists only."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2.0 * x @ c.T + (c * c).sum(1)[None, :])


def _nearest(x: np.ndarray, c: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The centroid of the smallest squared distance plus ``more``, block by block."""
    return np.concatenate([(_distances(x[a : a + _BLOCK], c) + more).argmin(axis=1) for a in range(0, len(x), _BLOCK)])


class Lists:
    """Centroids and their graph."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        distinct = np.unique(sample, axis=0)
        k = max(1, min(k, len(distinct)))
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        load = np.zeros(k)
        for _ in range(ROUNDS):
            # a fuller list counts as farther, so that the lists come out even
            typical = np.median(_distances(sample[:_BLOCK], c).min(axis=1)) + 1e-12
            near = _nearest(sample, c, typical * 0.3 * np.maximum(0, load - 1))
            n = np.bincount(near, minlength=k)
            load = n * k / max(1, len(sample))
            total = np.zeros_like(c)
            np.add.at(total, near, sample)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.c = c
        # the nearest centroids both ways, and a few far ones, so that no part is cut off
        links: list[set[int]] = [set(rng.integers(0, k, FAR).tolist()) for _ in range(k)]
        for a in range(0, k, _BLOCK):
            d = _distances(c[a : a + _BLOCK], c)
            for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, 1 : LINKS + 1].tolist(), a):
                links[i].update(row)
                for j in row:
                    links[j].add(i)
        self.links = [sorted(x - {i}) for i, x in enumerate(links)]
        self.start = int(_distances(c.mean(axis=0)[None], c)[0].argmin())
        self.entries = np.unique(np.concatenate([[self.start], rng.choice(k, min(k, max(8, math.isqrt(k))), replace=False)]))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every place a vector is kept in."""
        if len(x) > _BLOCK:
            parts = [(a, *self.assign(x[a : a + _BLOCK])) for a in range(0, len(x), _BLOCK)]
            return np.concatenate([r + a for a, r, _ in parts]), np.concatenate([p for _, _, p in parts])
        d = _distances(x, self.c)
        near = np.argpartition(d, min(2 * REPLICAS, d.shape[1]) - 1, axis=1)[:, : 2 * REPLICAS]
        rows, lists = [], []
        for i in range(len(x)):
            order = sorted(near[i].tolist(), key=lambda j: (d[i, j], j))
            taken = [order[0]]
            for j in order[1:]:
                if len(taken) == REPLICAS or d[i, j] > CLOSURE**2 * d[i, order[0]]:
                    break
                if all(((self.c[j] - self.c[t]) ** 2).sum() > APART * d[i, j] for t in taken):
                    taken.append(j)
            rows += [i] * len(taken)
            lists += taken
        return np.array(rows, dtype=np.int64), np.array(lists, dtype=np.int64)

    def calibrate(self, sample: np.ndarray, held: np.ndarray, k: int) -> None:
        """Take what the lists hold (each id in its first list only), and fit the ratio."""
        self.held, self.need = held.tolist(), k + 1
        self.ratio = self._ratio(sample, k)

    def _ratio(self, sample: np.ndarray, k: int) -> float:
        """How much farther than a query's base the centroids of its neighbours' lists are."""
        q = sample[:TRIALS]
        d = _distances(q, sample)
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        if not near.size:
            return 1.0
        to_list = np.sqrt(_distances(q, self.c))
        rows, lists = self.assign(sample[near.ravel()])
        seen = np.full(near.size, np.inf)
        np.minimum.at(seen, rows, to_list[rows // near.shape[1], lists])
        order = np.argsort(to_list, axis=1, kind="stable")
        enough = np.cumsum(np.array(self.held)[order], axis=1) >= self.need
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(self.c) - 1)
        base = np.repeat(to_list[np.arange(len(q)), order[np.arange(len(q)), last]], near.shape[1])
        return max(1.0, float(np.quantile(seen / np.maximum(base, 1e-12), RECALL)))

    def probes(self, q: np.ndarray) -> list[int]:
        """The lists within the ratio of the base, by best-first search in the graph."""
        seen = set(self.entries.tolist())
        d = np.sqrt(((self.c[self.entries] - q) ** 2).sum(axis=1))
        heap = list(zip(d.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        found: list[tuple[float, int]] = []
        first: list[tuple[float, int]] = []  # the nearest lists that together hold enough
        held, base, idle = 0, math.inf, 0

        def add(x: float, j: int) -> None:
            nonlocal held, base, idle
            found.append((x, j))
            if x >= base:
                return
            bisect.insort(first, (x, j))
            held += self.held[j]
            while held - self.held[first[-1][1]] >= self.need:
                held -= self.held[first.pop()[1]]
            if held >= self.need and first[-1][0] < base:
                base, idle = first[-1][0], 0

        for x, j in heap:
            add(x, j)
        while heap:
            a, i = heapq.heappop(heap)
            if a > self.ratio * base:
                idle += 1  # a few steps beyond the range, to cross gaps in the graph
                if idle > 2 * LINKS:
                    break
            new = [j for j in self.links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for x, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(axis=1)).tolist(), new, strict=True):
                heapq.heappush(heap, (x, j))
                add(x, j)
        return sorted(j for x, j in found if x <= self.ratio * base + 1e-12)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)
    return np.array(list(column), dtype=np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (of doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(fine & F.exists("embedding", lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that ``is_query`` accepts."""
    spark = vectors.sparkSession
    v = usable(vectors)
    n, size = v.agg(F.count(F.lit(1)), F.min_by(F.size("embedding"), "vec_id")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("embedding") == size)
    lists = max(1, round(LISTS_PER_ROOT * 4 * math.sqrt(n) / 4))
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_PER_LIST * lists).select("embedding").toArrow()
    sample = _matrix(rows.column("embedding").combine_chunks())
    model = Lists(sample, lists)
    index = spark.sparkContext.broadcast(model)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        at, to = index.value.assign(_matrix(b.column(1)))
        first = pa.array(np.diff(at, prepend=-1) > 0)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(to), first, b.column(1).take(pa.array(at))], ["vec_id", "list", "first", "embedding"])

    def probe(b: pa.RecordBatch) -> pa.RecordBatch:
        to = [ready.value.probes(q) for q in _matrix(b.column(1))]
        at = [i for i, x in enumerate(to) for _ in x]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([j for x in to for j in x], pa.int64())], ["query_id", "list"])

    posts = written(map_batches(v, place, "vec_id long, list long, first boolean, embedding array<double>"))
    held = F.count_distinct(F.when(F.col("first"), F.col("vec_id"))).alias("held")
    parts = posts.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"), held)
    parts = written(parts)
    counts = np.zeros(len(model.c), dtype=np.int64)
    for r in parts.select("list", "held").collect():  # a row a list
        counts[r.list] = r.held
    model.calibrate(sample, counts, k)
    ready = spark.sparkContext.broadcast(model)
    posts = posts.join(parts, "list").select("vec_id", "list", "first", "embedding", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    asked = v.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = written(map_batches(v.where(is_query), probe, "query_id long, list long").distinct())
    many = parts.select(F.col("list").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["vec_id"].to_numpy(), _matrix(right["embedding"])
            for query, q in zip(left["query_id"], _matrix(left["q"]), strict=True):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                d = np.where(ids == query, np.inf, d)
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out += [(query, i, s) for i, s in zip(ids[near].tolist(), d[near].tolist(), strict=True) if s < np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def best(pairs: DataFrame, posts: DataFrame) -> DataFrame:
        """query_id, top: its k nearest among the posts of its lists' parts.

        A list that many queries probe gets them in several parts, and its posts go to each.
        """
        shares = pairs.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("shares"))  # a row a list
        dealt = pairs.join(shares, "list").withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")).drop("shares")
        dealt = dealt.join(many, F.col("list") == F.col("to")).drop("to").join(asked, "query_id")
        spread = posts.join(shares, "list").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        keys = ["list", "part", "share"]
        found = dealt.select("query_id", "q", *keys).groupBy(*keys).cogroup(spread.select("vec_id", "embedding", *keys).groupBy(*keys)).applyInPandas(nearest, SCHEMA)
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        # at most k rows for each of a query's probes meet here
        return one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))

    posts = posts.select("vec_id", "list", "part", "first", "embedding")
    top = written(best(pairs, posts))
    full = top.where(F.size("top") == k)
    short = asked.select("query_id").distinct().join(full, "query_id", "left_anti")
    if not short.isEmpty():
        # a stated set of queries against all rows, list by list
        everywhere = short.crossJoin(parts.select("list"))
        top = full.unionAll(best(everywhere, posts.where("first")))
    return top.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
