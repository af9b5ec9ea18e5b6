"""Approximate nearest neighbours over robust-pruned directed graphs, one a shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Most edges of a node, width of the search that proposes them, and how much longer a detour an edge may replace.
DEGREE, BUILD_BEAM, RELAX = 32, 96, 1.2
#: Width of the search for a query, nodes opened at a time, nodes added or queries searched at a time.
BEAM, OPENED, BATCH = 256, 4, 256
#: Least number of shards, about the most vectors of one, most ranges of lengths, most queries that meet a shard in one task.
SHARDS, SHARD_ROWS, RANGES, QUERY_ROWS = 8, 8_192, 64, 65_536
K, EVERY = 20, 20


class Graph:
    """Directed graph over vectors, searched from a central node.

    Nodes are added in batches: a greedy search of the graph so far proposes neighbours, of which relaxed
    distance pruning keeps the near and diverse ones; the edges back are pruned likewise. Every node can be
    reached from the central one.

    For searches by inner product the graph is built over directions (see by_inner_product): queries then come from where the nodes
    are, which they do not if a further component evens the lengths out.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
        self.x, self.degree, self.relax = np.ascontiguousarray(x, np.float32), degree, relax
        n = len(x)
        self.norm = (self.x * self.x).sum(1)
        self.edges = np.full((n, degree), -1, np.int32)
        self.center = int(self._to(self.x.mean(0), np.arange(n)).argmin()) if n else 0
        order = np.random.default_rng(5).permutation(n)
        order = np.r_[self.center, order[order != self.center]] if n else order
        at = 1
        while at < n:
            self._add(order[at : at + min(at, BATCH)], beam)
            at += min(at, BATCH)
        if n:
            self._attach()

    @classmethod
    def by_inner_product(cls, x: np.ndarray) -> Graph:
        """The graph over the directions of ``x`` (no zero vectors), searched by the inner product with ``x`` itself."""
        return cls(x / np.sqrt((x * x).sum(1, keepdims=True)))._turned(x)

    @classmethod
    def read(cls, x: np.ndarray, edges: np.ndarray, center: int) -> Graph:
        """A graph made by by_inner_product, from its parts."""
        graph = cls(x[:0])
        graph.edges, graph.center = edges, center
        return graph._turned(x)

    def _turned(self, x: np.ndarray) -> Graph:
        """Without norms what is minimised is -2 q . x."""
        self.x, self.norm = np.ascontiguousarray(x, np.float32), np.zeros(len(x), np.float32)
        return self

    def _to(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.norm[nodes] - 2 * (self.x[nodes] @ q)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to ``beam`` nodes (-1: none) and their squared distances less the query's norm, nearest first."""
        q = np.ascontiguousarray(queries, np.float32)
        b, n, rows = len(q), len(self.x), np.arange(len(q))[:, None]
        found = np.full((b, beam), -1, np.int64)
        off = np.full((b, beam), np.inf, np.float32)
        opened = np.ones((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)
        found[:, 0], off[:, 0], opened[:, 0], seen[:, self.center] = self.center, self._to(q.T, np.array([self.center]))[0], False, True
        seen[:, n] = True
        live = np.arange(b)
        while len(live):
            r = rows[: len(live)]
            nearest = np.argsort(np.where(opened[live], np.inf, off[live]), 1, kind="stable")[:, :OPENED]
            fresh = ~opened[live][r, nearest]
            opened[live[:, None], nearest] = True
            next_ = self.edges[found[live][r, nearest]].astype(np.int64)
            next_[~fresh] = -1
            next_ = next_.reshape(len(live), -1)
            next_ = np.where(next_ < 0, n, next_)
            next_ = np.sort(next_, 1)
            again = np.zeros(next_.shape, bool)
            again[:, 1:] = next_[:, 1:] == next_[:, :-1]
            again |= seen[live[:, None], next_]
            seen[live[:, None], next_] = True
            i, j = np.nonzero(~again)
            d = np.full(next_.shape, np.inf, np.float32)
            new = next_[i, j]
            d[i, j] = self.norm[new] - 2 * np.einsum("ij,ij->i", self.x[new], q[live[i]])
            every = np.concatenate([off[live], d], 1)
            best = np.argpartition(every, beam - 1, 1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(every, best, 1), 1, kind="stable"), 1)
            off[live] = np.take_along_axis(every, best, 1)
            found[live] = np.take_along_axis(np.concatenate([found[live], np.where(again, -1, next_)], 1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], again], 1), best, 1) | np.isinf(off[live])
            live = live[~opened[live].all(1)]
        found[np.isinf(off)] = -1
        return found, off

    def _prune(self, nodes: np.ndarray, options: np.ndarray) -> np.ndarray:
        """Of each row's ``options`` (-1: none) the edges to keep: the nearest, without those that a kept one is nearer to by RELAX."""
        options = np.sort(options, 1)
        options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
        options[options == nodes[:, None]] = -1
        x = self.x[np.maximum(options, 0)]
        norm = self.norm[np.maximum(options, 0)]
        apart = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        away = norm + self.norm[nodes][:, None] - 2 * np.einsum("ijk,ik->ij", x, self.x[nodes])
        left = np.where(options < 0, np.inf, np.maximum(away, 0))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows, factor = np.arange(len(nodes)), self.relax**2
        for k in range(self.degree):
            pick = left.argmin(1)
            ok = np.isfinite(left[rows, pick])
            if not ok.any():
                break
            out[:, k] = np.where(ok, options[rows, pick], -1)
            left[rows, pick] = np.inf
            left[factor * apart[rows, pick] <= np.maximum(away, 0)] = np.inf
        return out

    def _add(self, nodes: np.ndarray, beam: int) -> None:
        near, _ = self.search(self.x[nodes], beam)
        self.edges[nodes] = self._prune(nodes, np.concatenate([near, self.edges[nodes]], 1))
        target = self.edges[nodes].ravel()
        source = np.repeat(nodes, self.degree)[target >= 0]
        target = target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        uniq, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        # targets with few new edges together, those with many in small groups
        for low, high in ((0, 8), (8, 32), (32, len(nodes) + 1)):
            group = np.flatnonzero((count > low) & (count <= high))
            for at in range(0, len(group), max(1, 65_536 // (high + self.degree))):
                g = group[at : at + max(1, 65_536 // (high + self.degree))]
                back = np.full((len(g), count[g].max()), -1, np.int64)
                where = np.full(len(uniq), -1)
                where[g] = np.arange(len(g))
                row = where[np.repeat(np.arange(len(uniq)), count)]
                back[row[row >= 0], place[row >= 0]] = source[row >= 0]
                self.edges[uniq[g]] = self._prune(uniq[g], np.concatenate([self.edges[uniq[g]].astype(np.int64), back], 1))

    def _attach(self) -> None:
        """Gives each node that no path reaches an edge from the nearest node that one does."""
        n = len(self.x)
        while True:
            reached, frontier = np.zeros(n, bool), np.array([self.center])
            while len(frontier):
                reached[frontier] = True
                frontier = np.unique(self.edges[frontier])
                frontier = frontier[frontier >= 0]
                frontier = frontier[~reached[frontier]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            self.edges = np.c_[self.edges, np.full(n, -1, np.int32)]
            near, _ = self.search(self.x[lost[:BATCH]], 8)
            for node, options in zip(lost, near, strict=False):
                free = options[(options >= 0) & (self.edges[options, -1] < 0)]
                if len(free):
                    self.edges[free[0], -1] = node


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0))


def _sharded(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes`` (v, norm, ids) with ``shard``, and the number of shards.

    Vectors of about the same length share a shard, RANGES ranges of lengths at most, and a range is dealt over as
    many shards as it needs by a hash. Where lengths within a shard hardly differ, so do the orders by inner product and by distance.
    """
    n = nodes.count()
    wanted = max(SHARDS, math.ceil(n / SHARD_ROWS))
    cuts = nodes.agg(F.percentile_approx("norm", [k / min(wanted, RANGES) for k in range(1, min(wanted, RANGES))], 10_000)).first()[0] or []
    # lengths that differ by rounding alone are one
    edges: list[float] = []
    for c in cuts:
        if not edges or c > edges[-1] * (1 + 1e-6):
            edges.append(c)
    band = F.size(F.filter(F.array(*[F.lit(c * (1 + 1e-7)) for c in edges]), lambda c: c < F.col("norm"))) if edges else F.lit(0)
    nodes = nodes.withColumn("band", band)
    count = {r["band"]: r["count"] for r in nodes.groupBy("band").count().collect()}
    parts = [max(1, math.ceil(count.get(b, 0) / SHARD_ROWS), round(SHARDS * count.get(b, 0) / max(n, 1))) for b in range(len(edges) + 1)]
    first = [sum(parts[:b]) for b in range(len(parts))]
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("band") + 1)
    return nodes.withColumn("shard", (at(first) + F.pmod(F.xxhash64("v"), at(parts))).cast("int")).drop("band"), sum(parts)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` vectors found of the largest inner product.

    The own id of a query is no candidate; ties go to the smaller id; score is the inner product of the
    original vectors in double precision. Vectors that are null, zero or hold null or non-finite
    components take no part on either side, nor do rows without an id and vectors of another length than most (the shortest
    of equally frequent lengths). An id with several vectors is as near as its nearest one: as a candidate it comes once, as a query
    it has one list, of what is nearest to any of its vectors.

    Equal vectors are one node with its k + 1 smallest ids, which no further copy can precede, so a vector that a
    third of the rows share costs one node. Nodes are dealt over shards by length and hash (see _sharded); each shard's graph is
    built once and written to the checkpoint folder; queries meet each shard in blocks.
    """
    rows = _valid(vectors, id_col, vector_col).withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = lengths["d"] if lengths else 0
    rows = rows.where(F.size("v") == dim).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = cut(nodes.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    sharded, shards = _sharded(nodes)
    asked = _valid(queries, id_col, vector_col).where(F.size("v") == dim)
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy()).astype(np.float64)
        graph = Graph.by_inner_product(x)
        ids = frame["ids"].to_numpy()
        size = np.array([len(i) for i in ids], np.int32)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "x": [x.tobytes()], "edges": [graph.edges.tobytes()], "center": [graph.center], "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "size": [size.tobytes()]})

    graphs = cut(sharded.groupBy("shard").applyInPandas(build, "shard int, x binary, edges binary, center int, ids binary, size binary"))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return none
        g = left.iloc[0]
        x = np.frombuffer(g["x"], np.float64).reshape(-1, dim)
        size, ids = np.frombuffer(g["size"], np.int32), np.frombuffer(g["ids"], np.int64)
        first = np.cumsum(size) - size
        graph = Graph.read(x, np.frombuffer(g["edges"], np.int32).reshape(len(x), -1), int(g["center"]))
        out: list[pd.DataFrame] = []
        for at in range(0, len(right), BATCH):
            part = right.iloc[at : at + BATCH]
            q, own = np.stack(part["v"].to_numpy()).astype(np.float64), part["id"].to_numpy()
            found, _ = graph.search(q, min(beam, max(len(x), 1)))
            i, j = np.nonzero(found >= 0)
            node = found[i, j]
            score = np.einsum("ij,ij->i", x[node], q[i])
            n = size[node]
            i, score = np.repeat(i, n), np.repeat(score, n)
            vec = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n)]
            other = vec != own[i]
            i, score, vec = i[other], score[other], vec[other]
            order = np.lexsort((vec, -score, i))
            i, score, vec = i[order], score[order], vec[order]
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(head, np.diff(np.r_[head, len(i)])) < k
            out.append(pd.DataFrame({"query_id": own[i[keep]], "vec_id": vec[keep], "score": score[keep]}))
        return pd.concat(out) if out else none

    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = asked.distinct().select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).select("*", every.alias("shard"))
    graphs = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(look, "query_id long, vec_id long, score double")
    best = pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
