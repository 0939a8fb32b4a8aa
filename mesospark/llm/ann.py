"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced clustering of a bounded sample. A graph over
them is held in memory by each task and searched best-first. Vectors near a
boundary are replicated to several lists; a query's lists are those whose
centroid is within a ratio of the nearest centroid's distance, and a few nearest
ones in any case; a query that finds too few neighbours is asked of all lists. Lists over a
size limit are split by a hash of the id, so that no task gets an unbounded
list whatever the vectors are. Candidates are scored exactly in double
precision.

Defined cases: vectors that are null, empty or zero, hold null or non-finite
components, or differ in length from most take no part, nor do null ids;
equal scores are ranked by the smaller id; repeated rows of one id are one
candidate; other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.llm.features import bounded_share, fitted, share_of
from mesospark.plans.lineage import cut


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v array<double>`` of the vectors that can be compared."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), v.alias("v")).filter(
        F.col("v").isNotNull()
        & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    most = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.filter(F.size("v") == (most[0] if most else 0)).dropDuplicates(["id"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balanced_centroids(x: np.ndarray, lists: int, passes: int = 12, weight: float = 0.05, seed: int = 1) -> np.ndarray:
    """Unit centroids; a list's size over the mean is charged against its similarity."""
    rng = np.random.RandomState(seed)
    distinct = np.unique(x, axis=0)  # copies would make equal centroids
    c = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)].copy()
    charge = np.zeros(len(c), np.float32)
    for _ in range(passes):
        at = np.concatenate([(x[a : a + 4096] @ c.T - charge).argmax(1) for a in range(0, len(x), 4096)])
        size = np.bincount(at, minlength=len(c))
        charge = 0.5 * charge + weight * np.clip(size / max(1.0, len(x) / len(c)) - 1, 0, 4).astype(np.float32)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        empty = size == 0
        total[empty] = distinct[rng.randint(0, len(distinct), int(empty.sum()))]
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


@dataclass
class CentroidGraph:
    """Centroids with links to their nearest and to a few far ones; searched best-first for many vectors at once."""

    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, c: np.ndarray, near: int = 24, far: int = 8) -> "CentroidGraph":
        similarity = c @ c.T
        np.fill_diagonal(similarity, -2)
        order = np.argsort(-similarity, 1)[:, : min(near, max(1, len(c) - 1))]
        return cls(c, np.concatenate([order, np.random.RandomState(2).randint(0, len(c), (len(c), far))], 1))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row, nearest first, and their similarities."""
        n, m = len(x), len(self.centroids)
        width = min(width, m)
        entries = np.unique(np.linspace(0, m - 1, min(m, max(width, 32))).astype(int))
        scores, seen, opened = np.full((n, m), -2, np.float32), np.zeros((n, m), bool), np.zeros((n, m), bool)
        scores[:, entries], seen[:, entries] = x @ self.centroids[entries].T, True
        live = np.arange(n)
        while len(live):
            top = np.argpartition(-scores[live], width - 1, 1)[:, :width]
            waiting = seen[live[:, None], top] & ~opened[live[:, None], top]
            value = np.where(waiting, scores[live[:, None], top], -3)
            pick = value.argmax(1)
            go = value[np.arange(len(live)), pick] > -3
            live, node = live[go], top[np.arange(len(top)), pick][go]
            if not len(live):
                break
            opened[live, node] = True
            near = self.links[node]
            scores[live[:, None], near] = np.einsum("nd,nkd->nk", x[live], self.centroids[near])
            seen[live[:, None], near] = True
        order = np.argsort(-scores, 1, kind="stable")[:, :width]
        return order, np.take_along_axis(scores, order, 1)


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * similarity, 1e-12))


def posting_lists(x: np.ndarray, graph: CentroidGraph, replicas: int, ratio: float) -> list[list[int]]:
    """Lists of each vector: the nearest, and others nearly as near whose centroid is not nearer to a chosen one than to the vector."""
    order, s = graph.search(x, max(2 * replicas, 8))
    d, out = _distance(s), []
    between = _distance(np.clip(graph.centroids @ graph.centroids.T, -1, 1))
    for row, dist in zip(order, d, strict=True):
        kept: list[int] = []
        for c, far in zip(row, dist, strict=True):
            if len(kept) == replicas or far > ratio * dist[0]:
                break
            if all(between[c, k] > 0.7 * far for k in kept):
                kept.append(int(c))
        out.append(kept)
    return out


def query_lists(x: np.ndarray, graph: CentroidGraph, probes: int, ratio: float, least: int) -> list[list[int]]:
    """The lists within the ratio of the nearest centroid's distance, and the ``least`` nearest in any case."""
    order, s = graph.search(x, probes)
    near = _distance(s) <= ratio * _distance(s)[:, :1]
    near[:, :least] = True
    return [row[go].tolist() for row, go in zip(order, near, strict=True)]


def fit_graph(vectors: DataFrame, *, sample: int = 40_000, per_list: int = 256, max_lists: int = 4096) -> CentroidGraph | None:
    """Fit in one task on at most ``sample`` vectors, drawn by a hash of the id."""
    total = vectors.count()
    drawn = vectors.filter(share_of("id", 0) < bounded_share(sample, total)).select("id", "v")
    lists = int(np.clip(round(total / per_list), 1, max_lists))

    def fit(table):
        if not len(table):
            return None
        x = np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(table), -1)
        return balanced_centroids(unit(x).astype(np.float32), lists)

    centroids = fitted(drawn, fit) if total else None
    return None if centroids is None else CentroidGraph.of(centroids)


def _scored(asked: DataFrame, posted: DataFrame, k: int, kind: str) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each query in each part of each list; both ``id, v, list, part``."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"score": float})
        right = right.sort_values("id", ignore_index=True)
        x, q = np.stack(right["v"]), np.stack(left["v"])
        lx, lq, ids, out = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1)), right["id"].to_numpy(), []
        for i, own in enumerate(left["id"].to_numpy()):
            # sums by row: a matrix product may round equal vectors differently by their place
            s = np.where(ids == own, -np.inf, (x * q[i]).sum(1) / (lx * lq[i]))
            top = np.argsort(-s, kind="stable")[:k]  # by the smaller id among equals
            top = top[s[top] > -np.inf]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[top], "score": s[top]}))
        return pd.concat(out)

    found = asked.groupBy("list", "part").cogroup(posted.groupBy("list", "part")).applyInPandas(score, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, replicas: int = 4, replica_ratio: float = 1.15, probes: int | None = None, probe_ratio: float = 1.5, least_probes: int = 8, list_limit: int = 2000, graph: CentroidGraph | None = None) -> DataFrame:
    """``query_id, rank int, vec_id, score double`` of the k nearest of ``vectors`` for each of ``queries`` (both ``id, v``, both cut).

    At most ``probes`` lists are read for a query, by default an eighth of them and
    at least 64, so that recall holds as lists become many. A query that finds fewer
    than k in its lists is asked of all lists.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    graph = graph or fit_graph(vectors)
    if graph is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    held = spark.sparkContext.broadcast(graph)
    probes = probes or max(64, len(graph.centroids) // 8)

    def listed(lists_of):
        def run(frames):
            for f in frames:
                if len(f):
                    x = unit(np.stack(f["v"])).astype(np.float32)
                    for a in range(0, len(f), 512):
                        yield f.iloc[a : a + 512].assign(list=lists_of(x[a : a + 512], held.value))
        return run

    schema = f"id {kind}, v array<double>, list array<int>"
    posted = vectors.mapInPandas(listed(lambda x, g: posting_lists(x, g, replicas, replica_ratio)), schema).select("id", "v", F.explode("list").alias("list"))
    posted = cut(posted)
    asked = cut(queries.mapInPandas(listed(lambda x, g: query_lists(x, g, probes, probe_ratio, least_probes)), schema).select("id", "v", F.explode("list").alias("list")))
    held.destroy()
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))  # one row a list, of a bounded number
    splits = cut(sizes.select("list", F.ceil(F.col("n") / list_limit).cast("int").alias("splits")))
    pieces = splits.select(F.col("list").alias("l"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("piece"))
    split = posted.join(F.broadcast(splits), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("part"))

    def ask(wanted: DataFrame, which) -> DataFrame:
        sent = wanted.join(F.broadcast(pieces), which).select("id", "v", F.col("l").alias("list"), F.col("piece").alias("part"))
        return _scored(sent, split, k, kind)

    found = cut(ask(asked, F.col("list") == F.col("l")))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = cut(queries.join(full, "id", "left_anti"))
    if short.isEmpty():
        return found
    again = ask(short, F.lit(True))  # a few queries, each to every piece of every list
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").union(again)
