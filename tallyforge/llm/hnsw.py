"""Approximate nearest neighbours: a navigable small-world graph for each shard, shard results merged.

Equal vectors are one node, whatever their number, so copies neither crowd a graph nor cut it into islands. Nodes are
dealt to shards, bounded in rows and in bytes, by a hash; each shard's graph is built by inserting nodes in growing
blocks, whose candidates are the nearest of all nodes inserted before (a matrix product, which a shard's bound allows),
and is stored as flat arrays: the levels' nodes and, for each, a fixed number of neighbour places. Queries walk the graph
of every shard in blocks, and each query's best of all shards are re-scored exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, stash

#: Neighbours of a node (twice that on the ground level), candidates for them, and breadth of the search when asking.
M, BUILD, ASK = 16, 64, 160
#: Nodes and bytes of single-precision vectors of a shard at most (about), and shards at least, so that small tables
#: still use several tasks.
SHARD_ROWS, SHARD_BYTES, MIN_SHARDS = 16_384, 64 << 20, 6
#: Queries that walk a graph in step, and candidates that each opens at once.
BLOCK, OPEN = 256, 4


class Graph:
    """Layers of neighbour arrays over unit vectors; layer 0 holds all nodes, each layer above about 1 in M of them."""

    def __init__(self, vectors: np.ndarray, top: np.ndarray | None = None):
        self.vectors = vectors
        n = len(vectors)
        if top is None:  # a node's highest layer comes from its number, so that builds repeat
            u = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2.0**53
            top = np.minimum(np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(M)), 8).astype(np.int64)
        self.top = top
        if n:
            self.top[0] = self.top.max()
        self.layers = [np.full((n, 2 * M if level == 0 else M), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        g = cls(vectors)
        done, n = 1, len(vectors)
        while done < n:
            block = np.arange(done, min(n, done + max(1, min(BLOCK, done // 4))))
            g._insert(block)
            done = block[-1] + 1
        return g

    def search(self, queries: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of about the k nearest of each query, nearest first; -1 where there are fewer."""
        q = len(queries)
        if not len(self.vectors):
            return np.full((q, k), -1), np.full((q, k), -np.inf)
        at = np.zeros((q, 1), np.int64)
        for level in range(len(self.layers) - 1, 0, -1):
            at = self._walk(queries, at, level, 4, len(self.vectors))[0][:, :1]
        nodes, scores = self._walk(queries, at, 0, max(breadth, k), len(self.vectors))
        return nodes[:, :k], scores[:, :k]

    def _walk(self, queries: np.ndarray, start: np.ndarray, level: int, breadth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer from the start nodes, for all queries in step."""
        q, links = len(queries), self.layers[level]
        beam = np.full((q, breadth), -1, np.int64)
        score = np.full((q, breadth), -np.inf)
        opened = np.ones((q, breadth), bool)
        seen = np.zeros((q, size + 1), bool)
        seen[:, size] = True  # the place that -1 stands for
        w = min(start.shape[1], breadth)
        beam[:, :w] = start[:, :w]
        score[:, :w] = np.where(start[:, :w] >= 0, np.einsum("qd,qwd->qw", queries, self.vectors[start[:, :w]]), -np.inf)
        opened[:, :w] = start[:, :w] < 0
        seen[np.arange(q)[:, None], start[:, :w]] = True
        live = np.arange(q)
        while len(live):
            todo = np.where(opened[live], -np.inf, score[live])
            pick = np.argsort(-todo, axis=1, kind="stable")[:, :OPEN]
            good = np.take_along_axis(todo, pick, 1) > -np.inf
            some = good[:, 0]
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            rows = live[:, None]
            opened[rows, pick] = True
            near = np.where(good[:, :, None], links[np.where(good, beam[rows, pick], 0)], -1).reshape(len(live), -1).astype(np.int64)
            new = ~seen[rows, near]
            near = np.where(new, near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[rows, near] = True
            near = -np.sort(-near, axis=1)
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            s = np.where(near >= 0, (self.vectors[near] @ queries[live][:, :, None])[:, :, 0], -np.inf)
            nodes, values = np.concatenate((beam[live], near), 1), np.concatenate((score[live], s), 1)
            marks = np.concatenate((opened[live], near < 0), 1)
            keep = np.argsort(-values, axis=1, kind="stable")[:, :breadth]
            beam[live], score[live], opened[live] = (np.take_along_axis(x, keep, 1) for x in (nodes, values, marks))
        return beam, score

    def _insert(self, block: np.ndarray) -> None:
        """Link a block of new nodes: each to near nodes of those inserted before and of its own block that lie apart
        from one another, and those back to it."""
        for level in range(len(self.layers)):
            b = block[self.top[block] >= level]
            if not len(b):
                break
            here = np.flatnonzero(self.top[: block[-1] + 1] >= level)  # in order, so that b are the last
            scores = self.vectors[b] @ self.vectors[here].T
            scores[np.arange(len(b)), len(here) - len(b) + np.arange(len(b))] = -np.inf
            most = min(BUILD, len(here))
            near = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            scores = np.take_along_axis(scores, near, 1)
            self._link(b, np.where(scores > -np.inf, here[near], -1), scores, level)

    def _apart(self, base: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates, nearest first: a candidate nearer to one already taken than to the
        row's own node comes after the others."""
        step = max(1, (1 << 20) // max(1, cand.shape[1] ** 2))
        if len(cand) > step:  # the candidates' cosines with one another are held for some rows at a time
            return np.concatenate([self._apart(base[i : i + step], cand[i : i + step], score[i : i + step], most) for i in range(0, len(cand), step)])
        order = np.argsort(-score, axis=1, kind="stable")
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        v = self.vectors[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        r, c = cand.shape
        taken = np.zeros((r, c), bool)
        shadow = np.full((r, c), -np.inf)
        count = np.zeros(r, np.int64)
        for j in range(c):
            ok = (cand[:, j] >= 0) & (shadow[:, j] <= score[:, j]) & (count < most)
            taken[:, j] = ok
            count += ok
            shadow = np.where(ok[:, None], np.maximum(shadow, between[:, j]), shadow)
        rank = np.argsort(np.where(cand < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, rank, 1)

    def _link(self, block: np.ndarray, cand: np.ndarray, score: np.ndarray, level: int) -> None:
        links = self.layers[level]
        chosen = self._apart(block, cand, score, M)
        links[block, : chosen.shape[1]] = chosen
        src, dst = np.repeat(block, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, n = np.unique(dst, return_index=True, return_counts=True)
        new = np.full((len(nodes), n.max(initial=0)), -1, np.int64)
        new[np.repeat(np.arange(len(nodes)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
        cand = np.concatenate((links[nodes].astype(np.int64), new), 1)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        width, most = links.shape[1], int((cand >= 0).sum(1).max(initial=0))
        cand = -np.sort(-cand, axis=1)[:, : max(most, 1)]
        full = (cand >= 0).sum(1) > width
        fits = cand[~full][:, :width]
        links[nodes[~full], : fits.shape[1]] = fits
        if full.any():
            base, c = nodes[full], cand[full]
            s = np.where(c >= 0, (self.vectors[np.maximum(c, 0)] @ self.vectors[base][:, :, None])[:, :, 0], -np.inf)
            links[base] = self._apart(base, c, s, width)

    def flat(self) -> tuple[bytes, bytes, bytes]:
        """(vectors, top layers, neighbour arrays of all layers one after another), without nodes below a layer."""
        upper = [layer[self.top >= level] for level, layer in enumerate(self.layers)]
        return self.vectors.astype(np.float32).tobytes(), self.top.astype(np.int8).tobytes(), b"".join(x.tobytes() for x in upper)

    @classmethod
    def read(cls, dims: int, vectors: bytes, top: bytes, links: bytes) -> Graph:
        g = cls(np.frombuffer(vectors, np.float32).reshape(-1, dims), np.frombuffer(top, np.int8).astype(np.int64))
        flat, at = np.frombuffer(links, np.int32), 0
        for level, layer in enumerate(g.layers):
            here = np.flatnonzero(g.top >= level)
            layer[here] = flat[at : at + len(here) * layer.shape[1]].reshape(len(here), -1)
            at += len(here) * layer.shape[1]
        return g


def scaled(v: Column) -> Column:
    """An array of double over the power of two at or below its largest component: its cosines stay the same to the last
    bit, and no product of components overflows or vanishes."""
    largest = F.array_max(F.transform(v, F.abs))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(largest)).cast("double"))
    return F.get(F.transform(F.array(unit), lambda u: F.transform(v, lambda x: x / u)), 0)


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v: the vector scaled) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", scaled(F.col("v")).alias("v"))


def vector_classes(usable: DataFrame, copies: int) -> DataFrame:
    """(vec_id, v, ids): a row for each distinct vector, its least vec_id, and its `copies` least ids, each as often as
    its rows come, up to `copies` times. Copies are combined map-side."""
    # A class's least ids, in two steps: by (vector, slice of ids), then by vector, so that no task sorts all copies.
    sliced = usable.groupBy("v", "vec_id").count().withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(4096)))
    some = sliced.groupBy("v", "_s").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "count"))), 1, copies).alias("i"))
    least = some.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("i"))), 1, copies).alias("i"))
    ids = F.flatten(F.transform("i", lambda x: F.array_repeat(x["vec_id"], F.least(x["count"], F.lit(copies)).cast("int"))))
    return least.select(F.col("i")[0]["vec_id"].alias("vec_id"), "v", ids.alias("ids"))


def shard_count(rows: int, dims: int) -> int:
    """Shards for so many vectors of at most so many components."""
    most = max(256, min(SHARD_ROWS, SHARD_BYTES // (4 * max(1, dims))))
    return max(MIN_SHARDS, -(-rows // most))


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, dims, vectors, top, links): a graph for each shard, as flat arrays.

    Vectors of another number of components than a graph's make a graph of their own.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        x = np.array(pdf["v"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        vectors, top, links = Graph.build(x.astype(np.float32)).flat()
        return pd.DataFrame({"shard": [key[0]], "dims": [key[1]], "ids": [pdf["vec_id"].to_numpy().tobytes()], "vectors": [vectors], "top": [top], "links": [links]})

    dealt = classes.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard", "dims").applyInPandas(build, "shard int, dims int, ids binary, vectors binary, top binary, links binary")


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """(query, found): for each query and shard about its k nearest nodes, by their vec_id. queries: query (a long of
    its own), q.

    Each shard's graph goes to one partition, and after it the queries in Arrow batches, so a task holds one graph and
    one batch.
    """
    asked = queries.select("query", "q", F.size("q").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    none = lambda kind: F.lit(None).cast(kind)
    both = index.select("shard", "dims", F.lit(0).alias("kind"), "ids", "vectors", "top", "links", none("long").alias("query"), none("array<double>").alias("q"))
    both = both.union(asked.select("shard", "dims", F.lit(1), none("binary"), none("binary"), none("binary"), none("binary"), "query", "q"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = key = None
        for b in batches:
            kinds, keys = b.column("kind").to_numpy(), np.stack([b.column("shard").to_numpy(), b.column("dims").to_numpy()], 1)
            turns = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(kinds) else []
            for at, end in zip(turns, [*turns[1:], len(kinds)], strict=True):
                if kinds[at] == 0:
                    key = tuple(keys[at])
                    row = {c: b.column(c)[at].as_py() for c in ("dims", "ids", "vectors", "top", "links")}
                    graph, ids = Graph.read(row["dims"], row["vectors"], row["top"], row["links"]), np.frombuffer(row["ids"], np.int64)
                    at += 1
                if tuple(keys[end - 1]) != key:  # no node of this shard has vectors of this length
                    continue
                for i in range(at, end, BLOCK):
                    j = min(end, i + BLOCK)
                    x = np.array(b.column("q").slice(i, j - i).to_pylist(), float)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    nodes, _ = graph.search(x.astype(np.float32), k, ASK)
                    found = [ids[row[row >= 0]].tolist() for row in nodes]
                    yield pa.record_batch([b.column("query").slice(i, j - i), pa.array(found, pa.list_(pa.int64()))], ["query", "found"])

    return both.repartition(F.col("shard"), F.col("dims")).sortWithinPartitions("shard", "dims", "kind").mapInArrow(walk, "query long, found array<long>")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of double of one length, summed in order."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where `queries` holds, itself left out.

    Nearest first by cosine of the original vectors in double precision, ties to the smaller vec_id; components of any
    finite size are fine. Rows whose vector is null, empty, zero or holds a null or non-finite component, or whose
    vec_id is null, take no part; vectors meet those of the same number of components. A row that is repeated is as many
    candidates; rows of a query's own vec_id are never its candidates. A vec_id that comes with several vectors is a
    query by each of them, and one that is repeated whole a query once. Other columns are not read. An empty table gives
    an empty one.
    """
    small_batches(rows.sparkSession)
    classes = stash(vector_classes(usable_vectors(rows, vec_id, vector), k + 1), "classes")
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = shard_count(n, dims or 1)
    index = stash(build_index(classes, shards), "index")
    asked = usable_vectors(rows.where(F.coalesce(queries, F.lit(False))), vec_id, vector)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = stash(asked.withColumn("query", F.xxhash64("query_id", "q")), "asked")
    found = search_index(index, asked, shards, k + 1)
    pairs = found.select(F.col("query").alias("_f"), F.explode("found").alias("node"))
    scored = pairs.join(asked, F.col("_f") == F.col("query")).join(classes, F.col("node") == F.col("vec_id")).where(F.size("q") == F.size("v"))
    scored = scored.select("query_id", "query", cosine(F.col("q"), F.col("v")).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: Brute force in the same measure. On small tables a shard's search reaches all its nodes, so the results are equal.
OP8_SQL = """
WITH v AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, t: s + t)) AS n
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda s, t: s + t) / (q.n * c.n) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
