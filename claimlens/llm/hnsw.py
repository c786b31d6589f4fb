"""Approximate nearest neighbours (10): one hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards by their hash. A shard's graph has layers drawn from
a geometric law (by the hash of the vector, so the graph is the same in every
run); on each layer a node is linked to diverse near neighbours (a candidate is
taken if it is nearer to the node than to any neighbour taken before) and back.
Links are flat arrays: for each layer one int32 array [nodes, degree], -1 where
unused. Candidates come from exact blockwise products within the shard, whose
size is bounded, in place of searching the graph under construction. A search
descends greedily through the upper layers and keeps a beam on the lowest one;
all queries of a block move in step, as array operations. Every shard answers
every query and the best of all shards stay.

The measure is the inner product. Vectors of different lengths get one more
coordinate that brings all of a shard to the same length, which makes the
largest inner product the nearest neighbour; scores are then recomputed in
double precision on the original vectors.

Equal vectors are one node, which holds as many of their smallest ids as a
result list can use (k + 1), so ties resolve to the smaller id; the candidates
of a common vector are bounded before the shuffle by a ranking limit.

Every row is indexed; no sample is used. Recall against brute force is measured
in the tests (0.9 or more is asked for).

Defined results: vectors that are null, zero or hold null or non-finite
components take no part; vectors of another dimension than most queries' never
meet them; rows with a null id take no part; repeated rows (same id and vector)
count once; fewer candidates than k give all; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.stage import staged

DEGREE = 24       # links of a node on the upper layers; twice as many on the lowest
BEAM = 64
SHARD_ROWS = 8192
QUERY_BLOCK = 256
_NEAR = 64        # exact nearest candidates from which links are chosen


class Graph:
    """A layered graph over ``vectors`` (float32, one row a node)."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.nodes, self.links = vectors, nodes, links  # nodes[k]: those of layer k, layer 0 has all

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, seed: int = 5) -> Graph:
        vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(degree)).astype(int)
        nodes, links = [np.arange(n)], [_link(vectors, 2 * degree)]
        k = 1
        while len(own := np.flatnonzero(level >= k)) > 1:
            local = _link(vectors[own], degree)
            nodes.append(own)
            links.append(np.where(local >= 0, own[local], -1).astype(np.int32))
            k += 1
        return cls(vectors, nodes, links)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and products of the best found for each query, best first; -1 where there are fewer."""
        queries = np.asarray(queries, np.float32)
        top = self.nodes[-1]
        entry = top[(queries @ self.vectors[top].T).argmax(axis=1)] if len(top) <= 512 else np.full(len(queries), top[0])
        for own, links in zip(self.nodes[:0:-1], self.links[:0:-1]):
            entry = self._descend(queries, entry, own, links)
        return self._beam(queries, entry, max(k, beam), k)

    def _descend(self, queries: np.ndarray, entry: np.ndarray, own: np.ndarray, links: np.ndarray) -> np.ndarray:
        at = entry.copy()
        best = np.einsum("qd,qd->q", queries, self.vectors[at])
        live = np.arange(len(queries))
        while len(live):
            near = links[np.searchsorted(own, at[live])]
            score = np.einsum("qd,qmd->qm", queries[live], self.vectors[near])
            score[near < 0] = -np.inf
            pick = score.argmax(axis=1)
            value = score[np.arange(len(live)), pick]
            better = value > best[live]
            live = live[better]
            at[live], best[live] = near[better, pick[better]], value[better]
        return at

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(queries), len(self.vectors)
        links = self.links[0]
        ids = np.full((q, beam), -1, np.int32)
        score = np.full((q, beam), -np.inf, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n), bool)
        ids[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", queries, self.vectors[entry]), False
        seen[np.arange(q), entry] = True
        live = np.arange(q)
        while len(live):
            open_score = np.where(done[live], -np.inf, score[live])
            pick = open_score.argmax(axis=1)
            some = open_score[np.arange(len(live)), pick] > -np.inf
            live, pick = live[some], pick[some]
            if not len(live):
                break
            done[live, pick] = True
            near = links[ids[live, pick]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, near[:, :1])] = True
            value = np.einsum("qd,qmd->qm", queries[live], self.vectors[near])
            value[~fresh] = -np.inf
            # the beam's worst go when better ones come
            all_score = np.concatenate([score[live], value], axis=1)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            rows = np.arange(len(live))[:, None]
            score[live], ids[live], done[live] = all_score[rows, keep], all_ids[rows, keep], all_done[rows, keep]
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        rows = np.arange(q)[:, None]
        found = score[rows, order]
        return np.where(np.isneginf(found), -1, ids[rows, order]), found


def _link(vectors: np.ndarray, degree: int) -> np.ndarray:
    """Links of one layer: diverse near neighbours, then links back while there is room."""
    n = len(vectors)
    out = np.full((n, degree), -1, np.int32)
    near_n = min(_NEAR, n - 1)
    if near_n <= 0:
        return out
    size = np.zeros(n, np.int64)
    half = max(1, degree // 2)
    for at in range(0, n, 512):
        product = vectors[at:at + 512] @ vectors.T
        rows = np.arange(len(product))
        product[rows, at + rows] = -np.inf
        near = np.argpartition(-product, near_n - 1, axis=1)[:, :near_n]
        value = np.take_along_axis(product, near, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        between = np.einsum("qad,qbd->qab", vectors[near], vectors[near])
        # on vectors of one length a larger product is a smaller distance
        taken = np.zeros(near.shape, bool)
        for j in range(near_n):
            blocked = (taken[:, :j] & (between[:, j, :j] > value[:, j:j + 1])).any(axis=1)
            taken[:, j] = ~blocked & (taken[:, :j].sum(axis=1) < half)
        # fill up to half the degree with the nearest that were passed over
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :half]
        chosen = np.take_along_axis(near, rank, axis=1)
        out[at:at + len(rows), :chosen.shape[1]] = chosen
        size[at:at + len(rows)] = chosen.shape[1]
    source = np.repeat(np.arange(n), half)[: n * half].reshape(n, half)
    heads = out[:, :half]
    ok = heads >= 0
    target, origin = heads[ok], source[ok]
    order = np.argsort(target, kind="stable")
    for t, o in zip(target[order], origin[order]):
        if size[t] < degree and o not in out[t, :size[t]]:
            out[t, size[t]] = o
            size[t] += 1
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """One row for each shard: dimension, node vectors (float64), ids of each node, and the flat neighbour arrays, as bytes."""
    own = _usable(vectors)
    per = Window.partitionBy("vector").orderBy("vec_id")
    own = own.dropDuplicates(["vec_id", "vector"])  # repeated rows count once, before the limit
    ranked = own.withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= k + 1)  # limited before the shuffle, too
    nodes = ranked.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = staged(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "vector", "ids")

    def run(key, table):
        dim = key[1].as_py()
        x = np.array(table.column("vector").combine_chunks().flatten(), float).reshape(-1, dim)
        ids = table.column("ids").to_pylist()
        order = np.lexsort((np.array([i[0] for i in ids]),))
        x, ids = x[order], [ids[i] for i in order]
        graph = Graph.build(lifted(x), degree)
        flat = np.concatenate([np.array(i, np.int64) for i in ids])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "vectors": pa.array([x.tobytes()], pa.binary()),
                         "ids": pa.array([flat.tobytes()], pa.binary()), "sizes": pa.array([np.array([len(i) for i in ids], np.int32).tobytes()], pa.binary()),
                         "nodes": pa.array([[a.astype(np.int32).tobytes() for a in graph.nodes]], pa.list_(pa.binary())),
                         "links": pa.array([[a.tobytes() for a in graph.links]], pa.list_(pa.binary()))})

    return dealt.groupBy("shard", "dim").applyInArrow(
        run, "shard int, dim int, vectors binary, ids binary, sizes binary, nodes array<binary>, links array<binary>")


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors brought to one length by one more coordinate; the direction of an inner product query does not see it."""
    square = (x ** 2).sum(axis=1)
    most = square.max() if len(square) else 0.0
    scale = 1 / np.sqrt(most) if most else 1.0
    return np.concatenate([x * scale, np.sqrt(np.maximum(1 - square[:, None] * scale ** 2, 0))], axis=1).astype(np.float32)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (columns vec_id, embedding), its own id left out."""
    index = staged(build_index(vectors, k, shard_rows, degree), "index")
    asked = _usable(queries).dropDuplicates(["vec_id", "vector"])

    def packed(key, table):
        x = np.array(table.column("vector").combine_chunks().flatten(), float)
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "query_ids": [np.array(table.column("vec_id")).astype(np.int64).tobytes()],
                         "queries": [x.tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("query_ids", pa.binary()), ("queries", pa.binary())]))

    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = asked.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"), "vec_id", "vector")
    blocks = staged(blocks.groupBy("dim", "block").applyInArrow(packed, "dim int, block long, query_ids binary, queries binary"), "queries")
    # every block of queries goes to every shard of its dimension, on as many tasks as there are such pairs
    where = index.select("dim", "shard")
    sent = blocks.join(where, "dim").repartition("shard", "block").join(index, ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _answers(r, k, beam)

    found = sent.select("dim", "query_ids", "queries", "vectors", "ids", "sizes", "nodes", "links").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(r: dict, k: int, beam: int) -> pa.RecordBatch:
    dim = r["dim"]
    x = np.frombuffer(r["vectors"], float).reshape(-1, dim)
    q = np.frombuffer(r["queries"], float).reshape(-1, dim)
    query_ids = np.frombuffer(r["query_ids"], np.int64)
    sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
    ids, at = np.frombuffer(r["ids"], np.int64), np.concatenate([[0], np.cumsum(sizes)])
    nodes = [np.frombuffer(b, np.int32) for b in r["nodes"]]
    links = [np.frombuffer(b, np.int32).reshape(len(n), -1) for b, n in zip(r["links"], nodes)]
    graph = Graph(lifted(x), nodes, links)
    lifted_q = np.concatenate([q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.zeros((len(q), 1))], axis=1)
    out_q, out_v, out_s = [], [], []
    for i in range(0, len(q), QUERY_BLOCK):
        got, _ = graph.search(lifted_q[i:i + QUERY_BLOCK], k + 1, beam)
        for own_id, own, near in zip(query_ids[i:i + QUERY_BLOCK], q[i:i + QUERY_BLOCK], got):
            near = near[near >= 0]
            score = np.array([own @ x[j] for j in near])
            which = np.repeat(np.arange(len(near)), sizes[near])
            found = np.concatenate([ids[at[j]:at[j + 1]] for j in near]) if len(near) else np.zeros(0, np.int64)
            score = score[which] if len(near) else np.zeros(0)
            other = found != own_id
            found, score = found[other], score[other]
            order = np.lexsort((found, -score))[:k]
            out_q.append(np.full(len(order), own_id))
            out_v.append(found[order])
            out_s.append(score[order])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((out_q, pa.int64()), (out_v, pa.int64()), (out_s, pa.float64()))],
                                      ["query_id", "vec_id", "score"])
