"""Nearest neighbours by largest inner product: one hierarchical small-world graph per shard, results merged (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rareclass.llm.shared import stored
from rareclass.llm.vectors import matrix, usable
from rareclass.llm.words import mix64

INDEX = "dims int, shard int, n long, level_sizes array<long>, nodes binary, vectors binary, neighbours binary"
RESULT = "query_id long, vec_id long, score double"
NONE = -1
#: Nodes of a full shard and places of a search in it, which belong together: of the 21 nearest of 64 random dimensions a full shard finds over
#: 0.95, also where one tight cluster holds a third of it (tests/llm/test_hnsw.py).
SHARD_ROWS, BEAM = 16_384, 384


class Graph(NamedTuple):
    """Flat arrays of a shard. Level l holds the first ``level_sizes[l]`` nodes; ``neighbours[l]`` has one row each, -1 for none."""

    vectors: np.ndarray
    level_sizes: list[int]
    neighbours: list[np.ndarray]


def _levels(keys: np.ndarray, width: int) -> np.ndarray:
    """Geometric levels from a hash of the node, so a rebuilt shard is the same."""
    u = (mix64(keys.astype(np.uint64) + np.uint64(0x51ED)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(width)).astype(np.int64)


def _level_graph(points: np.ndarray, width: int, candidates: int, links: int, far: int, seed: int) -> np.ndarray:
    """Neighbour rows of one level.

    Candidates of a node are its nearest points, found exactly block by block. One is kept when it is nearer to the node than to all
    kept before; places left over go to the nearest others. Links are then made mutual as far as places allow,
    nearest first, and a few random links keep tight groups reachable.
    """
    n = len(points)
    if n == 1:
        return np.full((1, 1), NONE, dtype=np.int32)
    c = min(candidates, n - 1)
    kept_rows = []
    for a in range(0, n, 512):
        near = points[a:a + 512] @ points.T
        own = np.arange(len(near))
        near[own, own + a] = -np.inf
        top = np.argpartition(-near, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(near, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
        between = np.einsum("ijk,ilk->ijl", points[top], points[top])
        kept = np.zeros((len(top), c), dtype=bool)
        blocked = np.full((len(top), c), -np.inf)
        for j in range(c):
            kept[:, j] = (value[:, j] > blocked[:, j]) & (kept[:, :j].sum(axis=1) < width)
            blocked = np.where(kept[:, j][:, None], np.maximum(blocked, between[:, j, :]), blocked)
        place = np.where(kept, 0, c) + np.arange(c)
        chosen = np.argsort(place, axis=1, kind="stable")[:, :width]
        kept_rows.append(np.stack([np.take_along_axis(top, chosen, axis=1),
                                   np.take_along_axis(value, chosen, axis=1).view(np.int32)], axis=2))
    forward = np.concatenate(kept_rows)
    w = forward.shape[1]
    source = np.repeat(np.arange(n), w)
    target, value = forward[:, :, 0].ravel(), np.ascontiguousarray(forward[:, :, 1]).view(np.float32).ravel()
    src = np.concatenate([source, target])
    dst = np.concatenate([target, source])
    first = np.concatenate([np.zeros(len(source)), np.ones(len(source))])
    val = np.concatenate([value, value])
    pair, keep = np.unique(src.astype(np.int64) * n + dst, return_index=True)
    src, dst, first, val = src[keep], dst[keep], first[keep], val[keep]
    order = np.lexsort((-val, first, src))
    src, dst = src[order], dst[order]
    begin = np.searchsorted(src, np.arange(n))
    rank = np.arange(len(src)) - begin[src]
    out = np.full((n, links + far), NONE, dtype=np.int32)
    fits = rank < links
    out[src[fits], rank[fits]] = dst[fits]
    out[:, links:] = np.random.Generator(np.random.PCG64([seed, n])).integers(0, n, (n, far))
    return out


def build(vectors: np.ndarray, keys: np.ndarray, width: int = 16, candidates: int = 48, seed: int = 3) -> tuple[Graph, np.ndarray]:
    """(graph, order): nodes are sorted by falling level. Vectors get one more component so that inner product and nearness agree."""
    level = _levels(keys, width)
    order = np.lexsort((keys, -level))
    vectors, level = np.ascontiguousarray(vectors[order], dtype=np.float32), level[order]
    norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    extra = np.sqrt(np.maximum(norms.max() - norms, 0.0))
    points = np.concatenate([vectors, extra[:, None].astype(np.float32)], axis=1) / np.float32(max(np.sqrt(norms.max()), 1e-30))
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
    graphs = [_level_graph(points[:m], width, candidates, 2 * width, 4, seed + k) for k, m in enumerate(sizes)]
    return Graph(vectors, sizes, graphs), order


def search(graph: Graph, queries: np.ndarray, k: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of about the ``k`` best nodes of each query, best first, -1 for none; all queries step together."""
    queries = queries.astype(np.float32)
    n, q = len(graph.vectors), len(queries)
    rows = np.arange(q)
    at = np.zeros(q, dtype=np.int64)
    best = queries @ graph.vectors[0]
    for links in graph.neighbours[:0:-1]:
        moving = rows
        while len(moving):
            near = links[at[moving]]
            value = np.einsum("ijk,ik->ij", graph.vectors[near], queries[moving])
            value[near == NONE] = -np.inf
            pick = value.argmax(axis=1)
            top = value[np.arange(len(moving)), pick]
            better = top > best[moving]
            moving, near, pick, top = moving[better], near[better], pick[better], top[better]
            at[moving] = near[np.arange(len(moving)), pick]
            best[moving] = top
    beam = min(beam, n)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # stands for no neighbour
    nodes = np.full((q, beam), n, dtype=np.int64)
    scores = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    nodes[:, 0], scores[:, 0], done[:, 0] = at, best, False
    seen[rows, at] = True
    base = graph.neighbours[0]
    active = rows
    while len(active):
        waiting = np.where(done[active], -np.inf, scores[active])
        pick = np.argpartition(-waiting, min(expand, beam) - 1, axis=1)[:, :expand]
        take = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        go = take.any(axis=1)
        active, pick, take = active[go], pick[go], take[go]
        if not len(active):
            break
        flags = done[active]
        np.put_along_axis(flags, pick, True, axis=1)
        done[active] = flags
        source = np.take_along_axis(nodes[active], pick, axis=1)
        near = base[np.where(take, source, 0)].astype(np.int64)
        near[~take] = NONE
        near = near.reshape(len(active), -1)
        near[near == NONE] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[active[:, None], near]
        near[~fresh] = n
        seen[active[:, None], near] = True
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :max(1, int(fresh.sum(axis=1).max()))]
        near = np.take_along_axis(near, order, axis=1)
        value = np.einsum("ijk,ik->ij", graph.vectors[np.minimum(near, n - 1)], queries[active])
        value[near == n] = -np.inf
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_scores = np.concatenate([scores[active], value], axis=1)
        all_done = np.concatenate([done[active], near == n], axis=1)
        keep = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, keep, axis=1)
        scores[active] = np.take_along_axis(all_scores, keep, axis=1)
        done[active] = np.take_along_axis(all_done, keep, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    nodes = np.take_along_axis(nodes, order, axis=1)
    nodes[nodes == n] = NONE
    return nodes, np.take_along_axis(scores, order, axis=1)


def index(vectors: DataFrame, shards: int | None = None, shard_rows: int = SHARD_ROWS, least_shards: int = 8,
          copies_kept: int = 21) -> tuple[DataFrame, DataFrame]:
    """(graphs, members): one row per shard with its flat arrays, and the ids of each distinct vector, smallest first.

    Every usable row is indexed; equal vectors are one node. A list of equal vectors needs only its ``copies_kept`` smallest ids,
    as ties go to smaller ids; they are ranked over (vector, id), never gathered whole. Shards hold about ``shard_rows`` nodes
    each and are dealt by a hash of the node; vectors of another length live in shards of their own.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) \
        .withColumn("embedding", F.transform("embedding", lambda x: x + 0.0)).distinct()
    salted = W.partitionBy("embedding", "_salt").orderBy("vec_id")
    few = clean.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_r", F.row_number().over(salted)) \
        .filter(F.col("_r") <= copies_kept).groupBy("embedding").agg(
            F.slice(F.array_sort(F.collect_list("vec_id")), 1, copies_kept).alias("ids"))
    members = stored(few.select(F.col("ids")[0].alias("node"), "ids", "embedding"), "hnsw-members")
    if shards is None:
        shards = max(least_shards, -(-members.count() // shard_rows))

    def keep(table: pa.Table) -> pa.Table:
        keys = table.column("node").to_numpy()
        flat = np.stack(table.column("embedding").to_numpy())
        graph, order = build(flat, keys)
        links = np.concatenate([g.ravel() for g in graph.neighbours])
        return pa.table({
            "dims": table.column("dims")[:1], "shard": table.column("shard")[:1], "n": pa.array([len(keys)], pa.int64()),
            "level_sizes": pa.array([graph.level_sizes], pa.list_(pa.int64())),
            "nodes": pa.array([keys[order].astype("<i8").tobytes()]), "vectors": pa.array([flat[order].astype("<f8").tobytes()]),
            "neighbours": pa.array([links.astype("<i4").tobytes()])})

    dealt = members.select(F.size("embedding").alias("dims"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"),
                           "node", "embedding")
    return stored(dealt.groupBy("dims", "shard").applyInArrow(keep, INDEX), "hnsw-graphs"), members


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM, query_block: int = 65_536,
            shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Each query is searched in every shard, block of queries by block; shard results are merged by score, ties to smaller ids.
    Scores are inner products in double precision on the original vectors. Null, zero or non-finite vectors and null ids take no part;
    a query meets vectors of its own length only. Rows that repeat an (id, vector) pair count once. Other columns are ignored.
    """
    graphs, members = index(vectors, shards, copies_kept=k + 1)
    asked = vectors.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")) \
        .filter(usable(F.col("query"))).distinct().withColumn("dims", F.size("query"))
    blocks = max(1, -(-asked.count() // query_block))
    places = graphs.select(F.col("dims").alias("dims"), F.col("shard").alias("shard"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(places, "dims")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64()))})
        row = left.to_pylist()[0]
        n, sizes = row["n"], row["level_sizes"]
        vectors_ = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
        flat, neighbours, at = np.frombuffer(row["neighbours"], "<i4"), [], 0
        for m in sizes:
            width = 1 if m == 1 else 36
            neighbours.append(flat[at:at + m * width].reshape(m, width))
            at += m * width
        graph = Graph(vectors_.astype(np.float32), sizes, neighbours)
        nodes = np.frombuffer(row["nodes"], "<i8")
        ids = right.column("query_id").to_numpy()
        queries = np.stack(right.column("query").to_numpy())
        out: list[tuple[np.ndarray, ...]] = []
        step = max(16, (1 << 24) // (n + 1))
        for a in range(0, len(ids), step):
            found, _ = search(graph, queries[a:a + step], k + 8, beam)
            for i, places_ in enumerate(found):
                places_ = places_[places_ >= 0]
                score = (vectors_[places_] * queries[a + i]).sum(axis=1)
                best = np.lexsort((nodes[places_], -score))[:k + 1]
                out.append((np.full(len(best), ids[a + i]), nodes[places_[best]], score[best]))
        q, v, s = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": q, "node": v, "score": s})

    found = copies.groupBy("dims", "shard", "block").cogroup(dealt.groupBy("dims", "shard", "block")) \
        .applyInArrow(find, "query_id long, node long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "node")
    top = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    whole = top.join(members.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), "score") \
        .filter("vec_id <> query_id")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return whole.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
