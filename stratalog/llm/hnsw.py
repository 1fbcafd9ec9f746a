"""Approximate nearest neighbours: a navigable small-world graph per shard, kept as flat neighbour arrays; shard results merge."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.common import shared_dir, stored

#: Rows a shard and queries a block, on average; neighbours a node above the ground (twice that on it); beams.
SHARD_ROWS, BLOCK_QUERIES = 32_768, 512
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 96, 256


class Graph:
    """Hierarchical graph over unit vectors, nearest by inner product. ``neighbours[level]`` is an (n, width) array, -1 where unused."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = vectors
        self.neighbours = neighbours or []
        self.entry = entry

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 0) -> "Graph":
        n = len(vectors)
        self = cls(np.ascontiguousarray(vectors, dtype=np.float32))
        draws = np.random.default_rng(seed).random(n)
        levels = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int)
        top = int(levels.max()) if n else 0
        lists: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(top + 1)]
        self.lists = lists
        entry, height = 0, int(levels[0]) if n else 0
        for i in range(1, n):
            q, level = self.vectors[i], int(levels[i])
            at = [(float(self.vectors[entry] @ q), entry)]
            for k in range(height, level, -1):
                at = self._beam(q, at, 1, k)
            for k in range(min(level, height), -1, -1):
                at = self._beam(q, at, beam, k)
                width = links if k else 2 * links
                chosen = self._spread([(s, j) for s, j in at], links)
                lists[k][i] = chosen
                for j in chosen:
                    back = lists[k][j]
                    back.append(i)
                    if len(back) > width:
                        sims = self.vectors[back] @ self.vectors[j]
                        lists[k][j] = self._spread(sorted(zip(sims.tolist(), back), reverse=True), width)
            if level > height:
                entry, height = i, level
        self.entry = entry
        self.neighbours = []
        for k, rows in enumerate(lists[: height + 1]):
            flat = np.full((n, links if k else 2 * links), -1, np.int32)
            for i, row in enumerate(rows):
                flat[i, : len(row)] = row
            self.neighbours.append(flat)
        return self

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, leaving out whoever is nearer to one already chosen; filled up with the nearest left out."""
        if len(found) <= most:
            return [j for _, j in found]
        ids = [j for _, j in found]
        between = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        spare: list[int] = []
        closest = np.full(len(ids), -np.inf, np.float32)
        for k, (s, _) in enumerate(found):
            if s > closest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(closest, between[k], out=closest)
            else:
                spare.append(k)
        chosen += spare[: most - len(chosen)]
        return [ids[k] for k in chosen]

    def _of(self, level: int, i: int) -> list[int]:
        return self.lists[level][i]

    def _beam(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest nodes found from ``starts``, nearest first."""
        vectors, rows = self.vectors, self.lists[level]
        seen = {j for _, j in starts}
        open_ = [(-s, j) for s, j in starts]
        heapq.heapify(open_)
        best = list(starts)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while open_:
            s, i = heapq.heappop(open_)
            if -s < best[0][0] and len(best) >= beam:
                break
            fresh = [j for j in rows[i] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            floor = best[0][0]
            for t, j in zip((vectors[fresh] @ q).tolist(), fresh):
                if len(best) < beam:
                    heapq.heappush(best, (t, j))
                    heapq.heappush(open_, (-t, j))
                    floor = best[0][0]
                elif t > floor:
                    heapq.heapreplace(best, (t, j))
                    heapq.heappush(open_, (-t, j))
                    floor = best[0][0]
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, beam: int = SEARCH_BEAM) -> list[int]:
        if not len(self.vectors):
            return []
        q = q.astype(np.float32)
        at = [(float(self.vectors[self.entry] @ q), self.entry)]
        for k in range(len(self.neighbours) - 1, 0, -1):
            at = self._beam(q, at, 1, k)
        return [j for _, j in self._beam(q, at, beam, 0)]

    def opened(self) -> "Graph":
        """Neighbour lists from the flat arrays, for searching."""
        self.lists = [[row[: k].tolist() for row, k in zip(flat, (flat >= 0).sum(axis=1))] for flat in self.neighbours]
        return self


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _shard(ids: np.ndarray, vectors: np.ndarray, seed: int) -> bytes:
    """One dimension's vectors as a graph over the distinct ones, lifted so that largest inner product is nearest."""
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.lexsort((ids, of))
    norms = np.sqrt((distinct.astype(np.float64) ** 2).sum(axis=1))
    most = norms.max()
    lifted = np.hstack([distinct / most, np.sqrt(np.maximum(0.0, 1 - (norms / most) ** 2))[:, None]]).astype(np.float32)
    graph = Graph.build(lifted, seed=seed)
    starts = np.searchsorted(of[order], np.arange(len(distinct) + 1))
    levels = {f"level{k}": a for k, a in enumerate(graph.neighbours)}
    return _saved(vectors=distinct, lifted=lifted, ids=ids[order], starts=starts, entry=np.array(graph.entry), **levels)


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct (vec_id, v, dim) with vectors of doubles that are not null, not zero and hold finite components only."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).groupBy("vec_id", "v").agg(F.size(F.first("v")).alias("dim"))


def nearest(vectors: DataFrame, folder: str, k: int = 20, query_modulus: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each query: (query_id, rank, vec_id, score).

    Queries are the rows whose id is divisible by ``query_modulus``; candidates all rows of the same dimension but
    those with the query's id. Every row is indexed: rows spread over shards by a hash of id and vector, about
    SHARD_ROWS each, so no vector, however common, gathers in one; equal vectors of a shard are one node with a list
    of ids. Graphs are stored as one row a shard; blocks of queries meet each shard, search its graph, score what it
    finds on the original vectors in double precision, and the k best of all shards remain; ties go to smaller ids.

    Null, zero, and not-finite vectors and null ids take no part; repeated rows count once; rows of one id with
    different vectors count each; an empty table gives no rows; columns besides id and vector are ignored.
    """
    rows = stored(taking_part(vectors, vec_id, embedding), folder, "vectors")
    n = rows.count()
    shards, spark = max(1, math.ceil(n / SHARD_ROWS)), rows.sparkSession

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "graph": pa.array([_shard(ids, flat, shard)], pa.binary())})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    graphs = stored(sharded.repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, graph binary"), folder, "graphs")

    def gather(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return pa.table({"dim": table["dim"].slice(0, 1).cast(pa.int32()), "block": table["block"].slice(0, 1).cast(pa.int32()), "queries": pa.array([_saved(ids=ids, vectors=flat)], pa.binary())})

    queries = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0)
    blocks = max(1, math.ceil(n / query_modulus / BLOCK_QUERIES))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("v", "vec_id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(gather, "dim int, block int, queries binary")
    blocked = stored(blocked, folder, "queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph_blob, query_blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, q = np.load(io.BytesIO(graph_blob)), np.load(io.BytesIO(query_blob))
                base, ids, starts = g["vectors"], g["ids"], g["starts"]
                graph = Graph(g["lifted"], [g[f"level{i}"] for i in range(sum(name.startswith("level") for name in g.files))], int(g["entry"])).opened()
                out: list[tuple[int, int, float]] = []
                for query, v in zip(q["ids"].tolist(), q["vectors"]):
                    lifted = np.append(v / np.sqrt((v * v).sum()), 0.0)
                    nodes = np.array(graph.search(lifted, max(SEARCH_BEAM, 2 * k)), dtype=np.int64)
                    scores = (base[nodes] * v).sum(axis=1)
                    found: list[tuple[float, int]] = []
                    for node, s in zip(nodes.tolist(), scores.tolist()):
                        mine = ids[starts[node] : starts[node + 1]]
                        found += [(-s, i) for i in mine[: k + 1].tolist() if i != query] if len(mine) <= k + 1 else [(-s, i) for i in mine[mine != query][:k].tolist()]
                    out += [(query, i, -s) for s, i in heapq.nsmallest(k, found)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

    met = blocked.join(graphs, ["shard", "dim"]).select("graph", "queries")
    each = met.repartition(max(1, shards * blocks)).mapInArrow(search, "query_id long, vec_id long, score double")
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth row of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), shared_dir(spark))
