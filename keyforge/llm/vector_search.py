"""Approximate nearest neighbours: a navigable small-world graph per shard (operator 8).

Equal vectors form one class, which keeps its few least ids (a search never
needs more of a class), so a vector that very many rows share is one node.
Classes are dealt by hash to shards of about ``shard_rows`` nodes.  One task
builds the hierarchical graph of a shard: nodes are ordered by level, so layer
l holds the first nodes and its links are one flat array of neighbour numbers;
a new node links to a diverse selection of the nearest among those already in
the layer (shards are small enough to rank them all), and full lists are cut
back by the same rule, so links between groups stay.  The graphs are written.

Queries go to every shard in blocks of ``block_rows``.  A search descends
through the layers with ``UPPER`` nodes, all of which enter the next layer, and
widens to a beam of ``beam`` nodes on the lowest.  What the beam found is scored exactly in double precision on the
original vectors, and the best of all shards are merged.

Vectors that are null, zero or hold null or non-finite components take no
part.  Vectors are compared with those of the same length only.  Repeated rows
(same id and vector) count once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyforge.llm.common import ship, written

ship(__name__)

LINKS = 16
BUILD, BEAM, UPPER, SLACK = 64, 128, 32, 16


# ---- one shard ----

def _diverse(order: np.ndarray, to_new: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of candidates by falling similarity, those nearer to the new node than
    to one already taken; then the nearest of the rest."""
    taken: list[int] = []
    rest: list[int] = []
    nearest_taken = np.full(len(order), -np.inf)
    for k in range(len(order)):
        if len(taken) == most:
            break
        if nearest_taken[k] < to_new[k]:
            taken.append(k)
            np.maximum(nearest_taken, between[k], out=nearest_taken)
        else:
            rest.append(k)
    return [int(order[k]) for k in taken + rest[:most - len(taken)]]


def _layer(x: np.ndarray, most: int) -> np.ndarray:
    """Flat neighbour array of one layer over its nodes in order; -1 fills up.
    Lists may grow by ``SLACK`` links; full ones are cut back to a diverse
    selection of ``most``, which keeps the links between groups."""
    n = len(x)
    links = np.full((n, most + SLACK), -1, dtype=np.int32)
    near = np.full((n, most + SLACK), -np.inf, dtype=np.float32)
    degree = np.zeros(n, dtype=np.int64)

    def prune(j: int) -> None:
        held, sims = links[j, :degree[j]], near[j, :degree[j]]
        by = np.argsort(-sims, kind="stable")
        c = x[held[by]]
        keep = _diverse(by, sims[by], c @ c.T, most)
        links[j], near[j] = np.append(held[keep], [-1] * (most + SLACK - len(keep))), np.append(sims[keep], [-np.inf] * (most + SLACK - len(keep)))
        degree[j] = len(keep)

    for i in range(1, n):
        sims = x[:i] @ x[i]
        if i > BUILD:
            order = np.argpartition(-sims, BUILD)[:BUILD]
            order = order[np.argsort(-sims[order], kind="stable")]
        else:
            order = np.argsort(-sims, kind="stable")
        c = x[order]
        for j in _diverse(order, sims[order], c @ c.T, LINKS):
            for a, b in ((i, j), (j, i)):
                if degree[a] == most + SLACK:
                    prune(a)
                links[a, degree[a]], near[a, degree[a]] = b, sims[j]
                degree[a] += 1
    for j in np.flatnonzero(degree > most):
        prune(int(j))
    return np.ascontiguousarray(links[:, :most])


def _level(key: bytes) -> int:
    u = (xxhash.xxh3_64_intdigest(key, seed=7) + 1) / 2.0 ** 64
    return int(-math.log(u) / math.log(LINKS))


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the nodes (high levels first) and the neighbour arrays of all
    layers, lowest first, in numbers of that order."""
    vectors = vectors.astype(np.float64)
    unit = (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]).astype(np.float32)
    levels = np.array([_level(v.tobytes()) for v in unit])
    order = np.argsort(-levels, kind="stable")
    unit, levels = np.ascontiguousarray(unit[order]), levels[order]
    return order, [_layer(unit[:(levels >= k).sum()], 2 * LINKS if k == 0 else LINKS) for k in range(int(levels[0]) + 1)]


def _widened(unit: np.ndarray, links: np.ndarray, found: list[tuple[float, int]], query: np.ndarray, beam: int) -> list[tuple[float, int]]:
    """The beam (similarity, node) on one layer, begun from ``found``."""
    seen = np.zeros(len(links), dtype=bool)
    seen[[j for _, j in found]] = True
    open_ = [(-s, j) for s, j in found]
    found = list(found)
    heapq.heapify(open_)
    heapq.heapify(found)
    while open_:
        far, node = heapq.heappop(open_)
        if len(found) >= beam and -far < found[0][0]:
            break
        around = links[node]
        around = around[around >= 0]
        around = around[~seen[around]]
        if not len(around):
            continue
        seen[around] = True
        sims = unit[around] @ query
        if len(found) >= beam:
            good = sims > found[0][0]
            around, sims = around[good], sims[good]
        for s, j in zip(sims.tolist(), around.tolist(), strict=True):
            if len(found) < beam:
                heapq.heappush(found, (s, j))
            elif s > found[0][0]:
                heapq.heapreplace(found, (s, j))
            else:
                continue
            heapq.heappush(open_, (-s, j))
    return found


def search_graph(unit: np.ndarray, layers: list[np.ndarray], query: np.ndarray, beam: int) -> list[int]:
    """Numbers of the nodes that the beam ends with."""
    found = [(float(unit[0] @ query), 0)]
    for links in layers[:0:-1]:
        found = _widened(unit, links, found, query, min(UPPER, beam))
    return [j for _, j in _widened(unit, layers[0], found, query, beam)]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, in double precision; a row's value
    does not depend on the rows beside it."""
    v, q = vectors.astype(np.float64), query.astype(np.float64)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


# ---- all shards ----

def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).groupBy("v", "id").agg(F.size("v").alias("dim"))


def index(rows: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Written graphs (dim, shard, node arrays), and the number of shards by vector length."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
    classes = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim")))
    # One entry for each vector length in use.
    shards = {r["dim"]: -(-r["count"] // shard_rows) for r in classes.groupBy("dim").count().collect()}
    if not shards:
        shards = {0: 1}
    of = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("dim"))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.get("ids", F.lit(0)), F.lit(11)), of).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first").reset_index(drop=True)
        vectors = np.array(part["v"].tolist())
        order, layers = build_graph(vectors)
        ids = [part["ids"][i] for i in order]
        return pd.DataFrame({
            "dim": [int(part["dim"][0])], "shard": [int(part["shard"][0])], "kind": [vectors.dtype.str], "vectors": [vectors[order].tobytes()],
            "ids": [np.concatenate(ids).astype("<i8").tobytes()], "counts": [np.array([len(x) for x in ids], "<i4").tobytes()],
            "links": [b"".join(x.tobytes() for x in layers)], "sizes": [np.array([len(x) for x in layers], "<i4").tobytes()]})

    graphs = dealt.withColumn("first", F.get("ids", F.lit(0))).groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, kind string, vectors binary, ids binary, counts binary, links binary, sizes binary")
    return written(graphs), shards


def _search(k: int, beam: int):
    def run(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(queries):
            g = graph.iloc[0]
            vectors = np.frombuffer(g["vectors"], g["kind"]).reshape(-1, int(g["dim"]))
            counts = np.frombuffer(g["counts"], "<i4")
            ids = np.split(np.frombuffer(g["ids"], "<i8"), np.cumsum(counts)[:-1])
            layers, at = [], 0
            flat = np.frombuffer(g["links"], "<i4")
            for level, n in enumerate(np.frombuffer(g["sizes"], "<i4")):
                most = 2 * LINKS if level == 0 else LINKS
                layers.append(flat[at:at + n * most].reshape(n, most))
                at += n * most
            wide = vectors.astype(np.float64)
            unit = (wide / np.sqrt((wide * wide).sum(axis=1))[:, None]).astype(np.float32)
            for q, v in zip(queries["id"].tolist(), queries["v"], strict=True):
                v = np.asarray(v)
                w = v.astype(np.float64)
                nodes = search_graph(unit, layers, (w / np.sqrt((w * w).sum())).astype(np.float32), beam)
                scores = cosines(vectors[nodes], v)
                hits = [(far, i) for far, j in zip((-scores).tolist(), nodes, strict=True) for i in ids[j].tolist() if i != q]
                for far, i in sorted(hits)[:k]:
                    out["query_id"].append(q)
                    out["vec_id"].append(i)
                    out["score"].append(-far)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row whose id
    is divisible by ``every``, among all other rows."""
    rows = usable(vectors, id_col, vector_col)
    graphs, shards = index(rows, k, shard_rows)
    queries = written(rows.where(F.col("id") % every == 0))
    blocks = -(-max(1, queries.count()) // block_rows)
    last = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in (pair[0], pair[1] - 1)]), F.col("dim"))
    sent = queries.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("shard"))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInPandas(_search(k, beam), T.StructType.fromDDL("query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
