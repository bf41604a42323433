"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of the vectors.

Vectors of one length are hashed into shards of about ``ROWS_A_SHARD``. A shard's graph is built in one task and stored as
flat arrays: neighbours of layer 0 as a matrix, upper layers as node lists and matrices, with the vectors beside them. A
table of queries is a stated part of the rows (the query of this folder takes every id divisible by 50): blocks of them meet
every shard of their length, and the best of each query over all shards are merged. Similarity is the cosine.

Every row is indexed, and building takes time in proportion to the rows. Searching takes the queries times the shards: with
the queries a fixed share of the rows it grows with the square of the vectors over the shard size.

Defined results: null or empty vectors and vectors with null, NaN or infinite parts have no neighbours and are nobody's
neighbour; vectors of another length than the query's aren't its neighbours; a vector of zeros has similarity 0 to all; a
vector isn't its own neighbour (by row, so rows of one vec_id can be neighbours of one another); similarities are rounded to
6 places, then ties go to the smaller vec_id (null last); fewer than ``k`` other vectors give fewer rows; an empty table gives
none, nor do no queries; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import materialise

ROWS_A_SHARD = 16_384
QUERIES_A_BLOCK = 2_048
LINKS = 16
EF_BUILD = 80
EF_SEARCH = 64


class Graph:
    """A small-world graph over unit vectors; ``near[layer][node]`` are the nodes it links to, -1 for none."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.lists = [dict(zip(nodes.tolist(), ([x for x in row if x >= 0] for row in near.tolist()))) for nodes, near in layers]

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 7) -> Graph:
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(len(vectors)) + 1e-300) / math.log(links)).astype(int)
        g = cls(vectors, [], 0)
        g.lists = [{} for _ in range(int(level.max()) + 1)]
        top = -1
        for i in range(len(vectors)):
            if top >= 0:
                entry = [(float(vectors[i] @ vectors[g.entry]), g.entry)]
                for layer in range(top, -1, -1):
                    found = g._beam(vectors[i], entry, 1 if layer > level[i] else ef, layer)
                    if layer <= level[i]:
                        g._link(i, found, layer, links * 2 if layer == 0 else links, links)
                    entry = found
            for layer in range(top + 1, level[i] + 1):
                g.lists[layer][i] = []
            if level[i] > top:
                top, g.entry = int(level[i]), i
        for layer, near in enumerate(g.lists):
            width = links * 2 if layer == 0 else links
            nodes = np.fromiter(sorted(near), np.int32, len(near))
            matrix = np.full((len(nodes), width), -1, np.int32)
            for r, node in enumerate(nodes.tolist()):
                matrix[r, : len(near[node])] = near[node]
            g.layers.append((nodes, matrix))
        return g

    def _beam(self, q: np.ndarray, entry: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The best ``ef`` (similarity, node) that a search from ``entry`` finds, best first."""
        near, vectors = self.lists[layer], self.vectors
        seen = {n for _, n in entry}
        best = list(entry)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        todo = [(-s, n) for s, n in entry]
        heapq.heapify(todo)
        while todo:
            s, node = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            new = [n for n in near[node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            floor = best[0][0] if len(best) >= ef else -math.inf
            for s, n in zip((vectors[new] @ q).tolist(), new):
                if s > floor or len(best) < ef:
                    heapq.heappush(todo, (-s, n))
                    heapq.heappush(best, (s, n))
                    if len(best) > ef:
                        heapq.heappop(best)
                    if len(best) >= ef:
                        floor = best[0][0]
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` of ``found``: those closer to the query than to one chosen before, then the best others."""
        found = found[: 3 * most]
        nodes = [n for _, n in found]
        if len(nodes) <= most:
            return nodes
        v = self.vectors[nodes]
        among = v @ v.T
        chosen: list[int] = []
        closest = np.full(len(nodes), -2.0)
        for i, (s, _) in enumerate(found):
            if s > closest[i]:
                chosen.append(i)
                np.maximum(closest, among[i], out=closest)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            had = set(chosen)
            chosen += [i for i in range(len(nodes)) if i not in had][: most - len(chosen)]
        return [nodes[i] for i in chosen]

    def _link(self, i: int, found: list[tuple[float, int]], layer: int, width: int, links: int) -> None:
        near = self.lists[layer]
        near[i] = self._select(found, links)
        for n in near[i]:
            near[n].append(i)
            if len(near[n]) > width:
                sims = self.vectors[near[n]] @ self.vectors[n]
                near[n] = self._select(sorted(zip(sims.tolist(), near[n]), key=lambda x: (-x[0], x[1])), width)

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[tuple[float, int]]:
        entry = [(float(q @ self.vectors[self.entry]), self.entry)]
        for layer in range(len(self.lists) - 1, 0, -1):
            entry = self._beam(q, entry, 1, layer)
        return self._beam(q, entry, max(ef, k), 0)[:k]

    def flat(self) -> dict:
        """The graph as binary columns."""
        return {"vectors": self.vectors.astype(np.float32).tobytes(), "entry": int(self.entry), "nodes": [n.tobytes() for n, _ in self.layers], "near": [m.tobytes() for _, m in self.layers]}

    @classmethod
    def of(cls, vectors: bytes, entry: int, nodes: list[bytes], near: list[bytes], n: int) -> Graph:
        layers = []
        for a, b in zip(nodes, near):
            ids = np.frombuffer(a, np.int32)
            layers.append((ids, np.frombuffer(b, np.int32).reshape(len(ids), -1)))
        return cls(np.frombuffer(vectors, np.float32).reshape(n, -1), layers, entry)


def unit_vectors(vectors: DataFrame, is_query: F.Column | None = None) -> DataFrame:
    """vec_id, asks (whether it is a query), row (a number of the row's own), dim and the vector scaled to length 1, for rows whose vector is whole."""
    v = F.col("embedding").cast("array<double>")
    whole = vectors.where((F.size("embedding") > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # scaled by the largest part first, so that no square is infinite or 0
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    even = F.transform(v, lambda x: F.when(top > 0, x / top).otherwise(F.lit(0.0)))
    norm = F.sqrt(F.aggregate(F.col("even"), F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("even", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))
    asks = F.coalesce(is_query, F.lit(False)) if is_query is not None else F.lit(True)
    some = whole.select("vec_id", asks.alias("asks"), F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("dim"), even.alias("even"))
    return some.select("vec_id", "asks", "row", "dim", unit.cast("array<float>").alias("unit"))


def neighbours(vectors: DataFrame, k: int = 10, rows_a_shard: int = ROWS_A_SHARD, ef: int = EF_SEARCH, is_query: F.Column | None = None) -> DataFrame:
    """vec_id, neighbour_id, rank, similarity: up to ``k`` neighbours of every vector that ``is_query`` takes (all without it), the nearest first."""
    units = materialise(unit_vectors(vectors, is_query))  # written once, so a row keeps its number
    kind = vectors.schema["vec_id"].dataType.simpleString()
    size = lambda n, each: F.ceil(F.col(n) / F.lit(each)).cast("int")
    dims = units.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    dims = materialise(dims.select("dim", size("n", rows_a_shard).alias("shards"), F.greatest(size("asked", QUERIES_A_BLOCK), F.lit(1)).alias("blocks")))
    of = units.join(dims, "dim")
    numbered = of.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        g = Graph.build(np.stack(pdf["unit"].to_numpy()).astype(np.float32))
        head = {"dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "blocks": int(pdf["blocks"].iloc[0]), "size": len(pdf)}
        return pd.DataFrame([{**head, "rows": pdf["row"].to_numpy(np.int64).tobytes(), **g.flat()}])

    total = int(dims.agg(F.sum("shards")).first()[0] or 1)  # a task for each shard
    placed = numbered.repartition(total, "dim", "shard").select("dim", "shard", "blocks", "row", "unit")
    graphs = materialise(placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, blocks int, size int, rows binary, vectors binary, entry int, nodes array<binary>, near array<binary>"))
    asked = of.where("asks").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = asked.select("dim", "block", "row", "unit", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def search(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, g in graph.iterrows() if len(queries) else ():
            own = np.frombuffer(g["rows"], np.int64)
            index = Graph.of(g["vectors"], g["entry"], list(g["nodes"]), list(g["near"]), g["size"])
            for row, q in zip(queries["row"], queries["unit"]):
                found = [(round(s, 6), int(own[i])) for s, i in index.search(np.asarray(q, np.float32), max(ef, k + 1), ef) if own[i] != row]
                last = found[k - 1][0] if len(found) >= k else -2.0
                rows += [(row, o, s) for s, o in found if s >= last]  # with all that tie with the last
        return pd.DataFrame(rows, columns=["row", "other", "similarity"])

    each = graphs.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = pairs.groupBy("dim", "shard", "block").cogroup(each.groupBy("dim", "shard", "block")).applyInPandas(search, "row bigint, other bigint, similarity double")
    names = units.select(F.col("row").alias("other"), F.col("vec_id").alias("neighbour_id"))
    hit = F.struct((-F.col("similarity")).alias("away"), F.col("neighbour_id").isNull().alias("unknown"), "neighbour_id")
    merged = found.join(names, "other").groupBy("row").agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k).alias("hits"))
    out = merged.join(units.select("row", "vec_id"), "row").select("vec_id", F.posexplode("hits").alias("at", "hit"))
    return out.select("vec_id", F.col("hit.neighbour_id").cast(kind).alias("neighbour_id"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("hit.away")).alias("similarity"))
