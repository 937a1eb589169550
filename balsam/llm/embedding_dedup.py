"""Near-duplicate vectors by navigable small-world graphs, one per shard of a label.

Equal vectors of a label are one node.  Nodes of a label are dealt to shards of bounded size; each
shard grows a layered graph once and every node of the label is searched in every one of its shards,
in tasks that hold one shard's graph and one shard's nodes as queries.  A beam
stays open while it is full of links, and a shard's beam doubles until an audit of its own nodes
against all of the shard finds enough of their links.  Cosines are verified in double precision.  A task
returns counts and one link per pair of groups, never pairs; Spark joins the groups to components."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import components, settle

THRESHOLD = 0.93
#: Nodes of a shard; links of a node on an upper and on the lowest layer; first beam; beam while building.
SHARD_NODES, LINKS, LOWEST_LINKS, BEAM, BUILD_BEAM = 4_000, 12, 24, 48, 32
#: An audit compares so many nodes of a shard with all of it and wants this share of their links.
AUDIT_NODES, AUDIT_RECALL = 256, 0.995
#: Queries that walk a graph at once.
WALK = 512


class Graph:
    """Layered small-world graph over unit vectors; nodes enter in batches that at most double it."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.v, n = vectors.astype(np.float32), len(vectors)
        level = np.minimum(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS), 8).astype(int)
        self.order = np.argsort(-level, kind="stable")  # upper layers first
        self.layers = []
        for top in range(level.max(initial=0), -1, -1):
            self.layers.append(self._layer(self.order[level[self.order] >= top], LINKS if top else LOWEST_LINKS))

    def _layer(self, nodes: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(self.v), links), -1, np.int64)
        done = min(len(nodes), links + 1)
        first = nodes[:done]
        sim = self.v[first] @ self.v[first].T
        np.fill_diagonal(sim, -np.inf)
        near[first, : done - 1] = first[np.argsort(-sim, axis=1)[:, : done - 1]]
        while done < len(nodes):
            batch = nodes[done : min(2 * done, done + 1024)]
            for part in np.array_split(batch, -(-len(batch) // WALK)):
                found, _ = self._walk(self.v[part], self._enter(self.v[part], nodes[0]), near, max(BUILD_BEAM, links))
                self._connect(part, found, near, links)
            done += len(batch)
        return nodes, near

    def _connect(self, new: np.ndarray, found: np.ndarray, near: np.ndarray, links: int) -> None:
        """Link new nodes with what they found, both ways; full nodes keep half nearest, half spread."""
        near[new, : min(links, found.shape[1])] = found[:, :links]
        to = found[:, : links // 2].ravel()
        source = np.repeat(new, min(links // 2, found.shape[1]))
        source, to = source[to >= 0], to[to >= 0]
        for node in np.unique(to):
            want = np.unique(np.concatenate([near[node][near[node] >= 0], source[to == node]])) if len(to) < 64 else None
            if want is None:
                break
            self._refill(node, want, near, links)
        else:
            return
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            node = to[order[a]]
            self._refill(node, np.unique(np.concatenate([near[node][near[node] >= 0], source[order[a:b]]])), near, links)

    def _refill(self, node: int, want: np.ndarray, near: np.ndarray, links: int) -> None:
        if len(want) > links:
            sim = self.v[want] @ self.v[node]
            by = np.argsort(-sim, kind="stable")
            half = by[: links // 2]
            # The rest: nearest first, leaving out those closer to a chosen one than to the node.
            chosen, rest = list(half), []
            for i in by[links // 2 :]:
                (chosen if len(chosen) < links and (self.v[want[chosen[links // 2 :]]] @ self.v[want[i]] < sim[i]).all() else rest).append(i)
                if len(chosen) == links:
                    break
            want = want[(chosen + rest)[:links]]
        near[node] = -1
        near[node, : len(want)] = want

    def _enter(self, queries: np.ndarray, fallback: int) -> np.ndarray:
        at = np.full((len(queries), 1), self.layers[0][0][0] if self.layers else fallback, np.int64)
        for _, near in self.layers:
            at = self._walk(queries, at, near, 4)[0][:, :1]
        return at

    def _walk(self, queries: np.ndarray, at: np.ndarray, near: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `beam` nodes per query (-1 where fewer) and their cosines, walking all queries in step."""
        q = len(queries)
        seen = np.zeros((q, len(self.v) + 1), bool)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int64)
        sim = np.full((q, beam), -np.inf, np.float32)
        ids[:, : at.shape[1]] = at
        sim[:, : at.shape[1]] = np.where(at >= 0, np.einsum("qkd,qd->qk", self.v[at], queries), -np.inf)
        seen[rows[:, None], at] = True
        fresh = ids >= 0  # in the beam and not yet expanded
        active = rows
        while len(active):
            best = np.argmax(np.where(fresh[active], sim[active], -np.inf), axis=1)
            fresh[active, best] = False
            around = near[ids[active, best]]
            new = (around >= 0) & ~seen[active[:, None], around]
            seen[active[:, None], np.where(new, around, len(self.v))] = True
            cos = np.where(new, np.einsum("qkd,qd->qk", self.v[around], queries[active]), -np.inf).astype(np.float32)
            all_sim = np.concatenate([sim[active], cos], axis=1)
            all_ids = np.concatenate([ids[active], np.where(new, around, -1)], axis=1)
            all_fresh = np.concatenate([fresh[active], new], axis=1)
            keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            sim[active] = np.take_along_axis(all_sim, keep, 1)
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            fresh[active] = np.take_along_axis(all_fresh, keep, 1)
            active = active[fresh[active].any(axis=1)]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def search(self, queries: np.ndarray, beam: int, floor: float, own: np.ndarray) -> list[np.ndarray]:
        """Nodes that may reach `floor` per query; a beam whose last place does is walked again, twice as wide.

        A query that is a node itself (`own`, else -1) starts there too."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        left = np.arange(len(queries))
        queries = queries.astype(np.float32)
        while len(left):
            beam = min(beam, len(self.v))
            again = []
            for part in np.array_split(left, -(-len(left) // WALK)):
                if beam == len(self.v):
                    found = np.broadcast_to(np.arange(beam), (len(part), beam))
                    sim = queries[part] @ self.v.T
                else:
                    at = self._enter(queries[part], 0)
                    at = np.concatenate([at, np.where(own[part, None] == at, -1, own[part, None])], axis=1)
                    found, sim = self._walk(queries[part], at, self.layers[-1][1], beam)
                full = (sim[:, -1] >= floor) & (beam < len(self.v))
                for i, f, s in zip(part[~full], found[~full], sim[~full], strict=True):
                    out[i] = f[s >= floor]
                again.append(part[full])
            left = np.concatenate(again)
            beam *= 2
        return out


def _linked(vectors: np.ndarray, query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    return candidates[vectors[candidates] @ query >= THRESHOLD]


def audited_beam(graph: Graph, vectors: np.ndarray, seed: int = 11) -> int:
    """Least beam (doubling from BEAM) whose audit finds AUDIT_RECALL of the links of sampled nodes."""
    n = len(vectors)
    probe = np.random.default_rng(seed).permutation(n)[:AUDIT_NODES]
    truth = [np.flatnonzero(vectors @ vectors[i] >= THRESHOLD) for i in probe]
    beam = BEAM
    while beam < n:
        found = graph.search(vectors[probe], beam, THRESHOLD - 1e-4, np.full(n, -1))
        hits = sum((_linked(vectors, vectors[i], f) != i).sum() for i, f in zip(probe, found, strict=True))
        if hits >= AUDIT_RECALL * sum((t != i).sum() for i, t in zip(probe, truth, strict=True)):
            break
        beam *= 2
    return min(beam, n)


def _build_shard(ids, weights, vectors):
    """Link counts and links of a shard's nodes among themselves, and what other nodes are searched with: the graph, its
    beam and the group of each node."""
    graph = Graph(vectors)
    beam = audited_beam(graph, vectors)
    n = len(ids)
    found = graph.search(vectors, beam, THRESHOLD - 1e-4, np.arange(n))
    group = np.arange(n)

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    hits = [_linked(vectors, q, f) for q, f in zip(vectors, found, strict=True)]
    # Inside the shard a link that either end has found holds for both.
    one = np.repeat(np.arange(n), [len(h) for h in hits])
    two = np.concatenate(hits)
    pairs = np.unique(np.concatenate([one * n + two, two * n + one]))
    counts = np.zeros(n, np.int64)
    np.add.at(counts, pairs // n, weights[pairs % n])
    for i, j in zip(pairs // n, pairs % n, strict=True):
        x, y = root(i), root(j)
        if x != y:
            group[max(x, y)] = min(x, y)
    group = np.array([root(i) for i in range(n)])
    apart = np.flatnonzero(group != np.arange(n))
    return counts, ids[apart], ids[group[apart]], (graph, beam, ids, weights, vectors, group)


def _search_shard(shard, query_ids, queries):
    """Link counts of another shard's nodes in a shard, and one link per query and group of the shard."""
    graph, beam, ids, weights, vectors, group = shard
    found = graph.search(queries, beam, THRESHOLD - 1e-4, np.full(len(queries), -1))
    counts, a, b = np.zeros(len(queries), np.int64), [], []
    for i, (q, f) in enumerate(zip(queries, found, strict=True)):
        h = _linked(vectors, q, f)
        counts[i] = weights[h].sum()
        for r in np.unique(group[h]):
            a.append(query_ids[i])
            b.append(ids[r])
    return counts, a, b


def _unit(v: pd.Series) -> np.ndarray:
    matrix = np.array(v.tolist(), np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _others(shards: str) -> F.Column:
    return F.filter(F.sequence(F.lit(0), F.col(shards) - 1), lambda o: o != F.col("shard"))


def pieces(nodes: DataFrame) -> DataFrame:
    """(label, to, shard, node, v): every node as a query in all other shards of its label; a task takes one (label, to,
    shard), so it holds the queries of one shard."""
    return nodes.select("label", F.explode(_others("shards")).alias("to"), "shard", "node", "v")


def link_vectors(table: DataFrame, vector: str = "embedding", label: str = "label", id_column: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of one non-null label link at a cosine of 0.93 or more, in double precision.  Vectors that
    are null, empty, zero, hold a null or non-finite component, or stand without a label link with
    nothing, as do vectors of different lengths with each other.  Rows that repeat a vec_id are one
    vector for the components and count as links of each other where they link; a null vec_id takes no
    part.  Other columns are ignored; an empty table gives no rows."""
    base = table.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    sound &= F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = settle(base.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn(
        "key", F.when(F.col("sound"), F.sha2(F.concat_ws(",", "label", F.col("v").cast("array<string>")), 256))).withColumn(
        "label", F.concat_ws(":", "label", F.size("v").cast("string"))))
    nodes = rows.where("sound").groupBy("key").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / F.lit(SHARD_NODES)).cast("int").alias("shards"))
    nodes = settle(nodes.join(sizes, "label").withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int")))

    def build(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("node", kind="stable")
        ids = members["node"].to_numpy()
        counts, a, b, shard = _build_shard(ids, members["weight"].to_numpy(), _unit(members["v"]))
        return pd.DataFrame({"label": [key[0]], "shard": [key[1]], "shards": [members["shards"].iloc[0]], "graph": [pickle.dumps(shard)],
                             "a": [[*ids, *a]], "b": [[*[-1] * len(ids), *b]], "n": [[*counts, *[0] * len(a)]]})

    def search(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        queries = queries.sort_values("node", kind="stable")
        ids = queries["node"].to_numpy()
        counts, a, b = _search_shard(pickle.loads(graph["graph"].iloc[0]), ids, _unit(queries["v"]))
        return pd.DataFrame({"a": [*ids, *a], "b": [*[-1] * len(ids), *b], "n": [*counts, *[0] * len(a)]})

    built = settle(nodes.groupBy("label", "shard").applyInPandas(
        build, "label string, shard int, shards int, graph binary, a array<bigint>, b array<bigint>, n array<bigint>"))
    inner = built.select(F.explode(F.arrays_zip("a", "b", "n")).alias("f")).select("f.a", "f.b", "f.n")
    graphs = built.select("label", F.col("shard").alias("to"), F.explode(_others("shards")).alias("shard"), "graph")
    key = ["label", "to", "shard"]
    outer = pieces(nodes).groupBy(*key).cogroup(graphs.groupBy(*key)).applyInPandas(search, "a bigint, b bigint, n bigint")
    found = settle(inner.union(outer))
    counts = found.where("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = rows.join(nodes.select("key", "node"), "key", "left")
    # Two vectors of one vec_id belong together.
    links = found.where("b <> -1").select("a", "b").union(named.where("node is not null").select("vec_id", "node"))
    label_of = components(links)
    out = named.join(counts, "node", "left").join(label_of, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "node", "vec_id")
    out = out.select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
