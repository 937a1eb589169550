"""Hard negatives by packed R-trees: different-label rows that score just below an anchor's positives.

Vectors of a label are sort-tile-recursively packed: Spark cuts slabs of one coordinate and sorts each by the next ones,
runs of it become blocks, and a block's rows are tiled again into leaves, inner nodes and a root, each with its minimum
bounding box.  A box gives an interval for the inner product with an anchor, coordinate by coordinate.  Each block of
anchors walks a tree best first, all its anchors in step; a box is left out if its interval misses the score window or
ends strictly below the k-th best found.  The same interval of the roots decides which blocks an anchor block is sent to.

First the positives are searched in the anchor's label, then each (anchor, positive) has a window in all other labels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle
from balsam.llm.whole_vectors import (
    ASK_ROWS, BLOCK_BYTES, BLOCK_ROWS, FOUND, NONE, NOTHING, best, deal, exact_sums, found_row, least_copies, matrix,
    merge_best, pack, packed, scores, search, unpacked, whole_vectors,
)

POSITIVES, NEGATIVES, EVERY = 5, 5, 100
#: A negative scores at least LOW[0] / LOW[1] of its positive, and at most as much.
LOW = (80, 100)
#: Rows of a leaf, children of a node, coordinates (those that vary most) that tile a block, slabs of a label.
LEAF, FAN, TILED, SLABS = 64, 8, 3, 64
#: Roots that one routing task compares with an anchor block.
ROOTS = 1_024

ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def tile(v: np.ndarray) -> np.ndarray:
    """Order of the rows in which consecutive runs of LEAF rows are tiles."""
    coordinates = np.argsort(-v.var(axis=0), kind="stable")[:TILED] if len(v) else np.zeros(0, int)

    def cut(rows: np.ndarray, left: np.ndarray) -> np.ndarray:
        tiles = -(-len(rows) // LEAF)
        if tiles <= 1 or not len(left):
            return rows
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        slabs = int(np.ceil(tiles ** (1 / len(left))))
        step = LEAF * -(-tiles // slabs)
        return np.concatenate([cut(rows[i : i + step], left[1:]) for i in range(0, len(rows), step)])

    return cut(np.arange(len(v)), coordinates)


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with anything in each box."""
    if not (exact_sums(q, low) and exact_sums(q, high)):
        return np.full((len(q), len(low)), -np.inf), np.full((len(q), len(low)), np.inf)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """Packed tree over tiled vectors: node boxes from the root down, and each node's children or leaf."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        cuts = np.arange(0, len(v), LEAF)
        levels = [(np.minimum.reduceat(v, cuts, axis=0), np.maximum.reduceat(v, cuts, axis=0))]
        while len(levels[0][0]) > 1:
            low, high = levels[0]
            cuts = np.arange(0, len(low), FAN)
            levels.insert(0, (np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)))
        self.low, self.high = (np.concatenate([level[i] for level in levels]) for i in (0, 1))
        starts = np.cumsum([0, *[len(level[0]) for level in levels]])
        self.leaf = int(starts[-2])  # the first leaf node
        self.child = np.full((self.leaf, FAN), -1)
        for this, below, end in zip(starts[:-2], starts[1:-1], starts[2:], strict=True):
            kids = np.arange(below, end)
            self.child[this + (kids - below) // FAN, (kids - below) % FAN] = kids

    def walk(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, top: np.ndarray, k: int):
        """(ids, scores, leaves read): per query the best k rows of another id with floor <= score <= top."""
        n = len(q)
        ids, score = np.zeros((n, k), np.int64), np.full((n, k), NONE)
        least, most = _reach(q, self.low, self.high)
        most = np.where((least <= top[:, None]) & (most >= floor[:, None]), np.minimum(most, top[:, None]), -np.inf)
        queue = np.full(most.shape, -np.inf)
        queue[:, 0] = most[:, 0]
        active, read = np.arange(n), 0
        while len(active):
            node = np.argmax(queue[active], axis=1)
            worth = queue[active, node]
            # Nothing left, or all left end strictly below the k-th best.
            kth = score[active, k - 1]
            going = (worth > -np.inf) & ((kth == NONE) | (worth >= kth))
            active, node = active[going], node[going]
            queue[active, node] = -np.inf
            inner = node < self.leaf
            rows, kids = np.repeat(active[inner], FAN), self.child[node[inner]].ravel()
            rows, kids = rows[kids >= 0], kids[kids >= 0]
            queue[rows, kids] = most[rows, kids]
            rows, leaves = active[~inner], node[~inner]
            order = np.argsort(leaves, kind="stable")
            for leaf, at in zip(*self._runs(leaves[order], rows[order]), strict=True):
                part = slice((leaf - self.leaf) * LEAF, (leaf - self.leaf + 1) * LEAF)
                s = scores(q[at], self.v[part])
                fits = (s >= floor[at, None]) & (s <= top[at, None]) & (q_ids[at, None] != self.ids[part])
                s = np.concatenate([score[at], np.where(fits, s, NONE)], axis=1)
                i = np.concatenate([ids[at], np.broadcast_to(self.ids[part], fits.shape)], axis=1)
                ids[at], score[at] = best(i, s, k)
                read += len(at)
        return ids, score, read

    @staticmethod
    def _runs(keys: np.ndarray, values: np.ndarray):
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        return keys[cuts], np.split(values, cuts[1:]) if len(keys) else []


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative per positive score; an empty window where there is no positive."""
    low = np.frompyfunc(lambda p: max(NONE + 1, -(-LOW[0] * p // LOW[1])), 1, 1)(positive.astype(object)).astype(np.int64)
    real = positive != NONE
    return np.where(real, low, 1), np.where(real, positive, 0)


TILES = "label string, dim int, ids binary, v binary, low binary, high binary"


def _tiles(points: DataFrame) -> DataFrame:
    """Blocks of one label and length: (block, label, dim, ids, v, low, high), rows in tiled order, and the root's box."""
    coordinate = lambda i: F.get("v", F.lit(i))
    quantiles = settle(points.groupBy("label", "dim").agg(
        F.percentile_approx(coordinate(0), [i / SLABS for i in range(1, SLABS)], 1_000).alias("cuts"),
        F.count("*").alias("n")))
    slabs = F.least(F.lit(SLABS), F.ceil(F.sqrt(F.col("n") / BLOCK_ROWS)))
    passed = F.coalesce(F.size(F.filter("cuts", lambda c: c <= coordinate(0))), F.lit(0))
    points = points.join(quantiles, ["label", "dim"]).withColumn("slab", F.floor(passed * slabs / SLABS).cast("int"))
    order = ["label", "dim", "slab", coordinate(1), coordinate(2), "vec_id"]
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = points.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(key, ids, v):
            ids, v = np.concatenate(ids), np.concatenate(v)
            order = tile(v)
            ids, v = ids[order], v[order]
            columns = [[key[0]], [key[1]], [ids.astype("<i8").tobytes()], [packed(v)],
                       [packed(v.min(axis=0))], [packed(v.max(axis=0))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
        names = ["label", "dim", "ids", "v", "low", "high"]
        open_key, ids, v, held = None, [], [], 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            for key, run_of in groupby(keys):
                end = at + sum(1 for _ in run_of)
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // 8 // max(1, key[1])))
                while at < end:
                    if held and (key != open_key or held == most):
                        yield block(open_key, ids, v)
                        ids, v, held = [], [], 0
                    open_key, take = key, min(end - at, most - held)
                    part = batch.slice(at, take)
                    ids.append(part.column(3).to_numpy(zero_copy_only=False))
                    v.append(matrix(pa.chunked_array([part.column(4)]), take))
                    held, at = held + take, at + take
        if held:
            yield block(open_key, ids, v)

    tiles = ordered.select("label", "dim", "slab", "vec_id", "v").mapInArrow(run, TILES)
    return settle(tiles.withColumn("block", F.monotonically_increasing_id()))


PACK = "dim int, block bigint, blocks array<bigint>, labels array<string>, low binary, high binary"


def _roots(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root boxes packed some ROOTS a row, and how many rows each vector length has."""
    roots = tiles.select("block", "label", "dim", "low", "high")
    sizes = settle(roots.groupBy("dim").agg(F.ceil(F.count("*") / ROOTS).cast("int").alias("packs")))
    number = F.col("dim").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("block"), "packs")
    dealt = roots.join(sizes, "dim").withColumn("pack", number)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        low, high = (packed(np.concatenate([unpacked(x.as_py(), 1) for x in table[c]])) for c in ("low", "high"))
        return pa.table({"dim": table["dim"][:1], "block": table["pack"][:1], "blocks": [table["block"].to_pylist()],
                         "labels": [table["label"].to_pylist()], "low": pa.array([low], pa.binary()), "high": pa.array([high], pa.binary())})

    return settle(dealt.groupBy("dim", "pack").applyInArrow(lambda t: run(t), PACK)), sizes


def _queries(ask: pa.Table, k: int):
    q_ids = np.frombuffer(ask["ids"][0].as_py(), "<i8")
    q = unpacked(ask["v"][0].as_py(), len(q_ids))
    if "score" not in ask.column_names:
        return q_ids, q, np.full(len(q), NONE + 1), np.full(len(q), -(NONE + 1))
    positive = np.frombuffer(ask["score"][0].as_py(), "<i8").reshape(len(q_ids), -1)
    return np.repeat(q_ids, k), np.repeat(q, k, axis=0), *windows(positive.ravel())


def _search(asks: DataFrame, tiles: DataFrame, roots: DataFrame, sizes: DataFrame, same: bool, k: int, per_ask: int) -> DataFrame:
    """Best k per query of every ask (per_ask windows a query), merged; in blocks of the ask's label or of all others."""

    def route(ask: pa.Table, root: pa.Table) -> pa.Table:
        hits = []
        if len(ask) and len(root):
            blocks, labels = root["blocks"][0].as_py(), root["labels"][0].as_py()
            low, high = (unpacked(root[c][0].as_py(), len(blocks)) for c in ("low", "high"))
            _, q, floor, top = _queries(ask, per_ask)
            least, most = _reach(q, low, high)
            met = ((least <= top[:, None]) & (most >= floor[:, None]) & (floor <= top)[:, None]).any(axis=0)
            hits = [b for b, label, m in zip(blocks, labels, met, strict=True) if m and (label == ask["label"][0].as_py()) == same]
        return pa.table({"ask": pa.array([ask["ask"][0].as_py()] * len(hits), pa.int64()), "block": pa.array(hits, pa.int64())})

    def walk(ask: pa.Table, block: pa.Table) -> pa.Table:
        if not len(ask) or not len(block):
            return NOTHING
        ids = np.frombuffer(block["ids"][0].as_py(), "<i8")
        q_ids, q, floor, top = _queries(ask, per_ask)
        at, score, _ = Tree(ids, unpacked(block["v"][0].as_py(), len(ids))).walk(q_ids, q, floor, top, k)
        return found_row(ask["ask"][0].as_py(), block["block"][0].as_py(), at, score) if (score != NONE).any() else NOTHING

    first = F.col("dim").cast("bigint") * (1 << 32)
    every = asks.select("ask", "dim").join(sizes, "dim").select(
        "ask", F.explode(F.sequence(first, first + F.col("packs") - 1)).alias("block"))
    pairs = settle(search(asks, roots.drop("dim"), every, route, "ask bigint, block bigint"))
    merged = merge_best(search(asks, tiles.select("block", "ids", "v"), pairs, walk, FOUND), k)
    discard(pairs)
    return merged


def mine_hard_negatives(table: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES,
                        negatives: int = NEGATIVES, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows that `anchors` (a condition on vec_id) names.  A score is the inner product of floor(256 * x);
    higher first, then smaller vec_id.  An anchor's positives are its first `positives` other rows of its label; a
    positive's negatives the first `negatives` rows of other labels within LOW of its score.  Left out are rows without
    an id, label or vector, or with a null or non-finite component (256 * x included).  Vectors of different lengths do
    not meet; empty ones meet each other with score 0.  Rows equal in id, label and vector count once; rows of one id that
    differ stand for themselves and never meet each other.  Scores beyond 64 bits are held at the ends of that range.  A
    negative or zero positive score has no window, but for negatives that score 0 as well.  Other columns are ignored;
    an empty table gives no rows."""
    rows = settle(whole_vectors(table, vector, id_column, ("label", label.cast("string"))))
    points = settle(least_copies(rows, max(positives + 1, negatives), "label"))
    tiles = _tiles(points)
    roots, sizes = _roots(tiles)
    asked = deal(rows.where(anchors).dropDuplicates(["vec_id", "label", "v"]), ASK_ROWS, "label")
    asks = settle(pack(asked.select("label", "dim", "block", "vec_id", "v"), "label", "dim", "block")
                  .drop("block").withColumn("ask", F.monotonically_increasing_id()))
    near = _search(asks, tiles, roots, sizes, True, positives, 1)
    wide = asks.join(near.select("ask", "score", F.col("ids").alias("positive_ids")), "ask")
    far = _search(wide, tiles, roots, sizes, False, negatives, positives)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, p_ids, p_score, ids, score in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                q_ids, p_ids, p_score, ids, score = (np.frombuffer(x, "<i8") for x in (q_ids, p_ids, p_score, ids, score))
                at, place = np.nonzero(score.reshape(-1, negatives) != NONE)
                found = at * negatives + place
                columns = [q_ids[at // positives], p_ids[at], (place + 1).astype(np.int32), ids[found], p_score[at], score[found]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [
                    "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    out = wide.select("ask", F.col("ids").alias("q_ids"), "positive_ids", F.col("score").alias("p_score")).join(
        far.select("ask", "ids", "score"), "ask").drop("ask")
    out = settle(out.mapInArrow(unpack, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                        "positive_score bigint, negative_score bigint"))
    discard(rows, points, tiles, roots, asks, near, far)
    return out
