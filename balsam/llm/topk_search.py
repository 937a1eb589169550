"""Exact top-k search by inner product, in three phases under one threshold per query.

The dimensions fall into LISTS groups; a query's score is the sum of its partial scores, one score list a group.
Gather: each block of vectors takes the first entries of each of its lists and their whole scores; the k-th best of
all blocks is a cutoff that no answer lies below.  Collect: the cutoffs go to all blocks with their queries, and a list
sends its entries of at least cutoff / LISTS, the same share for each list: a vector below its share in every list sums
to less than the cutoff.  A list whose largest possible partial score (norms) is below the share is not read.  Resolve:
the other partial scores of what was sent are added, exactly, and the best k are kept and merged.

Equal vectors are searched once: only their k + 1 least ids go in, as no list of k places can show more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle
from balsam.llm.whole_vectors import (
    ASK_ROWS, BLOCK_ROWS, FOUND, NONE, NOTHING, best, deal, exact_sums, found_row, least_copies, merge_best, pack, scores,
    search, unpacked, whole_vectors,
)

K, EVERY = 5, 50
#: Groups of dimensions.  Two let the fewest vectors through: a share is half of the cutoff.
LISTS = 2
#: Entries of a block's lists whose whole scores are tried for the cutoff (at least k); more of them raise it.
DEPTH = 64

ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _groups(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values per row, equal ones from the left."""
    n = values.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), values.shape)
    finite = np.where(np.isfinite(values), np.abs(values), 0)
    if finite.max(initial=0) * (n + 1) < 1 << 53:
        return np.argpartition(np.arange(n) - values * n, k - 1, axis=1)[:, :k]
    return np.argsort(-values, axis=1, kind="stable")[:, :k]


def gather(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k whole scores among the first entries of each list of a block."""
    own = q_ids[:, None] == ids
    if not exact_sums(q, v):
        return best(np.broadcast_to(ids, own.shape), np.where(own, NONE, scores(q, v)), k)
    lists = [q[:, g] @ v[:, g].T for g in _groups(q.shape[1])]
    at = np.sort(np.concatenate([_top(np.where(own, -np.inf, s), max(k, DEPTH)) for s in lists], axis=1), axis=1)
    total = sum(np.take_along_axis(s, at, 1) for s in lists).astype(np.int64)
    twice = np.zeros(at.shape, bool)
    twice[:, 1:] = at[:, 1:] == at[:, :-1]
    return best(ids[at], np.where(twice | np.take_along_axis(own, at, 1), NONE, total), k)


def collect(q_ids, q, ids, v, cut, cut_id, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k of a block under the cutoffs (NONE: none known), and how many entries its lists sent."""
    shape = (len(q), k)
    none = np.zeros(shape, np.int64), np.full(shape, NONE)
    own = q_ids[:, None] == ids
    if not exact_sums(q, v):
        return *best(np.broadcast_to(ids, own.shape), np.where(own, NONE, scores(q, v)), k), own.size
    groups = _groups(q.shape[1])
    share = np.where(cut == NONE, -np.inf, cut.astype(np.float64))  # against LISTS times an entry
    reach = [np.sqrt((q[:, g] ** 2).sum(axis=1)) * np.sqrt((v[:, g] ** 2).sum(axis=1).max(initial=0)) for g in groups]
    read = np.flatnonzero(np.any([LISTS * r * (1 + 1e-9) >= share for r in reach], axis=0))
    if not len(read):
        return *none, 0
    lists = [q[read][:, g] @ v[:, g].T for g in groups]
    share, least = share[read, None], ids <= cut_id[read, None]
    sent = np.zeros((len(read), len(ids)), bool)
    for s in lists:
        # At the share itself an entry can only tie with the cutoff, where smaller ids come first.
        sent |= (LISTS * s > share) | ((LISTS * s == share) & least)
    sent &= ~own[read]
    total = np.where(sent, sum(lists), -np.inf)
    at = _top(total, k)
    found = np.take_along_axis(total, at, 1)
    kept = np.isfinite(found)
    none[0][read], none[1][read] = best(ids[at], np.where(kept, np.where(kept, found, 0).astype(np.int64), NONE), k)
    return *none, int(sent.sum())


def _sides(ask: pa.Table, block: pa.Table):
    q_ids, ids = (np.frombuffer(t["ids"][0].as_py(), "<i8") for t in (ask, block))
    return q_ids, unpacked(ask["v"][0].as_py(), len(q_ids)), ids, unpacked(block["v"][0].as_py(), len(ids))


def search_top_k(table: DataFrame, queries: Column, k: int = K, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row that `queries` (a condition on vec_id) names.

    A score is the inner product of floor(256 * x); higher first, then smaller vec_id.  Left out are rows without an id
    or vector, or with a null or non-finite component (256 * x included).  Vectors of different lengths do not meet;
    empty ones meet each other with score 0.  Rows equal in id and vector count once; rows of one id and several vectors
    are rows of their own, as candidates and as queries, and never meet each other.  Scores beyond 64 bits are held at
    the ends of that range.  Fewer than k other rows: all.  Other columns are ignored; an empty table gives no rows."""
    rows = settle(whole_vectors(table, vector, id_column))
    # A query's own id may be among the least ids of its vector.
    dealt = deal(least_copies(rows, k + 1), BLOCK_ROWS)
    number = (F.col("dim").cast("bigint") * (1 << 32) + F.col("block")).alias("block")
    blocks = settle(pack(dealt.select(number, "vec_id", "v"), "block"))
    asked = deal(rows.where(queries).dropDuplicates(["vec_id", "v"]), ASK_ROWS)
    asks = settle(pack(asked.select("dim", number.alias("ask"), "vec_id", "v"), "dim", "ask"))
    sizes = settle(dealt.groupBy("dim").agg(F.max("blocks").alias("blocks")))
    pairs = settle(asks.select("dim", "ask").join(sizes, "dim").select("ask", F.explode(F.sequence(
        F.col("dim").cast("bigint") * (1 << 32), F.col("dim").cast("bigint") * (1 << 32) + F.col("blocks") - 1)).alias("block")))

    def first(ask: pa.Table, block: pa.Table) -> pa.Table:
        if not len(ask) or not len(block):
            return NOTHING
        return found_row(ask["ask"][0].as_py(), block["block"][0].as_py(), *gather(*_sides(ask, block), k))

    def second(ask: pa.Table, block: pa.Table) -> pa.Table:
        if not len(ask) or not len(block):
            return NOTHING
        q_ids, q, ids, v = _sides(ask, block)
        cut, cut_id = (np.frombuffer(ask[c][0].as_py(), "<i8").reshape(-1, k)[:, -1] for c in ("cut", "cut_ids"))
        at, score, _ = collect(q_ids, q, ids, v, cut, cut_id, k)
        return found_row(ask["ask"][0].as_py(), block["block"][0].as_py(), at, score) if (score != NONE).any() else NOTHING

    gathered = merge_best(search(asks, blocks, pairs, first, FOUND), k)
    cutoffs = asks.join(gathered.select("ask", F.col("ids").alias("cut_ids"), F.col("score").alias("cut")), "ask")
    merged = merge_best(search(cutoffs, blocks, pairs, second, FOUND), k)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, ids, score in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                q_ids = np.frombuffer(q_ids, "<i8")
                ids, score = (np.frombuffer(x, "<i8").reshape(len(q_ids), k) for x in (ids, score))
                row, place = np.nonzero(score != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array((place + 1).astype(np.int32)),
                                                  pa.array(ids[row, place]), pa.array(score[row, place])],
                                                 ["query_id", "rank", "vec_id", "score"])

    out = settle(asks.select("ask", F.col("ids").alias("q_ids")).join(merged, "ask").select("q_ids", "ids", "score").mapInArrow(
        unpack, "query_id bigint, rank int, vec_id bigint, score bigint"))
    discard(rows, blocks, asks, pairs, gathered, merged)
    return out
