"""What the exact vector searches share: whole-number vectors, packed blocks, exact scores, merged best lists.

Vectors and queries travel as a few packed rows: a block holds some thousand vectors as one binary matrix, so tasks
take one block of queries and one block of vectors, and what they return are k places per query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

#: Vectors and bytes (of doubles) of a block at most; queries of a block at most.
BLOCK_ROWS, BLOCK_BYTES, ASK_ROWS = 4_096, 1 << 21, 512
#: Doubles hold every whole number up to here.
EXACT = float(1 << 53)
#: Score of a place that nothing holds; real scores are held above it.
NONE = np.iinfo(np.int64).min
#: Best lists that one task merges.
MERGE = 64


def whole_vectors(table: DataFrame, vector: str, id_column: str, *others: tuple[str, Column]) -> DataFrame:
    """(vec_id, *others, dim, v): v holds floor(256 * x) as doubles.

    Rows without an id, a vector, or with a component that is null or not finite (256 * x included) are left out, as are
    rows where one of `others` is null.  Rows equal in all of these count once."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: c * 256.0)
    base = table.select(F.col(id_column).cast("bigint").alias("vec_id"), *[c.alias(n) for n, c in others], x.alias("x"))
    finite = F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    sound = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    for name, _ in others:
        sound &= F.col(name).isNotNull()
    # A double beyond 2^53 is a whole number as it is.
    floor = F.transform("x", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    return base.where(sound).select("vec_id", *[n for n, _ in others], F.size("x").alias("dim"), floor.alias("v"))


def least_copies(rows: DataFrame, k: int, *within: str) -> DataFrame:
    """Of equal vectors (of one `within`) only the k least ids: no list of k places can hold more of them."""
    keyed = rows.withColumn("h", F.xxhash64("v"))
    place = F.dense_rank().over(Window.partitionBy(*within, "h", "v").orderBy("vec_id"))
    return keyed.withColumn("place", place).where(F.col("place") <= k).dropDuplicates([*within, "h", "v", "vec_id"]).drop("h", "place")


def deal(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """`rows` with block (a number) and blocks (how many there are of the same keys); a block has some `most` rows, fewer
    of long vectors."""
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(BLOCK_BYTES / 8 / F.greatest(F.col("dim"), F.lit(1)))))
    sizes = settle(rows.groupBy(*keys, "dim").agg(F.count("*").alias("n")).select(
        *keys, "dim", F.ceil(F.col("n") / size).cast("int").alias("blocks")))
    return rows.join(sizes, [*keys, "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column as one matrix of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers below 2^24 take four bytes each, others eight."""
    small = v.size == 0 or np.abs(v).max() < (1 << 24)
    return (b"\4" if small else b"\10") + v.astype("<f4" if small else "<f8").tobytes()


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[0] == 4 else "<f8", offset=1).astype(np.float64).reshape(rows, -1)


def pack(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, ids, v): the rows of a key by id, as packed matrices."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        out = {k: table[k][:1] for k in keys}
        return pa.table({**out, "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                         "v": pa.array([packed(matrix(table["v"], len(ids)))], pa.binary())})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "vec_id", "v").groupBy(*keys).applyInArrow(run, f"{kinds}, ids binary, v binary")


def exact_sums(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether products of all rows add up within the whole numbers that doubles hold."""
    if not q.size or not v.size:
        return True
    return float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < EXACT


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows as 64-bit numbers; larger ones are held at the ends of the range."""
    if exact_sums(q, v):
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(v).T, NONE + 1, -(NONE + 1)).astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best places per row: higher scores, then smaller ids; missing places (NONE) come last."""
    if score.shape[1] < k:
        more = ((0, 0), (0, k - score.shape[1]))
        ids, score = np.pad(ids, more), np.pad(score, more, constant_values=NONE)
    order = np.lexsort((ids, ~score), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def search(asks: DataFrame, blocks: DataFrame, pairs: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(the ask's row, the block's row) of every (ask, block) of `pairs`; a task holds one of each at a time."""
    left = pairs.join(asks, "ask")
    sent = pairs.select(F.col("ask").alias("to_ask"), F.col("block").alias("of_block"))
    right = sent.join(blocks, F.col("of_block") == F.col("block"))
    return left.groupBy("ask", "block").cogroup(right.groupBy("to_ask", "of_block")).applyInArrow(fn, schema)


FOUND = "ask bigint, block bigint, ids binary, score binary"


def found_row(ask: int, block: int, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"ask": pa.array([ask], pa.int64()), "block": pa.array([block], pa.int64()),
                     "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                     "score": pa.array([score.astype("<i8").tobytes()], pa.binary())})


NOTHING = found_row(0, 0, np.zeros((0, 1)), np.zeros((0, 1)))[:0]


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """One row per ask from FOUND rows: the best k places per query.  Rows are merged some MERGE at a time, in rounds."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        ids, score = (np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(-1, k) for x in table[c]], axis=1) for c in ("ids", "score"))
        return found_row(table["ask"][0].as_py(), table["block"][0].as_py(), *best(ids, score, k))

    found = settle(found)
    while True:
        most = found.groupBy("ask").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        part = F.pmod(F.xxhash64("block"), F.lit(-(-most // MERGE)))
        merged = settle(found.withColumn("part", part).groupBy("ask", "part").applyInArrow(run, FOUND))
        discard(found)
        found = merged
