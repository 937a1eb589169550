"""Helpers the pipeline operators share: settled tables, packed text batches, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.functions.settle import settle

__all__ = ["chunks", "components", "documents", "mix64", "release_shuffles", "settle", "discard", "word_hashes", "word_spans"]

#: Bytes of text that a task works on at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column (null: empty) and its n + 1 offsets."""
    kind = pa.large_string() if pa.types.is_string(column.type) else column.type
    column = pc.cast(column, kind)
    column = pc.cast(column, pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes: first row, end row, bytes, offsets of the run."""
    if not len(column):
        return
    raw, at = binary(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower_ascii(x: np.ndarray) -> np.ndarray:
    return np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint8)


def word_spans(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts laid end to end: starts, ends, and words before each text."""
    inside = ~((x == 32) | ((x >= 9) & (x <= 13)))
    edge = np.zeros(len(x) + 1, bool)
    edge[at] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of x; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(x)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_BASE_INVERSE, len(x))[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id that an edge (a, b) names: the smallest id it can reach.

    Each round every id hooks to the neighbour of least random priority and the graph shrinks to
    the ids hooked to, so chains and stars alike end after a few rounds.  Rounds are settled; the
    driver sees only whether edges are left."""
    old = edges.select("a", "b").where("a <> b").distinct()
    edges = settle(old)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    label = settle(ids.select("id", F.col("id").alias("at")))
    for turn in range(1_000):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("v"))
        hook = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(
            F.col("a").alias("v"), F.least(ranked("a"), "m")["v"].alias("to"))
        hook = settle(hook)
        fewer = settle(
            edges.join(hook, edges.a == hook.v).select(F.col("to").alias("x"), "b")
            .join(hook, F.col("b") == hook.v).select("x", F.col("to").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        moved = settle(label.join(hook, label["at"] == hook.v, "left").select("id", F.coalesce("to", "at").alias("at")))
        discard(hook, edges, label)
        edges, label = fewer, moved
    else:
        if not edges.isEmpty():
            raise RuntimeError("edges are left after 1,000 rounds")
    least = label.groupBy("at").agg(F.min("id").alias("component_id"))
    out = settle(label.join(least, "at").select("id", "component_id"))
    discard(edges, label)
    return out
