"""Extendible hashing: rows fall into shards by leading hash bits, and only oversized shards split.

The directory maps bit prefixes to shards.  Bytes are summed per fine prefix first, so splitting reads
sums and not documents: a prefix belongs to its shortest leading part whose bytes fit.  Prefixes that
are too large even at the fine depth go on with more bits, they alone.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

HASH_BITS = 60
#: Bytes of text in a shard, as the registered query has it: small files that a loader reads whole.
SHARD_BYTES = 1 << 20
#: Bits by which the fine prefixes are deeper than evenly filled shards would be.
SPARE_BITS = 4
#: Tasks that share the rows of one hash that is too large and cannot split.
SALTS = 256

ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
sizes AS (
  SELECT d.depth, h >> (60 - d.depth)::BIGINT AS prefix, sum(bytes)::BIGINT AS shard_bytes
  FROM hashed, (SELECT unnest(range(0, 41)) AS depth) d GROUP BY ALL),
placed AS (
  SELECT hashed.*, s.depth, s.prefix, s.shard_bytes, row_number() OVER (PARTITION BY h ORDER BY s.depth) AS choice
  FROM hashed JOIN sizes s ON (h >> (60 - s.depth)::BIGINT) = s.prefix
  WHERE s.shard_bytes <= 1048576)
SELECT doc_id, bytes, depth::INT AS depth, prefix::BIGINT AS prefix, 0::BIGINT AS part, shard_bytes
FROM placed WHERE choice = 1
"""


def _prefix(column: str, bits) -> F.Column:
    return F.shiftright(column, bits)


def build_directory(hashed: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """[(bits, entries)]: entries (p, depth, prefix, shard_bytes) name the shard of rows whose leading bits are p.

    Rows without an entry in one table have it in the next; depth is null where all bits are used up."""
    out, open_, known = [], hashed.select("h", "bytes"), 0
    while True:
        total = open_.agg(F.sum("bytes").alias("t"), F.max("bytes").alias("m")).first()
        spread = math.ceil(math.log2(max(1.0, (total["t"] or 0) / max_bytes))) + SPARE_BITS
        bits = min(HASH_BITS, known + spread)
        fine = settle(open_.groupBy(_prefix("h", HASH_BITS - bits).alias("p")).agg(F.sum("bytes").alias("bytes")))
        depths = F.sequence(F.lit(known), F.lit(bits))
        levels = fine.select("p", "bytes", F.explode(depths).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(p, {bits} - depth)"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= max_bytes)
        first = levels.join(fits, ["depth", "prefix"]).groupBy("p").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
        entries = settle(fine.join(first, "p", "left").select("p", "s.*"))
        discard(fine)
        if bits == HASH_BITS:
            return [*out, (bits, entries)]
        over = entries.where("depth is null").select("p")
        out.append((bits, settle(entries.where("depth is not null"))))
        if over.isEmpty():
            discard(entries)
            return out
        open_ = open_.withColumn("p", _prefix("h", HASH_BITS - bits)).join(over, "p", "left_semi").select("h", "bytes")
        known = bits


def assign_shards(docs: DataFrame, max_bytes: int, text: str = "text", id_column: str = "doc_id",
                  keep_text: bool = False) -> DataFrame:
    """doc_id, bytes, depth, prefix, part, shard_bytes per row: a shard is (depth, prefix, part).

    No shard holds more than `max_bytes` of UTF-8 text, except one that is a single longer text.  The
    hash covers doc_id and text; rows equal in both that exceed a shard are told apart by `part` (0
    elsewhere) and lie `max_bytes` together at most.  Null text counts 0 bytes, a null doc_id hashes as
    an empty one; other columns are ignored; an empty table gives no rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(body))
    hashed = docs.select(
        F.col(id_column).alias("doc_id"), F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").alias("h"),
        F.octet_length(body).cast("bigint").alias("bytes"), *([F.col(text).alias("text")] if keep_text else []))
    if not keep_text:
        hashed = settle(hashed)
    directory = build_directory(hashed, max_bytes)
    more = ["text"] * keep_text
    done, left = [], hashed
    for bits, entries in directory:
        found = left.withColumn("p", _prefix("h", HASH_BITS - bits)).join(entries, "p")
        done.append(found.where("depth is not null").select(
            "doc_id", "bytes", "depth", "prefix", F.lit(0).cast("bigint").alias("part"), "shard_bytes", *more))
    if directory[-1][0] == HASH_BITS:
        same = found.where("depth is null").withColumn("salt", F.expr(f"pmod(monotonically_increasing_id(), {SALTS})"))
        fit = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest("bytes", F.lit(1))))
        number = F.expr("row_number() over (partition by h, salt order by bytes)")
        same = same.withColumn("n", number).withColumn("part", F.expr("salt + 1") + SALTS * F.floor((F.col("n") - 1) / fit))
        done.append(same.select(
            "doc_id", "bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix"), F.col("part").cast("bigint"),
            F.expr("sum(bytes) over (partition by h, part)").alias("shard_bytes"), *more))
    out = done[0]
    for table in done[1:]:
        out = out.union(table)
    return out


def write_shards(docs: DataFrame, max_bytes: int, path: str, text: str = "text", id_column: str = "doc_id") -> None:
    """Write doc_id and text as one folder per shard; the rows of a shard meet in one task."""
    out = assign_shards(docs, max_bytes, text, id_column, keep_text=True)
    out.withColumn("shard", F.concat_ws("-", "depth", "prefix", "part")).repartition("shard").select(
        "doc_id", "text", "shard").write.partitionBy("shard").parquet(path)
