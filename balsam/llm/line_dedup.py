"""Drop lines that many documents share, keeping them in one document.

Lines become 128-bit hashes, dealt by ranges of (hash, salt of the document) and sorted by document and position,
so a line that a third of all documents hold is SALTS runs.  One pass over the sorted runs marks a document's first
line of a hash, counts a run's documents and ends at the largest; only those last rows are added up by hash.  What
goes back to the documents are bitmaps of the lines to drop, dense arrays of 64 lines a word; the text itself is read
again and never enters the sort.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

MIN_POINTS, MIN_DOCUMENTS = 40, 5
#: Runs that the lines of one hash fall into, by document.
SALTS = 64
#: White space at the ends of a line that its key leaves out.
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _keyed_lines(docs: DataFrame, text: str, id_column: str, min_points: int) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of the lines long enough; no text goes on."""
    lines = docs.where(F.col(id_column).isNotNull() & (F.length(text) >= min_points)).select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("row_hash"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.regexp_replace("line", _ENDS, ""), _UPPER, _LOWER)
    lines = lines.where(F.length("line") >= min_points).withColumn("key", key).where(F.length("key") >= min_points)
    return lines.select("doc_id", "row_hash", "pos", F.xxhash64(F.lit(1), "key").alias("h1"),
                        F.xxhash64(F.lit(2), "key").alias("h2"))


def drop_bitmaps(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_points: int = MIN_POINTS,
                 min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, row_hash, drop_words) of documents that lose lines: an array of 64-line words, bit set = line goes."""
    spark = docs.sparkSession
    # Settled first: the range exchange samples its input, and no line is to be split and hashed twice.
    lines = settle(_keyed_lines(docs, text, id_column, min_points).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["h1", "h2", "salt", "doc_id", "pos"]
    runs = lines.repartitionByRange(parts, "h1", "h2", "salt").sortWithinPartitions(*order)
    # The windows read the sorted runs as they come: the exchange and the sort above are the only ones.
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    first = F.when(F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id")), 0).otherwise(1)
    streamed = runs.withColumn("first", first).withColumn("next", F.lead("doc_id").over(run))
    streamed = streamed.withColumn("n", F.sum("first").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = settle(streamed.select("doc_id", "row_hash", "pos", "h1", "h2", F.when(F.col("next").isNull(), F.col("n")).alias("n")))
    discard(lines)
    # The last row of a run says how many documents it has, and is the largest of them.
    shared = runs.where("n IS NOT NULL").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc_id").alias("keeper"))
    shared = settle(shared.where(F.col("n") >= min_documents).select("h1", "h2", "keeper"))
    gone = runs.join(shared, ["h1", "h2"]).where("doc_id <> keeper")
    words = gone.groupBy("doc_id", "row_hash", F.expr("pos div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    maps = words.groupBy("doc_id", "row_hash").agg(
        F.max("w").alias("top"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("top")), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("bigint")))
    bitmaps = settle(maps.select("doc_id", "row_hash", dense.alias("drop_words")))
    discard(runs, shared)
    return bitmaps


def deduplicate_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_points: int = MIN_POINTS,
                      min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`docs` with `kept_text`, `n_lines` and `n_dropped` in place of the text.

    A line's key is the line without white space at its ends, A-Z in lower case.  A key of at least
    `min_points` code points that at least `min_documents` doc_ids hold loses all its lines except in
    the largest of them, where all stay.  Null or empty text: one empty line.  Rows without a doc_id
    are not counted and stay whole; rows that repeat a doc_id count as one document, and equal ones
    lose the same lines; other columns pass through; an empty table gives no rows."""
    bitmaps = drop_bitmaps(docs, text, id_column, min_points, min_documents)
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__hash"),
                           F.col("drop_words").alias("__words"))
    keyed = docs.withColumn("__row", F.xxhash64(text))
    # The documents are not sorted: the bitmaps are the small side.
    joined = keyed.join(marks.hint("shuffle_hash"), (F.col(id_column) == F.col("__doc")) & (F.col("__row") == F.col("__hash")), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    goes = lambda i: F.coalesce(F.get("__words", F.expr("0") + (i / 64).cast("int")), F.lit(0).cast("bigint"))
    stay = F.filter(lines, lambda x, i: F.getbit(goes(i), i % 64) == 0)
    kept = F.when(F.col("__words").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    dropped = F.aggregate("__words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in (text, "kept_text", "n_lines", "n_dropped")], kept.alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("bigint").alias("n_dropped"))


def digest(kept: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return kept.select(F.col(id_column).alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
