"""Phrase collocations from a weighted de Bruijn graph of words, per language.

At every word one gram is read: the longest, of up to five words, that its piece still holds.  Five-word grams are the
edges between overlapping four-word nodes; shorter ones are pieces' ends.  Aggregated, they hold all counts: a phrase
occurs as often as weight flows out of it, plus its weight at piece ends, so each length's counts are the next longer
ones' summed over their first words, plus the ends of that length.  A phrase all of whose weight goes through one longer
edge is a node on a path that does not branch; it is compacted into that edge.

Words that stand together fewer than `min_count` times are never in one candidate, so pieces may end between them without
any count of a candidate or of its parts changing.  Which pairs those are is told by a bit array of at most 2^FILTER_BITS
bits over the hashes of all frequent pairs and words, whatever the corpus holds; a pair it lets through wrongly is
counted and falls to the threshold later.  All counts that reach a result are of texts, not of hashes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.llm.common import _powers, chunks, discard, lower_ascii, mix64, settle

LONGEST, MIN_COUNT, TOP = 5, 100, 2_000
#: Bits of the pair filter at most (16 MB), and bytes of text a task works on at once.
FILTER_BITS, SLICE_BYTES = 27, 1 << 20
#: Pairs that a task holds before it sums them up.
HELD = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t")] = True
_BASES = tuple(np.uint64(b) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)

ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS f
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, array_to_string(string_split(g, ' ')[:k - 1], ' ') AS phrase, f FROM grams WHERE k > 2
    UNION ALL SELECT lang, array_to_string(string_split(g, ' ')[2:], ' '), f FROM grams WHERE k > 2) GROUP BY ALL),
kept AS (
  SELECT g.* FROM grams g LEFT JOIN longer s ON s.lang = g.lang AND s.phrase = g.g
  WHERE k > 1 AND (most IS NULL OR most < f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.g = array_to_string(string_split(c.g, ' ')[:j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.g = array_to_string(string_split(c.g, ' ')[j + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM cuts)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a longer text is cut at separators, so no piece is cut."""
    for first, _, x, at in chunks(column, SLICE_BYTES):
        while len(at) == 2 and len(x) > SLICE_BYTES:
            cuts = np.flatnonzero(_SEPARATOR[x[:SLICE_BYTES]])
            if not len(cuts):
                cuts = SLICE_BYTES + np.flatnonzero(_SEPARATOR[x[SLICE_BYTES:]])[:1]
            end = int(cuts[-1]) + 1 if len(cuts) else len(x)
            yield first, x[:end], np.array([0, end])
            x, at = x[end:], np.array([0, len(x) - end])
        yield first, x, at


class Words:
    """The words of some texts, lower-cased and laid out with one space after each, so a gram is one span of bytes."""

    def __init__(self, x: np.ndarray, at: np.ndarray):
        inside = ~(_SEPARATOR[x] | _SPACE[x])
        edge = np.zeros(len(x) + 1, bool)
        edge[at] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        start, length = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        length = length - start
        self.row = np.searchsorted(at, start, "right") - 1
        piece = np.cumsum(_SEPARATOR[x])[start] + self.row
        #: Whether the next word stands in the same piece.
        self.joined = piece[1:] == piece[:-1]
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        self.bytes = np.full(int(length.sum()) + len(length), 32, np.uint8)
        self.bytes[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = lower_ascii(x[inside])

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        y, base = self.bytes, _BASES[which]
        total = np.zeros(len(y) + 1, np.uint64)
        np.cumsum((y.astype(np.uint64) + np.uint64(1)) * _powers(base, len(y)), out=total[1:])
        h = (total[end] - total[start]) * _powers(_INVERSES[which], len(y))[start]
        return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        length = end - start
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(length, out=offsets[1:])
        data = self.bytes[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of a batch (text, lang) with each word's language as a number, and the languages' names."""
    codes = batch.column(1).dictionary_encode()
    number = codes.indices.to_numpy(zero_copy_only=False)
    for first, x, at in _slices(batch.column(0)):
        words = Words(x, at)
        yield words, number[first + words.row], codes.dictionary.to_pylist()


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(key, n): how often each word and each pair of neighbours of a language occurs, by hash."""

    def summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for words, lang, names in _read(batch):
                if not len(lang):
                    continue
                seed, i = _seeds(names)[lang], np.flatnonzero(words.joined)
                pairs = words.hashes(words.start[i], words.end[i + 1]) ^ seed[i]
                key, n = np.unique(np.concatenate([words.hashes(words.start, words.end) ^ seed, pairs]), return_counts=True)
                keys, counts, held = [*keys, key], [*counts, n], held + len(key)
                if held > HELD:
                    key, n = summed(keys, counts)
                    if len(key) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        if keys:
            key, n = summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bit array over the keys, two bits a key, as 64-bit words: 2^FILTER_BITS bits at most, so that many bytes / 8 reach
    the driver and the tasks at any size."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(16 * max(1, frequent.count())))))
    mask = (1 << bits) - 1
    places = frequent.select(F.explode(F.array(
        F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    found = places.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    out, mask = np.ones(len(key), bool), np.uint64(len(bits) * 64 - 1)
    for place in (key & mask, (key >> np.uint64(32)) & mask):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _longest_grams(rows: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """(lang, k, gram, n): the longest gram at each word, summed within a task's slices; k = 0 has all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, lang, names in _read(batch):
                if not len(lang):
                    continue
                seed = _seeds(names)[lang]
                linked = np.append(words.joined, False)
                i = np.flatnonzero(linked)
                linked[i] = _passes(bits, words.hashes(words.start[i], words.end[i + 1]) ^ seed[i])
                ends = np.flatnonzero(~linked)
                here = np.arange(len(lang))
                k = np.minimum(longest, ends[np.searchsorted(ends, here)] - here + 1)
                alone = ~linked & ~np.append(False, linked[:-1])
                keep = ~alone
                keep[alone] = _passes(bits, words.hashes(words.start[alone], words.end[alone]) ^ seed[alone])
                here, k = here[keep], k[keep]
                start, end = words.start[here], words.end[here + k - 1]
                one, two = words.hashes(start, end) ^ seed[here], words.hashes(start, end, 1)
                order = np.argsort(one, kind="stable")
                one, two = one[order], two[order]
                # Equal hashes with other bytes between them only split a count; the sums are by text.
                new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(order)]
                cuts = np.flatnonzero(new)
                first, n = order[cuts], np.diff(np.append(cuts, len(order)))
                totals = np.bincount(lang, minlength=len(names))
                seen = np.flatnonzero(totals)
                name = pa.array(names, pa.string())
                yield pa.RecordBatch.from_arrays([
                    name.take(pa.array(np.concatenate([lang[here[first]], seen]))),
                    pa.array(np.concatenate([k[first], np.zeros(len(seen))]).astype(np.int32)),
                    pa.concat_arrays([words.texts(start[first], end[first]), pa.array([""] * len(seen), pa.string())]),
                    pa.array(np.concatenate([n, totals[seen]]).astype(np.int64))], ["lang", "k", "gram", "n"])

    grams = rows.mapInArrow(run, "lang string, k int, gram string, n bigint")
    return grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, text: str, lang: str, min_count: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of all phrases of up to `longest` words with f >= min_count, (lang, n) of all words)."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    frequent = settle(_pair_counts(rows).where(F.col("n") >= min_count).select("key"))
    edges = settle(_longest_grams(rows, _filter(frequent), longest))
    totals = settle(edges.where("k = 0").select("lang", "n"))
    node, parts = edges.where(F.col("k") == longest).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f")), []
    for k in range(longest, 0, -1):
        if k < longest:
            flow = node.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "f")
            ends = edges.where(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))
            summed = settle(flow.union(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
            if k < longest - 1:
                discard(node)
            node = summed
        parts.append(settle(node.where(F.col("f") >= min_count).select("lang", F.lit(k).alias("k"), "phrase", "f")))
    counts = settle(reduce(DataFrame.union, parts))
    discard(node, edges, frequent, *parts)
    return counts, totals


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                      longest: int = LONGEST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words.

    A-Z is lower-cased; pieces end at `.,;:!?` and U+000A to U+000D, words at spaces and tabs; no other white space
    counts as any.  Null texts have no words, a null language is `und`.  f counts all occurrences, overlapping ones
    included, n all words of the language.  Phrases of f >= min_count are candidates; cut after its first words, a
    candidate has l, r = f of both parts and the score floor(1000 * a * n / (l * r)), in exact decimals; the lowest cut
    counts, then the shortest first part.  Candidates within a longer one of the same f are dropped.  Order: score, a
    (both descending), phrase (bytes).  Repeated rows count as often as they stand; other columns are ignored; an empty
    table gives no rows."""
    counts, totals = phrase_counts(docs, text, lang, min_count, longest)
    wide = counts.where("k > 2")
    inside = wide.select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = counts.where("k > 1").join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < f")
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', j)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide19 = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide19('1000 * a')} * {wide19('n')}) div ({wide19('l')} * {wide19('r')})").cast("bigint")
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = settle(ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    discard(counts, totals)
    return out
