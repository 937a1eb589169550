"""Modified Kneser-Ney model of characters: five at a time, counted and derived in Spark, kept as sorted hash arrays.

An n-gram is a pair of numbers, 21 bits a character: `lo` holds its last three characters, `hi` the two before them and,
above these, the number of its language.  Tasks count the n-grams of whole texts block by block; a block is some text of one
language.  Counts travel packed, one row per block and shard of the n-grams' hashes; Spark adds them up by shard and derives
continuation counts, discounts, probabilities and backoff weights with joins and groupings, down to one score for every n-gram
that the corpus holds.  The scores of a shard are stored as arrays sorted by hash; shards and tables grow with the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import CHUNK_BYTES, chunks, discard, mix64, settle

ORDER, BITS = 5, 21
#: N-grams of two characters and more that stand once are not stored: a text does not vouch for itself.
LEAST_COUNT = 2
#: Bytes of text of one language that are scored together, give or take one text.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are counted at once, and n-grams of such runs that wait to be added up (memory only).
GRAM_BYTES, MERGED_GRAMS = 1 << 19, 1 << 18
#: Characters of the corpus for each shard of the model.
SHARD_CHARS = 32 << 20
_CHAR = (1 << BITS) - 1
_TWO = (1 << 2 * BITS) - 1
_LANG = ((1 << 63) - 1) ^ _TWO
#: What stands before a text: no character.
_START = _CHAR
#: Size of the alphabet that the pair models' pseudo-counts assume.
_ALPHABET = 4096


def points_of(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(x.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def packed_grams(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram (hi, lo) of ORDER characters that ends at each character, and the texts' offsets among them."""
    points = points_of(x).astype(np.int64)
    bounds = np.append(0, np.cumsum((x & 0xC0) != 0x80))[at]

    def back(i: int) -> np.ndarray:
        out = np.full(len(points), _START, np.int64)
        out[i:] = points[: max(len(points) - i, 0)]
        for j in range(i):  # what stands before a text is no character of the one before it
            early = bounds[:-1] + j
            out[early[early < bounds[1:]]] = _START
        out <<= np.int64(BITS * (i % 3))
        return out

    hi = back(3)
    hi |= back(4)
    lo = back(1)
    lo |= back(2)
    lo |= points
    return hi, lo, bounds


def shorter(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k characters of n-grams."""
    return hi & np.int64(_LANG | ((1 << BITS * max(k - 3, 0)) - 1)), lo & np.int64((1 << BITS * min(k, 3)) - 1)


def context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams without their last character."""
    return (hi & np.int64(_LANG)) | ((hi & np.int64(_TWO)) >> BITS), (lo >> BITS) | ((hi & np.int64(_CHAR)) << np.int64(2 * BITS))


def gram_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(mix64(hi.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25) + lo.astype(np.uint64))


def distinct_grams(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None, places: bool = True) -> tuple[np.ndarray, ...]:
    """Distinct (hi, lo), how often each stands (or the sums of `counts`), and the place of every row among them (empty
    unless `places`).  Rows are sorted by their hashes, whose last bits give way to the row's number."""
    n = len(hi)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    keyed = gram_hash(hi, lo)
    keyed &= ~low
    keyed |= np.arange(n, dtype=np.uint64)
    keyed.sort(kind="quicksort" if counts is None else "stable")  # what is added up comes in sorted runs
    order = (keyed & low).astype(np.int64)
    keyed &= ~low
    shi, slo = hi[order], lo[order]
    new = np.ones(n, bool)
    new[1:] = (shi[1:] != shi[:-1]) | (slo[1:] != slo[:-1])
    mixed = new[1:] & (keyed[1:] == keyed[:-1])
    if mixed.any():  # different n-grams share what is left of a hash: these runs are sorted by the n-grams themselves
        run = np.cumsum(np.append(0, keyed[1:] != keyed[:-1]))
        rows = np.flatnonzero(np.isin(run, run[1:][mixed]))
        order[rows] = order[rows][np.lexsort((slo[rows], shi[rows], run[rows]))]
        shi, slo = hi[order], lo[order]
        new[1:] = (shi[1:] != shi[:-1]) | (slo[1:] != slo[:-1])
    del keyed
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, n)) if counts is None or not n else np.add.reduceat(counts[order], starts)
    which = np.empty(n if places else 0, np.int32 if n < 1 << 31 else np.int64)
    if places:
        which[order] = np.cumsum(new, dtype=which.dtype) - 1
    return shi[starts], slo[starts], sums, which


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as differences, byte plane by byte plane, compressed."""
    steps = np.stack([np.diff(c.astype(np.int64), prepend=np.int64(0)) for c in columns])
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))
    return pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes, columns: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, columns * n * 8, asbytes=True), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)
    return np.cumsum(steps, axis=1)


def pair_numbers(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct character pairs (first << BITS | second) of texts laid end to end, their counts, the place of every
    character's pair among them, and the texts' offsets."""
    points = points_of(x)
    bounds = np.append(0, np.cumsum((x & 0xC0) != 0x80))[at]
    before = np.append(_START, points[:-1]).astype(np.int64) if len(points) else points.astype(np.int64)
    before[bounds[:-1][bounds[:-1] < len(points)]] = _START
    chars = np.append(np.flatnonzero(np.bincount(points)), _START)
    code = np.zeros(int(chars[-2]) + 1 if len(chars) > 1 else 1, np.int64)
    code[chars[:-1]] = np.arange(len(chars) - 1)
    first = np.where(before == _START, len(chars) - 1, code[np.minimum(before, len(code) - 1)])
    places = first * len(chars) + code[points]
    if len(chars) <= 2048:  # a dense table of pairs is smaller than a sort
        counts = np.bincount(places, minlength=len(chars) ** 2)
        found = np.flatnonzero(counts)
        counts, dense = counts[found], np.zeros(len(chars) ** 2, np.int64)
        dense[found] = np.arange(len(found))
        which = dense[places]
    else:
        found, which, counts = np.unique(places, return_inverse=True, return_counts=True)
    return chars[found // len(chars)] << BITS | chars[found % len(chars)], counts, which, bounds


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, values[place].astype(np.float64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(keys, return_inverse=True)
    return keys, np.bincount(which, counts, len(keys))


class Languages:
    """Labels in order, and interpolated models of character pairs for each; their size is that of the alphabets."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], fitting: bool = True):
        self.names, self.models = [r[0] for r in rows], []
        self.chars = int(sum(r[2].sum() for r in rows))
        for _, pairs, counts in rows if fitting and len(rows) > 1 else ():
            order = np.argsort(pairs)
            chars, single = _sums(pairs & _CHAR, counts)
            whole = counts.sum() + 0.5 * _ALPHABET
            self.models.append((pairs[order], counts[order], *_sums(pairs >> BITS, counts), chars, (single + 0.5) / whole, 0.5 / whole))

    def fit(self, langs: pa.Array, texts: pa.Array) -> np.ndarray:
        """The number of the language that fits each text best; of its label where none fits better."""
        out = pc.index_in(langs, pa.array(self.names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end, x, at in chunks(texts) if self.models else ():
            pairs, _, which, bounds = pair_numbers(x, at)
            sums = np.empty((len(self.names), end - first))
            for i, (keys, counts, befores, totals, chars, share, rare) in enumerate(self.models):
                n, total = find(keys, counts, pairs), find(befores, totals, pairs >> BITS)
                one = find(chars, share, pairs & _CHAR)
                value = np.log((np.where(n[0], n[1], 0) + 5 * np.where(one[0], one[1], rare)) / (np.where(total[0], total[1], 0) + 5))
                sums[i] = np.diff(np.append(0, np.cumsum(value[which]))[bounds])
            best, row = sums.argmax(axis=0), np.arange(end - first)
            better = sums[best, row] > sums[out[first:end], row]
            out[first:end][better] = best[better]
        return out


def learn_languages(docs: DataFrame, fitting: bool = True) -> Languages:
    """Pair models of the labels of rows (lang, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                have = held.setdefault(lang, Counter())
                for _, _, x, at in chunks(batch.column(1).filter(pc.equal(batch.column(0), lang))):
                    pairs, counts, _, _ = pair_numbers(x, at)
                    have.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        for lang, have in held.items():
            pairs = [None, *have.keys()]  # a label without any character is one too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), pa.array(pairs, pa.int64()),
                                              pa.array([0, *have.values()], pa.int64())], ["lang", "pair", "n"])

    table = docs.mapInArrow(run, "lang string, pair bigint, n bigint").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toArrow()
    rows = []
    for lang in sorted(pc.unique(table.column(0)).to_pylist()):
        part = table.filter(pc.and_(pc.equal(table.column(0), lang), pc.is_valid(table.column(1))))
        rows.append((lang, part.column(1).to_numpy(), part.column(2).to_numpy()))
    return Languages(rows, fitting)


class Dealer:
    """Deals the rows of a partition to blocks, in their order: a block holds one language and BLOCK_BYTES."""

    def __init__(self, languages: Languages):
        self.partition, self.languages, self.bytes = TaskContext.get().partitionId(), languages, {}

    def deal(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """(language, block, rows) of a batch whose first columns are the label and the text."""
        langs = self.languages.fit(batch.column(0), batch.column(1))
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lang in np.unique(langs).tolist():
            at = np.flatnonzero(langs == lang)
            number, before = self.bytes.setdefault(lang, (len(self.bytes), 0))
            ends = before + np.cumsum(size[at])
            self.bytes[lang] = number, int(ends[-1])
            part = (ends - size[at]) // BLOCK_BYTES
            for i in np.unique(part):
                yield lang, self.partition << 40 | number << 20 | int(i), batch.take(pa.array(at[part == i]))


class Block:
    """The distinct n-grams of a block's texts, shard by shard and in order within; the same texts give the same order."""

    def __init__(self, lang: int, shards: int, places: bool = True):
        self.lang, self.shards, self.wanted, self.parts = lang, shards, places, []

    def add(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and end row, bytes, offsets and offsets in characters of each chunk that is added."""
        for first, end, x, at in chunks(texts, CHUNK_BYTES if self.wanted else GRAM_BYTES):
            hi, lo, bounds = packed_grams(x, at)
            hi |= np.int64(self.lang << 2 * BITS)
            self.parts.append(distinct_grams(hi, lo, places=self.wanted))
            del hi, lo
            if not self.wanted and sum(len(p[0]) for p in self.parts[1:]) > max(len(self.parts[0][0]), MERGED_GRAMS):
                self.parts = [distinct_grams(*self._joined(), places=False)]
            yield first, end, x, at, bounds

    def _joined(self) -> list[np.ndarray]:
        return [np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(3)]

    def close(self) -> None:
        """Set hi, lo, n, the shards' offsets, and for each chunk the place of every character's n-gram, if wanted."""
        hi, lo, n, which = distinct_grams(*self._joined(), places=self.wanted)
        shard = (gram_hash(hi, lo) % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((lo, hi, shard))
        self.hi, self.lo, self.n = hi[order], lo[order], n[order]
        self.offsets = np.searchsorted(shard[order], np.arange(self.shards + 1))
        if not self.wanted:
            return
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cuts = np.cumsum([0] + [len(p[0]) for p in self.parts])
        self.places = [(place[which[a:b]], p[3]) for a, b, p in zip(cuts[:-1], cuts[1:], self.parts, strict=True)]

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        for shard in np.flatnonzero(np.diff(self.offsets)).tolist():
            part = slice(self.offsets[shard], self.offsets[shard + 1])
            yield shard, part.stop - part.start, pack(self.hi[part], self.lo[part], self.n[part])


COUNTED = "shard int, block bigint, n int, grams binary"


def count_grams(docs: DataFrame, languages: Broadcast, shards: int) -> DataFrame:
    """COUNTED rows over all characters of rows (lang, text, ...): the packed n-grams and counts of a block and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, Block]] = {}
        dealer = Dealer(languages.value)
        for batch in batches:
            for lang, number, rows in dealer.deal(batch):
                if lang in held and held[lang][0] != number:
                    yield from out(*held.pop(lang))
                block = held.setdefault(lang, (number, Block(lang, shards, places=False)))[1]
                for _ in block.add(rows.column(1)):
                    pass
        for number, block in held.values():
            yield from out(number, block)

    def out(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        block.close()
        rows = list(block.rows())
        for i in range(0, len(rows), 1_000):
            at, n, grams = zip(*rows[i : i + 1_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([number] * len(at), pa.int64()),
                                              pa.array(n, pa.int32()), pa.array(grams, pa.binary())], ["shard", "block", "n", "grams"])

    return docs.mapInArrow(run, COUNTED)


def _sum_shard(rows: pa.Table) -> pa.Table:
    """The n-grams (shard, hi, lo, n) of all COUNTED rows of a shard."""
    parts = [unpack(g, 3, n) for n, g in zip(rows.column("n").to_pylist(), rows.column("grams").to_pylist(), strict=True)]
    hi, lo, n, _ = distinct_grams(*np.concatenate(parts, axis=1), places=False)
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()] * len(hi), pa.int32()), "hi": hi, "lo": lo, "n": n})


def _shard_arrays(rows: pa.Table) -> pa.Table:
    """One row: the n-grams of a shard in the order of their hashes, and their scores."""
    hi, lo = rows.column("hi").to_numpy(), rows.column("lo").to_numpy()
    order = np.argsort(gram_hash(hi, lo))
    return pa.table({"shard": rows.column("shard").slice(0, 1), "n": pa.array([len(hi)], pa.int32()),
                     "grams": pa.array([pack(hi[order], lo[order])], pa.binary()),
                     "scores": pa.array([rows.column("score").to_numpy()[order].astype(np.float32).tobytes()], pa.binary())})


def _look_up(model: pa.Table, blocks: pa.Table) -> pa.Table:
    """The scores of each block's n-grams of a shard, in the block's order."""
    out = []
    if blocks.num_rows:
        hi, lo = unpack(model.column("grams")[0].as_py(), 2, model.column("n")[0].as_py())
        scores, keys = np.frombuffer(model.column("scores")[0].as_py(), np.float32), gram_hash(hi, lo)
        for n, grams in zip(blocks.column("n").to_pylist(), blocks.column("grams").to_pylist(), strict=True):
            mine = unpack(grams, 3, n)
            place = np.searchsorted(keys, gram_hash(mine[0], mine[1]))
            while True:  # the next one where n-grams share a hash
                off = (hi[place] != mine[0]) | (lo[place] != mine[1])
                if not off.any():
                    break
                place[off] += 1
            out.append(scores[place].tobytes())
    return pa.table({"block": blocks.column("block").cast(pa.int64()), "shard": blocks.column("shard").cast(pa.int32()), "scores": pa.array(out, pa.binary())})


def score_blocks(counted: DataFrame, scores: DataFrame) -> DataFrame:
    """(block, shard, scores) for COUNTED rows."""
    arrays = scores.groupBy("shard").applyInArrow(_shard_arrays, "shard int, n int, grams binary, scores binary")
    return arrays.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(_look_up, "block bigint, shard int, scores binary")


class Model:
    """`scores` (shard, hi, lo, score) of every n-gram of ORDER characters that the rows hold; where they were asked for, per
    order the stored n-grams (hi, lo, p) and backoff weights (hi, lo, w) behind them."""

    def __init__(self, scores: DataFrame, names: list[str], kept: dict[str, DataFrame]):
        self.scores, self.names, self.kept = scores, names, kept
        self._values: dict | None = None

    def discard(self) -> None:
        discard(self.scores, *self.kept.values())

    def log_probability(self, lang: str, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Log probability of the last character of any n-grams after the ones before it.

        Collects the tables, to look into small models; scoring reads the shards instead."""
        if self._values is None:
            self._values = {name: {(r[0], r[1]): r[2] for r in t.collect()} for name, t in self.kept.items()}
        code = self.names.index(lang) << 2 * BITS
        out = np.zeros(len(hi))
        for i, gram in enumerate(zip((hi | np.int64(code)).tolist(), lo.tolist(), strict=True)):
            for k in range(ORDER, 0, -1):
                part = tuple(int(v) for v in shorter(np.int64(gram[0]), np.int64(gram[1]), k))
                if part in self._values[f"grams{k}"]:
                    out[i] += self._values[f"grams{k}"][part]
                    break
                if k > 1:
                    out[i] += self._values[f"backoff{k}"].get(tuple(int(v) for v in context(np.int64(part[0]), np.int64(part[1]))), 0.0)
            else:
                out[i] += self._values["unknown"][code, 0]
        return out


def train_model(docs: DataFrame) -> Model:
    """Modified Kneser-Ney model of the rows (lang, text), each under its label, with its tables."""
    docs = docs.select("lang", "text")
    languages = learn_languages(docs, fitting=False)
    counted = settle(count_grams(docs, docs.sparkSession.sparkContext.broadcast(languages), 1))
    model = derive_model(counted, languages.names, keep=True)
    discard(counted)
    return model


def derive_model(counted: DataFrame, names: list[str], keep: bool = False) -> Model:
    """The model of COUNTED rows.  Tables of an order go as soon as the next order no longer needs them."""
    gram = ["hi", "lo"]
    lang = F.col("hi").bitwiseAND(_LANG)
    tail = lambda k: [F.col("hi").bitwiseAND(_LANG | ((1 << BITS * max(k - 3, 0)) - 1)),
                      F.col("lo").bitwiseAND((1 << BITS * min(k, 3)) - 1)]
    before = [lang.bitwiseOR(F.shiftright(F.col("hi").bitwiseAND(_TWO), BITS)),
              F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(_CHAR), 2 * BITS))]
    both = lambda pair, *names: [c.alias(n) for c, n in zip(pair, names, strict=True)]
    tables = {ORDER: settle(counted.groupBy("shard").applyInArrow(_sum_shard, "shard int, hi bigint, lo bigint, n bigint").withColumn("plain", F.col("n")))}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before them; plain counts decide what is stored
        tables[k] = settle(tables[k + 1].groupBy(*both(tail(k), "hi", "lo")).agg(F.count("*").alias("n"), F.sum("plain").alias("plain")))
    kept, lower = {}, None
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("lang", lang)
        of = t.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("v"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.greatest(
            F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(0.1)), F.lit(i - 0.1))).otherwise(F.lit(0.5 * i))
            for i in (1, 2, 3)]
        of = of.select("lang", "v", *[c.alias(f"d{i}") for i, c in enumerate(d, 1)])
        t = t.join(of, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.select("*", *both(before, "chi", "clo"), *both(tail(k - 1), "shi", "slo"))
        of_context = t.groupBy("chi", "clo").agg(F.sum("n").alias("all"), F.sum("d").alias("mass"))
        t = t.join(of_context, ["chi", "clo"])
        if k == 1:
            t = t.withColumns({"lower": 1 / (F.col("v") + 1), "below": F.lit(0.0)})
        else:
            t = t.join(lower.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("lower"), F.col("score").alias("below")),
                       ["shi", "slo"])
        p = (F.col("n") - F.col("d")) / F.col("all") + F.col("mass") / F.col("all") * F.col("lower")
        shard = ["shard"] if k == ORDER else []
        t = settle(t.select(*shard, *gram, "lang", "plain", p.alias("p"), "lower", "below", (F.col("mass") / F.col("all") / (F.col("v") + 1)).alias("u")))
        discard(tables[k], *([lower] if k > 1 else []))
        stored = F.lit(True) if k == 1 else F.col("plain") >= LEAST_COUNT
        if keep:
            kept[f"grams{k}"] = settle(t.where(stored).select(*gram, F.log("p")))
        if k == 1:
            score = F.log("p")
            if keep:
                kept["unknown"] = settle(t.groupBy("lang").agg(F.log(F.max("u")).alias("u")).select("lang", F.lit(0), "u"))
            scored = t
        else:
            backoff = t.where(stored).groupBy(*both(before, "chi", "clo")).agg(F.sum("p").alias("own"), F.sum("lower").alias("low")).select(
                "chi", "clo", F.log(F.greatest(1 - F.col("own"), F.lit(1e-9)) / F.greatest(1 - F.col("low"), F.lit(1e-9))).alias("w"))
            if keep:
                kept[f"backoff{k}"] = settle(backoff)
            scored = t.select("*", *both(before, "chi", "clo")).join(backoff, ["chi", "clo"], "left")
            score = F.when(stored, F.log("p")).otherwise(F.coalesce("w", F.lit(0.0)) + F.col("below"))
        lower = settle(scored.select(*shard, *gram, *([] if shard else ["p"]), score.alias("score")))
        discard(t)
    return Model(lower, names, kept)
