"""Remove byte passages that start in an earlier document, by blockwise suffix sorting.

A cover of the text is chosen by content: the position of the least 24-byte hash in every 50-byte
window.  Like a difference cover it gives any two suffixes that share 50 bytes a sample at one common
distance, but at 7 % of the positions instead of the 22 % that residues need (32-periodic cover), and
that is what lets the samples fit the shuffle.  Steps:

1. Equal texts are one text.  The rest lies in blocks, each a row of compressed bytes.
2. Blocks send the distinct hashes of their cover samples; per hash range the ones that stand in two
   documents are marked and sent back as bits.
3. Blocks send the context of each marked sample, equal contexts once, to the hash range of the sample.
   There the suffixes at the samples are sorted and ranked, with the common prefixes of neighbours.
   Then one bucket after the other is sorted: the suffixes that start `o` bytes before their sample, by
   those `o` bytes and then by the sample's rank, which settles every longer tie.  A bucket needs one key
   per suffix, so memory follows the bucket and not the text.  Runs of equal 50-byte prefixes give the
   smallest document.
4. The suffixes that start in an earlier document go back as bits, and the blocks cut their texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import binary, discard, mix64, settle

LENGTH, GRAM = 50, 24
#: Distances from a suffix to its sample.
REACH = LENGTH - GRAM + 1
#: Bytes of text in a block, and bytes of text whose samples meet in one range.
BLOCK_BYTES, RANGE_BYTES = 1 << 19, 1 << 23
_B = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes that start at each position, by doubling: 1, 2, 4, 8, then 8 + 16."""
    h, eight = x.astype(np.uint64) + np.uint64(1), None
    for width in (1, 2, 4, 8):
        h = h[:-width] * _power(width) + h[width:]
        eight = h if width == 4 else eight
    return mix64(h[: len(h) - 8] * _power(8) + eight[16:])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def cover(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples of texts laid end to end: position, hash, text number, and first and last window start it serves."""
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none.astype(np.uint64), none, none, none
    low, off, width = gram_hashes(x), None, 1
    hashes = low
    off = np.zeros(len(low), np.uint8)
    while width < REACH:  # leftmost least hash among the next `width` positions
        step = min(width, REACH - width)
        right = low[step:] < low[:-step]
        off = np.where(right, off[step:] + np.uint8(step), off[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    n = len(x) - LENGTH + 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + LENGTH <= at[1:][doc]
    s = np.flatnonzero(inside)
    p, d = s + off[s], doc[s]
    new = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    p = p[first]
    return p, hashes[p], d[first], s[first], s[last]


class Block:
    """A row of the block table, and what all steps derive from it alike."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, packed: bytes, ranges: int):
        self.ids, self.at = ids, at
        self.x = np.frombuffer(zstandard.decompress(packed, max_output_size=int(at[-1])), np.uint8) if at[-1] else np.zeros(0, np.uint8)
        self.p, self.h, self.doc, self.first, self.last = cover(self.x, at)
        self.distinct, self.which = np.unique(self.h, return_inverse=True)
        # Two documents (not two rows of one) hold the hash.
        owner = self.ids[self.doc]
        low, high = np.full(len(self.distinct), np.iinfo(np.int64).max), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, owner)
        np.maximum.at(high, self.which, owner)
        self.twice = low < high
        self.bounds = np.searchsorted(range_of(self.distinct, ranges), np.arange(ranges + 1))

    def contexts(self, marked: np.ndarray):
        """Marked samples' contexts, equal ones once: hash, matrix, reach before and after, smallest document; and
        the context of each sample."""
        sample = np.flatnonzero(marked[self.which])
        p, before = self.p[sample], self.p[sample] - self.first[sample]
        after = self.last[sample] + LENGTH - p
        column = np.arange(-REACH + 1, LENGTH)
        valid = (column >= -before[:, None]) & (column < after[:, None])
        padded = np.concatenate([np.zeros(REACH - 1, np.uint8), self.x, np.zeros(LENGTH, np.uint8)])
        matrix = np.lib.stride_tricks.sliding_window_view(padded, len(column))[p] * valid
        rows = np.concatenate([self.h[sample].astype(">u8").view(np.uint8).reshape(-1, 8), before[:, None].astype(np.uint8),
                               after[:, None].astype(np.uint8), matrix], axis=1)
        keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.ids[self.doc[sample]])
        return sample, rows[at], which, least


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range number of a hash: ranges are equal parts of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_WIDTH = 10 + REACH - 1 + LENGTH


def _ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and, for each row in that order, the bytes it shares with the one before."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    r = rows[order]
    differ = r[1:] != r[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.append(-1, shared) if len(rows) else shared


def suffix_minima(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per context a 27-bit mask: bit o is set if the suffix o bytes before the sample starts in an earlier document."""
    n = len(rows)
    before, after = rows[:, 8].astype(np.int64), rows[:, 9].astype(np.int64)
    text = rows[:, 10:]
    order, shared = _ranks(np.concatenate([rows[:, :8], text[:, REACH - 1 :]], axis=1))
    shared = shared - 8
    back, back_shared = _ranks(text[:, REACH - 2 :: -1])
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    mask = np.zeros(n, np.uint32)
    for o in range(REACH):
        has = np.flatnonzero((o <= before) & (LENGTH - o <= after))
        if not len(has):
            continue
        right[order] = np.cumsum(shared < LENGTH - o)
        left[back] = np.cumsum(back_shared < o)
        key = left[has] * (n + 1) + right[has]
        sort = np.argsort(key, kind="stable")
        run = np.flatnonzero(np.append(True, key[sort][1:] != key[sort][:-1]))
        least = np.repeat(np.minimum.reduceat(doc[has][sort], run), np.diff(np.append(run, len(has))))
        hit = has[sort][least < doc[has][sort]]
        mask[hit] |= np.uint32(1 << o)
    return mask


def _blocks(texts: DataFrame) -> DataFrame:
    """Rows (block, ids, ends, packed) of about BLOCK_BYTES of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        ids, raw, size = [], [], 0

        def row():
            ends = np.cumsum([len(r) for r in raw])
            name = hashlib.blake2b(np.array([*ids, *ends], np.int64).tobytes(), digest_size=8).digest()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(name, np.int64)), pa.array([np.array(ids, np.int64)], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(raw))], pa.binary())],
                ["block", "ids", "ends", "packed"])

        for batch in batches:
            data, at = binary(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids.append(doc)
                raw.append(data[at[i] : at[i + 1]].tobytes())
                size += len(raw[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, raw, size = [], [], 0
        if ids:
            yield row()

    return texts.mapInArrow(run, "block bigint, ids array<bigint>, ends array<bigint>, packed binary")


def _open(row, ranges: int) -> Block:
    ids, ends = np.array(row["ids"], np.int64), np.array(row["ends"], np.int64)
    return Block(ids, np.append(0, ends), row["packed"], ranges)


def _hash_rows(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, data): per block and range the distinct sample hashes and a byte each: in two documents already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                b = _open(row, ranges)
                parts = [(i, row["block"], b.distinct[a:e].tobytes() + b.twice[a:e].astype(np.uint8).tobytes())
                         for i, (a, e) in enumerate(zip(b.bounds[:-1], b.bounds[1:], strict=True)) if e > a]
                yield _three(parts)

    return blocks.mapInArrow(run, "range int, block bigint, data binary")


def _three(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int64()),
         pa.array([p[2] for p in parts], pa.binary())], ["range", "block", "data"])


def _by_range(rows: DataFrame, work, ranges: int) -> DataFrame:
    """Apply `work` to the rows of each range at once; it returns one answer per row, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for r, block, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != now and held:
                    yield _three([(h[0], h[1], a) for h, a in zip(held, work([h[2] for h in held]), strict=True)])
                    held = []
                now = r
                held.append((r, block, data))
        if held:
            yield _three([(h[0], h[1], a) for h, a in zip(held, work([h[2] for h in held]), strict=True)])

    return rows.repartition(ranges, "range").sortWithinPartitions("range", "block").mapInArrow(run, "range int, block bigint, data binary")


def _mark_shared(parts: list[bytes]) -> list[bytes]:
    """Bits per hash: it stands in two documents, of one block or of two."""
    sizes = [len(p) // 9 for p in parts]
    hashes = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(parts, sizes, strict=True)])
    twice = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for p, n in zip(parts, sizes, strict=True)]).astype(bool)
    order = np.argsort(hashes)
    run = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    length = np.diff(np.append(run, len(order)))
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(np.logical_or.reduceat(twice[order], run) | (length > 1), length)
    return [np.packbits(s).tobytes() for s in np.split(shared, np.cumsum(sizes)[:-1])]


def _sort_suffixes(parts: list[bytes]) -> list[bytes]:
    """27-bit masks per context of every part."""
    raw = [zstandard.decompress(p) for p in parts]
    sizes = [len(r) // (_WIDTH + 8) for r in raw]
    rows = np.concatenate([np.frombuffer(r, np.uint8, n * _WIDTH).reshape(n, _WIDTH) for r, n in zip(raw, sizes, strict=True)])
    doc = np.concatenate([np.frombuffer(r, np.int64, n, n * _WIDTH) for r, n in zip(raw, sizes, strict=True)])
    return [m.tobytes() for m in np.split(suffix_minima(rows, doc), np.cumsum(sizes)[:-1])]


def _with_answers(blocks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """Blocks beside their sorted answers; `work(row)` gives a record batch."""
    told = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("step", "range", "data"))).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield work(batch.slice(i, 1).to_pylist()[0])

    return blocks.join(told, "block", "left").mapInArrow(run, schema)


def _marked(b: Block, row) -> np.ndarray:
    marked = np.zeros(len(b.distinct), bool)
    for a in row["answers"] or []:
        if a["step"] == 1:
            low, high = b.bounds[a["range"]], b.bounds[a["range"] + 1]
            marked[low:high] = np.unpackbits(np.frombuffer(a["data"], np.uint8), count=high - low)
    return marked


def removed_bytes(b: Block, row) -> np.ndarray:
    """Which bytes of a block fall to earlier documents, by the answers of both steps."""
    gone = np.zeros(len(b.x) + 1, np.int64)
    sample, rows, which, least = b.contexts(_marked(b, row))
    bound = np.searchsorted(range_of(rows[:, :8].copy().view(">u8").ravel().astype(np.uint64), len(b.bounds) - 1), np.arange(len(b.bounds)))
    mask = np.zeros(len(rows), np.uint32)
    for a in row["answers"] or []:
        if a["step"] == 2:
            mask[bound[a["range"]] : bound[a["range"] + 1]] = np.frombuffer(a["data"], np.uint32)
    own = b.ids[b.doc[sample]]
    serves = (np.uint64(2) << (b.p[sample] - b.first[sample]).astype(np.uint64)) - (
        np.uint64(1) << (b.p[sample] - b.last[sample]).clip(0).astype(np.uint64))
    bits = np.where(least[which] < own, np.uint64(0xFFFFFFFF), mask[which].astype(np.uint64)) & serves
    for o in range(REACH):
        start = b.p[sample][(bits >> np.uint64(o)) & np.uint64(1) == 1] - o
        np.add.at(gone, start, 1)
        np.add.at(gone, start + LENGTH, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for every row of `docs`.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id;
    strings never cross documents and are judged on the input.  Null text counts as empty; a row
    without a doc_id is whole and takes nothing from others; rows that repeat a doc_id take nothing
    from each other; other columns are ignored; an empty table gives no rows."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), body.alias("body"))
    named = settle(base.select("doc_id", F.sha2("body", 256).alias("sha"), F.length("body").cast("bigint").alias("n_bytes")))
    least = named.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    least = settle(least)
    total = least.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    # Rows of one doc_id whose texts differ are told apart by the text.
    sole = least.where(f"n_bytes >= {LENGTH}").select("doc_id").distinct()
    texts = base.join(sole, "doc_id", "left_semi").select("doc_id", "body")
    blocks = settle(_blocks(texts))
    hashes = _by_range(_hash_rows(blocks, ranges), _mark_shared, ranges)
    marks = settle(hashes.withColumn("step", F.lit(1)))

    def contexts(row) -> pa.RecordBatch:
        b, pack = _open(row, ranges), zstandard.ZstdCompressor(level=1)
        _, rows, _, docs_of = b.contexts(_marked(b, row))
        bound = np.searchsorted(range_of(rows[:, :8].copy().view(">u8").ravel().astype(np.uint64), ranges), np.arange(ranges + 1))
        return _three([(i, row["block"], pack.compress(rows[a:e].tobytes() + docs_of[a:e].tobytes()))
                       for i, (a, e) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if e > a])

    sent = _with_answers(blocks, marks, contexts, "range int, block bigint, data binary")
    masks = settle(_by_range(sent, _sort_suffixes, ranges).withColumn("step", F.lit(2)))

    def cut(row) -> pa.RecordBatch:
        b = _open(row, ranges)
        gone = removed_bytes(b, row)
        out = []
        for doc, a, e in zip(b.ids, b.at[:-1], b.at[1:], strict=True):
            g, x = gone[a:e], b.x[a:e]
            kept = x[~g].tobytes()
            spans = int((g[1:] & ~g[:-1]).sum()) + int(g[0]) if e > a else 0
            out.append((doc, e - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), hashlib.sha256(x.tobytes()).hexdigest(), kept))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns[: len(names)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "sha"] + ["kept"] * keep_text
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, sha string" + ", kept binary" * keep_text
    done = settle(_with_answers(blocks, marks.union(masks), cut, schema))
    discard(blocks, marks, masks)
    done = done.dropDuplicates(["doc_id", "sha"])
    # The rest: copies of an earlier text lose all, if 50 bytes long; short rows and rows without an id lose nothing.
    other = named.join(done.select("doc_id", "sha"), ["doc_id", "sha"], "left_anti")
    gone = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)
    if keep_text:
        bodies = base.select(F.col("doc_id").alias("of"), F.sha2("body", 256).alias("sha_of"), "body").dropDuplicates(["of", "sha_of"])
        other = other.join(bodies, (F.col("sha") == F.col("sha_of")) & F.col("doc_id").eqNullSafe(F.col("of"))).withColumn(
            "kept", F.when(gone, F.lit(b"")).otherwise(F.col("body")))
    other = other.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), *(["kept"] * keep_text))
    # Repeated rows of a document that was cut appear as often as they stand in the input.
    cut_rows = named.drop("n_bytes").join(done, ["doc_id", "sha"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * keep_text))
    return cut_rows.unionByName(other)
