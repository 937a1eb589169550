"""Near-duplicate documents by MinHash bands, odd sketches and exact sets.

One pass over the texts makes 128 MinHash samples per distinct shingle set.  Four samples make a band
key; all 128 fold into an odd sketch, a 512-bit map in which every sample flips one bit, so the bits
set in the XOR of two sketches tell how many samples differ.  Documents that share a band key are
judged by their sketches inside the key's task; a task gives a spanning forest of the likeliest pairs,
never all pairs.  Links are confirmed on whole sets, best pairs first, and pairs whose ends are already
linked are left out.  A last sweep judges, inside the tiles, every pair that is still plausible between
two groups, so forests only save work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import chunks, components, discard, lower_ascii, mix64, settle, word_hashes, word_spans

SHINGLE_WORDS = 5
SAMPLES, BAND_ROWS = 128, 4
SKETCH_BITS = 512
#: Similarity percent that links, and the estimate from which a pair is worth confirming: fewer links fall below it than share no band.
LINK_PERCENT, PLAUSIBLE = 75, 0.52
#: Members that one task compares; larger bands are compared tile by tile, every pair of tiles.
TILE = 2_000
#: Rounds that confirm the best pair of each group before the last sweep.
BEST_ROUNDS = 3

_MULTIPLIERS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts laid end to end, sorted per text, and the n + 1 offsets."""
    x = lower_ascii(x)
    starts, ends, first = word_spans(x, at)
    words = word_hashes(x, starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    out, bounds, k = [], [0], np.uint64(0x9FB21C651E98DF25)
    whole = words[: max(0, len(words) - SHINGLE_WORDS + 1)].copy()
    for i in range(1, SHINGLE_WORDS):
        whole = whole * k + words[i : i + len(whole)]
    whole = mix64(whole)
    for a, n, size in zip(first[:-1], counts, sizes, strict=True):
        if n >= SHINGLE_WORDS:
            s = np.sort(whole[a : a + size])
            s = s[np.append(True, s[1:] != s[:-1])]
        else:  # the whole sequence is the one shingle
            s = np.zeros(size, np.uint64)
            for w in words[a : a + n]:
                s = s * k + w
            s = mix64(s + np.uint64(n))
        out.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bounds)


def samples(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) smallest hashes of non-empty sets."""
    mins = np.empty((SAMPLES, len(bounds) - 1), np.uint64)
    for first in range(0, len(bounds) - 1, 64):  # pieces that stay in the cache
        cut = bounds[first : first + 65]
        x = shingles[cut[0] : cut[-1]]
        for i, a in enumerate(_MULTIPLIERS):
            mins[i, first : first + len(cut) - 1] = np.minimum.reduceat((x * a) >> np.uint64(32), cut[:-1] - cut[0])
    return mins.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), SAMPLES // BAND_ROWS), np.uint64)
    for r in range(BAND_ROWS):
        keys = mix64(keys * np.uint64(0x9FB21C651E98DF25) + mins[:, r::BAND_ROWS] + np.uint64(1))
    return mix64(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 8) bytes: a bit is set if an odd number of (place, sample) pairs fall on it."""
    bit = mix64(mins + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(33))) % np.uint64(SKETCH_BITS)
    cell = np.arange(len(mins), dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)
    odd = np.bincount(cell.ravel(), minlength=len(mins) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(mins), SKETCH_BITS), axis=1)


#: Similarity estimate by the number of bits in which two odd sketches differ.
_ESTIMATE = 1 + SKETCH_BITS * np.log(np.maximum(1 - 2 * np.arange(SKETCH_BITS + 1) / SKETCH_BITS, 1e-9)) / (4 * SAMPLES)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity estimates of sketches given as rows of 64-bit words."""
    return _ESTIMATE[np.bitwise_count(one ^ many).sum(axis=-1)]


def signatures(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """doc_id, n_shingles, set_hash, keys, sketch per row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x, at in chunks(batch.column(1)):
                shingles, bounds = shingle_sets(x, at)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                hashes, keys, sketches = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    mins = samples(shingles, bounds[np.append(full, len(sizes))])
                    for i, k, s in zip(full, band_keys(mins), odd_sketches(mins), strict=True):
                        hashes[i] = hashlib.blake2b(shingles[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                        keys[i], sketches[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["doc_id", "n_shingles", "set_hash", "keys", "sketch"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_hash binary, keys array<bigint>, sketch binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes as bytes, of the rows (text, hashes, ids) whose set hash is among
    `hashes`; doc_id is the one of `ids` beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, end, x, at in chunks(batch.column(0)):
                shingles, bounds = shingle_sets(x, at)
                ids, sets = [], []
                for i in range(end - first):
                    found = shingles[bounds[i] : bounds[i + 1]].tobytes()
                    name = hashlib.blake2b(found, digest_size=16).digest()
                    if name in hashes[first + i]:
                        ids.append(numbers[first + i][hashes[first + i].index(name)])
                        sets.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.select("text", "hashes", "ids").mapInArrow(run, "doc_id bigint, shingles binary")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal leading columns from sorted batches; a run may cross batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), bool)
        new[0] = True
        for k in now[:n_keys]:
            new[1:] |= k[1:] != k[:-1]
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[a:b] for c in now]
        held = [c[cuts[-1] :] for c in now]
    if held is not None:
        yield held


def _forest(ids: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the likeliest spanning forest over plausible pairs, grown one member at a time."""
    best, near = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
    out = np.zeros(len(ids), bool)
    a, b, e = [], [], []
    now = 0
    for _ in range(len(ids) - 1):
        out[now] = True
        est = estimates(sketch[now], sketch)
        closer = est > best
        best[closer], near[closer] = est[closer], now
        now = int(np.argmax(np.where(out, -np.inf, best)))
        if best[now] >= PLAUSIBLE:
            a.append(near[now])
            b.append(now)
            e.append(best[now])
    return ids[np.array(a, np.int64)], ids[np.array(b, np.int64)], np.array(e)


def _forest_edges(members: DataFrame) -> DataFrame:
    """(a, b, estimate) with a < b: the likeliest spanning forest of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _, _, _, ids, sketches in _groups(batches, 3):
            if len(ids) > 1:
                held.append(_forest(ids, np.frombuffer(b"".join(sketches), np.uint64).reshape(len(ids), -1)))
            if sum(len(h[0]) for h in held) > 10_000:
                yield table(held)
                held = []
        if held:
            yield table(held)

    def table(held):
        a, b, e = (np.concatenate([h[i] for h in held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()),
                                           pa.array(e, pa.float64())], ["a", "b", "estimate"])

    rows = _by_tile(members, ["key", "ti", "tj", "doc_id", "sketch"]).mapInArrow(run, "a bigint, b bigint, estimate double")
    return rows.where("a <> b").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def _by_tile(members: DataFrame, columns: list[str]) -> DataFrame:
    return members.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "doc_id").select(columns)


def _sweep(members: DataFrame) -> DataFrame:
    """(a, b): links between components that no forest held.

    A tile judges every plausible pair of two components on the whole sets that its members bring,
    until the two are joined there; a pair that shares several bands is judged in the first of them.
    Only links leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, ids, sketches, label, sets, keys in _groups(batches, 3):
            words = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(ids), -1)
            sets, keys = [np.frombuffer(s, np.uint64) for s in sets], np.stack(keys)
            band = int((keys == key[0]).any(axis=0).argmax())
            a, b, label = [], [], label.copy()
            for i in range(len(ids) - 1):
                others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                others = others[estimates(words[i], words[others]) >= PLAUSIBLE]
                others = others[(keys[others, :band] != keys[i, :band]).all(axis=1)]
                for j in others:
                    if label[i] != label[j] and is_link(sets[i], sets[j]):
                        label[label == label[j]] = label[i]
                        a.append(ids[i])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["key", "ti", "tj", "doc_id", "sketch", "label", "shingles", "keys"]
    return _by_tile(members, columns).mapInArrow(run, "a bigint, b bigint").distinct()


def is_link(p: np.ndarray, q: np.ndarray) -> bool:
    """The exact test on two sorted sets of distinct shingles."""
    if min(len(p), len(q)) * 100 < LINK_PERCENT * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LINK_PERCENT * (len(p) + len(q) - shared)


def _tiles(reps: DataFrame) -> DataFrame:
    """(key, ti, tj, doc_id): the members of every band key with two or more, cut into pairs of tiles."""
    rows = reps.select("doc_id", F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "key").withColumn("g", F.expr(f"cast(ceil(n / {TILE}) as int)"))
    own = rows.withColumn("t", F.pmod(F.xxhash64("doc_id"), "g").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least("t", o).alias("ti"), F.greatest("t", o).alias("tj")))
    # A tile meets itself only where it is alone; elsewhere every pair of tiles holds both.
    others = F.filter(others, lambda s: (F.col("g") == 1) | (s["ti"] != s["tj"]))
    return own.select("key", "doc_id", F.explode(others).alias("s")).select("key", "s.ti", "s.tj", "doc_id")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with `linked`, judged on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [is_link(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64))
                      for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("p"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("q"))
    judged = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(
        run, "a bigint, b bigint, linked boolean")
    return judged.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _labelled(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """Pairs between different components with the labels la, lb of their ends."""
    if label is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    one = label.select(F.col("id").alias("a"), F.col("component_id").alias("la"))
    two = label.select(F.col("id").alias("b"), F.col("component_id").alias("lb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").withColumns(
        {"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")


def link_documents(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Sets hold distinct five-word shingles of the text with A-Z in lower case, the whole sequence where
    there are fewer words; texts without words have an empty set and link with nothing.  Documents
    link where 100 * intersection >= 75 * union.  Rows that repeat a doc_id are one document.  A null
    doc_id links with nothing: its component_id is null and it is kept.  Other columns are ignored; an
    empty table gives no rows."""
    made = settle(signatures(docs, text, id_column))
    # Equal sets are one class and enter the search once.  A set has a number of its own, under the name doc_id below, as
    # rows of one doc_id may hold several sets.
    same = made.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    same = settle(same.withColumn("set_id", F.monotonically_increasing_id()))
    full = made.where("doc_id is not null").join(same, "set_hash")
    reps = settle(full.where("doc_id = rep").groupBy(F.col("set_id").alias("number")).agg(
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).withColumnRenamed("number", "doc_id"))
    tiles = settle(_tiles(reps))
    sketches = reps.select("doc_id", "sketch", "keys")
    forest = settle(_forest_edges(tiles.join(sketches, "doc_id")))
    ends = tiles.select(F.col("doc_id").alias("set_id")).distinct()
    ends = same.join(ends, "set_id", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("set_hash", "set_id")).alias("sets"))
    wanted = docs.select(F.col(id_column).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text")).join(ends, "rep").select(
        "text", F.col("sets.set_hash").alias("hashes"), F.col("sets.set_id").alias("ids"))
    sets = settle(full_sets(wanted))
    links = reps.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    open_, label, judged = forest, None, None
    for _ in range(BEST_ROUNDS):
        side = lambda here: open_now.select(F.col(here).alias("at"), F.struct("estimate", "a", "b").alias("s"))  # noqa: E731, B023
        open_now = _labelled(open_, label)
        best = side("la").union(side("lb")).groupBy("at").agg(F.max("s").alias("s")).select("s.*").distinct()
        now = settle(_confirm(best, sets))
        judged = now if judged is None else judged.union(now)
        links = judged.where("linked").select("a", "b")
        label = components(links)
        open_ = open_.join(judged, ["a", "b"], "left_anti")
    one = tiles.join(label.select(F.col("id").alias("doc_id"), F.col("component_id").alias("label")), "doc_id", "left").withColumn(
        "label", F.coalesce("label", "doc_id"))
    mixed = one.groupBy("key", "ti", "tj").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "ti", "tj")
    left = one.join(mixed, ["key", "ti", "tj"], "left_semi").join(sketches, "doc_id").join(sets, "doc_id")
    links = judged.where("linked").select("a", "b").union(settle(_sweep(left)))
    # Rows of one doc_id with several sets belong together, as do all documents of one set.
    several = full.groupBy("doc_id").agg(F.min("set_id").alias("b"), F.max("set_id").alias("y")).where("b <> y").select("doc_id", "b")
    links = links.union(full.join(several, "doc_id").select(F.col("set_id").alias("a"), "b"))
    label = components(links)
    # A component is named after its least document.
    same = same.join(label, F.col("set_id") == F.col("id"), "left").withColumn("part", F.coalesce("component_id", "set_id"))
    names = same.groupBy("part").agg(F.min("rep").alias("least"))
    named = same.select("set_hash", "part").join(names, "part").select("set_hash", "least")
    out = made.join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    discard(tiles, forest, sets)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
