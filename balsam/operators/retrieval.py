"""Retrieval of supporting documents: exact keys first, vectors where no key matches.

Documents: row, ingredient_kor_name, ingredient_eng_name, cas_no, synonym, content, source and
(for vectors) vector.  Relevance is the cosine of the two vectors."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.settle import settle
from ..functions.text import let
from .windows import keep_first, top_k

# Score of an exact hit by the first field that equals the query, in this order.
FIELD_SCORES = (
    ("ingredient_kor_name", 100), ("ingredient_eng_name", 95), ("synonym", 90), ("cas_no", 90),
)
RELEVANCE_THRESHOLD = 0.75
CANDIDATE_K = 8
CONTEXT_DOCS = 10


def exact_index(docs: DataFrame, k: int) -> DataFrame:
    """(key, row, match_score, rank): the k best documents of every key.

    Rank depends on the key alone, so a key shared by very many documents is cut to k rows here,
    before any query meets it.  A document whose fields share a key keeps the first field."""
    fields = F.array(*[
        F.struct(keys.retrieval_key(c).alias("key"), F.lit(s).alias("match_score"))
        for c, s in FIELD_SCORES
    ])
    first = let(F.transform("__f", lambda f: f["key"]), lambda names: F.filter(
        "__f", lambda f, i: (f["key"] != "") & (F.array_position(names, f["key"]) == i + 1)))
    entries = (
        docs.select("row", fields.alias("__f")).select("row", F.explode(first).alias("__e"))
        .select("row", "__e.*")
    )
    return top_k(entries, "key", [F.desc("match_score"), "row"], k, rank_col="rank")


def exact_retrieve(queries: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, row, match_score, rank) of documents with a field equal to the query."""
    keyed = queries.select("query_id", keys.retrieval_key("query").alias("key")).filter("key <> ''")
    return keyed.join(exact_index(docs, k), "key").select(
        "query_id", "row", F.col("match_score").cast("double").alias("match_score"), "rank",
        F.lit("exact_match").alias("retrieval_type"),
    )


# --- vectors ---------------------------------------------------------------------------------

def _unit(c: Column) -> Column:
    return let(F.transform(c, lambda x: x.cast("double")), lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
        lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))


def _units(df: DataFrame, key: str) -> DataFrame:
    """Unit vectors; rows whose vector is null, zero or not finite have no direction and drop out."""
    units = df.select(key, _unit(F.col("vector")).alias("unit"))
    return units.filter(F.exists("unit", lambda x: x != 0) & ~F.exists("unit", F.isnan))


# The tree of pivots is fitted on this many documents at most; bounds are taken over all of them.
SAMPLE = 4096
# Pivots of each of the two levels: at most FANOUT * FANOUT leaves, whatever the number of documents.
FANOUT = 24
# A leaf of more than one block is cut into rings of about equal numbers of documents by their angle to its pivot.
RINGS = 8
# Bytes of vectors that meet at once, bytes of them in one row (larger rows fill an executor's heap before they are
# collected), and the queries of a pack that are scored at a time.
PACK_BYTES = 8 << 20
ROW_BYTES = 256 << 10
SCORE_ROWS = 256
# Neighbouring documents whose best score stands for them when the k-th best score of a query is bounded.
GROUP = 32


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots taken from the points: each next one is the farthest from those before it."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(n, len(points)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
    return points[chosen]


class PivotTree:
    """Two levels of pivots: `roots`, and the `leaves` under each, numbered through in order."""

    def __init__(self, sample: np.ndarray, fanout: int = FANOUT):
        self.roots = _spread(sample, fanout)
        near = (sample @ self.roots.T).argmax(axis=1)
        under = [_spread(sample[near == r], fanout) for r in range(len(self.roots))]
        self.leaves = np.vstack(under)
        self.first = np.concatenate(([0], np.cumsum([len(u) for u in under])))
        self.parent = np.repeat(np.arange(len(under)), [len(u) for u in under])

    def place(self, x: np.ndarray):
        """Leaf of every vector and its angles to the root's and the leaf's pivot."""
        to_roots = x @ self.roots.T
        root = to_roots.argmax(axis=1)
        to_leaves = np.where(self.parent[None, :] == root[:, None], x @ self.leaves.T, -2.0)
        leaf = to_leaves.argmax(axis=1)
        at = np.arange(len(x))
        return leaf, _angle(to_roots[at, root]), _angle(to_leaves[at, leaf])


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema, *T.StructType.fromDDL(more)])


def _fit_tree(docs: DataFrame, fanout: int) -> PivotTree | None:
    """Tree from the documents of least hash; a table of few documents gives all of them."""
    sample = docs.select("unit").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()
    return PivotTree(np.stack(sample["unit"].to_numpy()), fanout) if len(sample) else None


class Index(NamedTuple):
    """Documents with their block, and the blocks with their interval of angles."""

    tree: PivotTree | None
    docs: DataFrame  # row, unit, block
    blocks: DataFrame  # leaf, block, lo, hi: angles to the leaf's pivot
    bounds: dict[int, tuple[float, float, float]]  # leaf: least and largest angle to the root, largest to the leaf


def vector_index(docs: DataFrame, block_rows: int = 4096) -> Index:
    """Put every document into a block of one ring of one leaf.

    A ring of more than `block_rows` documents (equal vectors, say) is dealt to several blocks by
    hash.  The driver holds the tree and three numbers a leaf; both are bounded by the fan-out."""
    units = _units(docs, "row")
    # Sixteen leaves for every full block of documents, so that small tables are not cut into crumbs.
    tree = _fit_tree(units, int(np.clip(np.sqrt(16 * docs.count() / block_rows), 2, FANOUT)))
    if tree is None:
        return Index(None, units.withColumn("block", F.lit("")), units.select("row").limit(0), {})

    def place(batches):
        for batch in batches:
            if len(batch):
                leaf, far, near = tree.place(np.stack(batch["unit"].to_numpy()))
                yield batch.assign(leaf=leaf.astype(np.int32), root_angle=far, angle=near)

    placed = settle(units.mapInPandas(
        place, _with(units, "leaf int, root_angle double, angle double")))
    shares = [i / RINGS for i in range(1, RINGS)]
    leaves = placed.groupBy("leaf").agg(
        F.percentile_approx("angle", shares).alias("cuts"), F.count("*").alias("n"), F.min("root_angle").alias("root_lo"),
        F.max("root_angle").alias("root_hi"), F.max("angle").alias("radius")).collect()
    cuts = placed.sparkSession.createDataFrame([(x.leaf, x.cuts if x.n > block_rows else []) for x in leaves], "leaf int, cuts array<double>")
    ringed = placed.join(F.broadcast(cuts), "leaf").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("angle"))))
    rings = ringed.groupBy("leaf", "ring").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.ceil(F.count("*") / block_rows).cast("int").alias("pieces"))
    name = lambda piece: F.concat_ws(":", "leaf", "ring", piece)
    blocks = settle(rings.select("leaf", "ring", "lo", "hi", "pieces"))
    dealt = ringed.join(blocks.select("leaf", "ring", "pieces"), ["leaf", "ring"]).select(
        "row", "unit", name(F.pmod(F.xxhash64("row"), "pieces")).alias("block"))
    pieces = blocks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "leaf", "lo", "hi", name(F.col("piece")).alias("block"))
    return Index(tree, dealt, pieces, {x.leaf: (x.root_lo, x.root_hi, x.radius) for x in leaves})


def _rows_of(size: int, index: Index) -> int:
    """Vectors of the index in so many bytes."""
    return max(1, size // (8 * index.tree.roots.shape[1]))


def query_packs(queries: DataFrame, index: Index, threshold: float, per: int) -> DataFrame:
    """(pack, ids, vectors, leaves): queries of about one place in packs of up to `per`, with the leaves they may visit.

    A pack is one row or more of ROW_BYTES at most, however few rows a Python worker gets at once.

    By the triangle inequality on angles a document within `limit` of a query has an angle to any
    pivot within `limit` of the query's.  That rules out leaves by the root's pivot and by their
    own; of each leaf left, the least and largest angle of a visiting query to its pivot are kept."""
    units = _units(queries, "query_id")
    kind = queries.schema["query_id"].dataType.simpleString()
    tree, limit, piece = index.tree, float(np.arccos(threshold)) + 1e-7, _rows_of(ROW_BYTES, index)
    leaves = np.array(sorted(index.bounds), dtype=np.int64)
    lo, hi, radius = (np.array([index.bounds[x][i] for x in leaves]) for i in range(3))

    def place(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.place(np.stack(batch["unit"].to_numpy()))[0].astype(np.int32))

    def visited(x):
        least, most = np.full(len(leaves), np.inf), np.full(len(leaves), -np.inf)
        for i in range(0, len(x), SCORE_ROWS):
            part = x[i : i + SCORE_ROWS]
            root, leaf = _angle(part @ tree.roots.T)[:, tree.parent[leaves]], _angle(part @ tree.leaves[leaves].T)
            seen = (root >= lo - limit) & (root <= hi + limit) & (leaf <= radius + limit)
            least = np.minimum(least, np.where(seen, leaf, np.inf).min(axis=0))
            most = np.maximum(most, np.where(seen, leaf, -np.inf).max(axis=0))
        return [{"leaf": int(leaves[i]), "least": least[i], "most": most[i]} for i in np.flatnonzero(most >= least)]

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            i = 0
            while i < len(batch):
                some = batch.iloc[i : i + min(piece, per - n % per)]
                x = np.stack(some["unit"].to_numpy())
                yield pd.DataFrame({"pack": [f"{part}:{n // per}"], "ids": [some["query_id"].to_numpy()],
                                    "vectors": [x.tobytes()], "leaves": [visited(x)]})
                n, i = n + len(some), i + len(some)

    placed = settle(units.mapInPandas(place, _with(units, "leaf int")))
    parts = max(1, -(-placed.count() // per))
    # Written once: a range exchange dealt anew could cut elsewhere.
    return settle(placed.repartitionByRange(parts, "leaf", F.xxhash64("query_id")).select("query_id", "unit").mapInPandas(
        pack, f"pack string, ids array<{kind}>, vectors binary, leaves array<struct<leaf:int,least:double,most:double>>"))


def pack_visits(packs: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(pack, block): the blocks that may hold a document within the threshold of a query of the pack.

    Rings of a visited leaf are ruled out by the same inequality; what is ruled out cannot be a hit."""
    limit = float(np.arccos(threshold)) + 1e-7
    return packs.select("pack", F.inline("leaves")).join(index.blocks, "leaf").filter(
        (F.col("most") >= F.col("lo") - limit) & (F.col("least") <= F.col("hi") + limit)).select("pack", "block")


def block_visits(queries: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(query_id, block): `pack_visits` of every query by itself."""
    packs = query_packs(queries, index, threshold, 1)
    return pack_visits(packs, index, threshold).join(packs.select("pack", F.get("ids", F.lit(0)).alias("query_id")), "pack").drop("pack")


def _bundles(index: Index, per: int) -> tuple[DataFrame, DataFrame]:
    """(block, bundle) and (bundle, rows, vectors): blocks of neighbouring leaves in bundles of about `per` documents,
    each of them one row or more of ROW_BYTES at most."""
    sizes = index.docs.groupBy("block").agg(F.count("*").alias("n"))
    # One row a block: a hundredth of a percent of the documents once blocks are full.
    before = Window.orderBy("leaf", "block").rowsBetween(Window.unboundedPreceding, -1)
    named = settle(index.blocks.join(sizes, "block").select(
        "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / per).cast("int").alias("bundle")))

    piece = _rows_of(ROW_BYTES, index)

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [rows.iloc[i : i + piece] for i in range(0, len(rows), piece)]
        return pd.DataFrame({"bundle": key[0], "rows": [p["row"].to_numpy() for p in pieces],
                             "vectors": [np.stack(p["unit"].to_numpy()).tobytes() for p in pieces]})

    packed = index.docs.join(named, "block").select("bundle", "row", "unit").groupBy("bundle").applyInPandas(
        pack, "bundle int, rows array<bigint>, vectors binary")
    return named, packed


def _at_least(scores: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """A bound per row that the row's k-th best score reaches: k groups of columns hold a score of at least the k-th best maximum."""
    least, groups = np.full(len(scores), threshold), scores.shape[1] // GROUP
    if groups > k:
        best = scores[:, : groups * GROUP].reshape(len(scores), GROUP, groups).max(axis=1)
        least = np.maximum(least, np.partition(best, groups - k, axis=1)[:, groups - k])
    return least


def _best_of_bundle(k: int, threshold: float):
    def vectors(packed: pd.DataFrame, ids: str) -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([np.asarray(x) for x in packed[ids]])
        return names, np.frombuffer(b"".join(packed["vectors"])).reshape(len(names), -1)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "row": [], "score": []})
        (ids, q), (rows, d) = vectors(left, "ids"), vectors(right, "rows")
        order = np.argsort(rows)
        rows, d = rows[order], d[order]
        found = []
        for i in range(0, len(q), SCORE_ROWS):
            scores = q[i : i + SCORE_ROWS] @ d.T
            at, doc = np.nonzero(scores >= _at_least(scores, k, threshold)[:, None] - 1e-12)
            # Equal vectors tie, however the product rounds at its edges.
            value = np.round(scores[at, doc], 12)
            order = np.lexsort((doc, -value, at))
            at, doc, value = at[order], doc[order], value[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            found.append((ids[i + at[place < k]], rows[doc[place < k]], value[place < k]))
        return pd.DataFrame({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(("query_id", "row", "score"))})

    return score


def vector_retrieve(
    queries: DataFrame, docs: DataFrame, k: int = 8, threshold: float = RELEVANCE_THRESHOLD,
    block_rows: int = 4096,
) -> DataFrame:
    """Exact top-k documents of every query with a cosine of at least the threshold.

    The reference takes max(k, 8) candidates and then applies the threshold and k; on a list
    sorted by score that is the same as threshold first, then k.

    Documents live in the blocks of a tree of pivots taken from the data (`vector_index`).  Queries of
    one place travel packed, as do the documents of neighbouring blocks; a pair of the two
    meets only where `pack_visits` leaves a block.  So vectors are sent once a pair of packs, not once
    a query and block, and a task scores about one pair, which holds two packs and emits at most k rows
    a query, however many vectors there are."""
    result = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row long, score double"
    index = vector_index(docs, block_rows)
    if index.tree is None:
        hits = queries.sparkSession.createDataFrame([], result)
    else:
        per = _rows_of(PACK_BYTES, index)
        packs = query_packs(queries, index, threshold, per)
        named, bundles = _bundles(index, per)
        pairs = settle(pack_visits(packs, index, threshold).join(named, "block").select("pack", "bundle").distinct())
        # What is dealt grows with the pairs, not with the input that shuffles go by.
        by = ["pack", "bundle"]
        tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count())
        left = packs.select("pack", "ids", "vectors").join(pairs, "pack").repartition(tasks, *by)
        right = bundles.join(pairs, "bundle").repartition(tasks, *by)
        hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_best_of_bundle(k, threshold), result)
    best = top_k(hits, "query_id", [F.desc("score"), "row"], k, rank_col="rank")
    return best.select(
        "query_id", "row", F.bround(F.col("score") * 100, 2).alias("match_score"), "rank",
        F.lit("vector_search").alias("retrieval_type"),
    )


def hybrid_retrieve(
    queries: DataFrame, docs: DataFrame, k: int = 8, threshold: float = RELEVANCE_THRESHOLD,
) -> DataFrame:
    """Exact hits of a query if it has any, else its vector hits."""
    exact = settle(exact_retrieve(queries, docs, k))
    missed = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.unionByName(
        vector_retrieve(missed.filter("vector IS NOT NULL"), docs, k, threshold)
    )


# --- documents ---------------------------------------------------------------------------------

def document_key() -> Column:
    """Names, number and the first 100 characters."""
    return F.concat_ws(
        "|", *[F.coalesce(c, F.lit("")) for c in
               ("ingredient_kor_name", "ingredient_eng_name", "cas_no")],
        F.substring("content", 1, 100),
    )


def name_key() -> Column:
    """The first of Korean name, English name and first 100 characters that is not empty."""
    return F.coalesce(
        F.nullif(F.col("ingredient_kor_name"), F.lit("")),
        F.nullif(F.col("ingredient_eng_name"), F.lit("")),
        F.substring("content", 1, 100),
    )


def dedup_documents(docs: DataFrame, owner: Sequence[str], order, by: str = "document") -> DataFrame:
    """Keep each owner's first document per key; `by` is 'document' or 'name'."""
    key = document_key() if by == "document" else name_key()
    return keep_first(docs.withColumn("__key", key), [*owner, "__key"], order).drop("__key")


def retrieve_for_ingredients(
    requests: DataFrame, docs: DataFrame, threshold: float = RELEVANCE_THRESHOLD,
    limit: int = CONTEXT_DOCS,
) -> DataFrame:
    """Ranked documents of each request.

    Requests are rows (request_id, position, query, vector, search_k): one row per ingredient
    with search_k 1, or one free-text row with search_k 8.  Equal queries are searched once, as
    many requests name the same ingredients."""
    # A digest of query and vector names a search: rows that differ in either are searched apart.
    named = requests.withColumn("query_id", F.sha2(F.to_json(F.struct("query", "vector")), 256))
    distinct = named.groupBy("query_id").agg(F.first("query").alias("query"), F.first("vector").alias("vector"))
    most = requests.agg(F.max("search_k")).first()[0] or CANDIDATE_K
    found = hybrid_retrieve(distinct, docs, max(most, CANDIDATE_K), threshold).withColumnRenamed("rank", "hit_rank")
    hits = (
        named.drop("vector")
        .join(found, "query_id").filter("hit_rank <= search_k").drop("query_id")
        .join(docs.drop("vector"), "row")
        .withColumnRenamed("query", "query_ingredient")
    )
    unique = dedup_documents(hits, ["request_id"], ["position", "hit_rank", "row"], by="name")
    return top_k(unique, "request_id", ["position", "hit_rank", "row"], limit, rank_col="rank")


def retrieval_counts(requests: DataFrame, docs: DataFrame, owner: str = "request_id") -> DataFrame:
    """Exact and vector document counts per request; zero for requests without documents."""
    counted = docs.groupBy(owner).agg(
        F.count_if(F.col("retrieval_type") == "exact_match").alias("exact_match_count"),
        F.count_if(F.col("retrieval_type").isin("vector_search", "vector_fallback"))
        .alias("vector_fallback_count"),
        F.count("*").alias("retrieved_doc_count"),
    )
    return requests.select(owner).distinct().join(counted, owner, "left").fillna(
        0, ["exact_match_count", "vector_fallback_count", "retrieved_doc_count"])


def dedup_corpus(items: DataFrame) -> DataFrame:
    """Named ingredient records, the first of every document id, with rendered content."""
    from .context import render_item_text

    named = items.filter(
        (keys.clean_text("ingredient_kor_name") != "") | (keys.clean_text("ingredient_eng_name") != "")
    ).withColumn(
        "document_id",
        keys.document_id("ingredient_kor_name", "ingredient_eng_name", "cas_no"),
    )
    return keep_first(named, "document_id", "row").withColumn("content", render_item_text())
