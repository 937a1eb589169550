"""Exact vector searches and phrase mining against brute force, on small and awkward tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.llm import collocations, hard_negatives, topk_search, whole_vectors
from balsam.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = ("vec_id bigint, embedding array<double>, label int, block string, ask string, v string, h string, dim string, "
          "place string, score string, ids string")


def vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], i % 4) for i in range(300)]
    same = [0.25, -0.5, 0.125, 0.0, 0.75, 0.1]
    rows += [(1000 + i, same, i % 2) for i in range(40)]  # a group of copies
    rows += [(1100 + i, [0.0] * 6, 3) for i in range(15)]  # zero vectors: every score ties
    rows += [(1200, None, 1), (1201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1202, [math.nan] * 6, 2), (1203, [math.inf] * 6, 2),
             (None, same, 1), (1204, same, None), (1300, [1e306] * 6, 0), (1205, [0.1, 0.2], 0), (1206, [0.3, 0.1], 1),
             (1400, [0.2, 0.2], 0), (1207, [], 0), (1208, [], 1), (1209, [], 0), (1500, [], 0), (100, rows[100][1], rows[100][2])]
    rows += [(1600, [3e5, -2e5, 1.5, 0.0, 1e5, 2e5], 1), (1601, [3e5, 2e5, 1.5, 0.0, 1e5, 2e5], 2), (1700, [2e13] * 6, 2), (1701, [2e13] * 6, 1)]
    rows += [(-100, [rng.gauss(0, 0.2) for _ in range(6)], 2), (200, [rng.gauss(0, 0.2) for _ in range(6)], 1)]  # 200 twice
    return [(*r, *["x"] * 8) for r in rows]


def whole(rows, labelled):
    out = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        out.add((i, label if labelled else None, tuple(math.floor(x * 256) for x in v)))
    return sorted(out, key=str)


def dot(a, b):
    return max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


@pytest.fixture(scope="module")
def ugly(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(4).cache()


def small_blocks(monkeypatch):
    for module in (topk_search, hard_negatives):
        monkeypatch.setattr(module, "BLOCK_ROWS", 90)
        monkeypatch.setattr(module, "ASK_ROWS", 4)


def test_top_k_matches_brute_force(spark, ugly, monkeypatch):
    small_blocks(monkeypatch)
    rows = whole(vectors(), False)
    want = []
    for q, _, v in rows:
        if q % 50 == 0:
            best = sorted((-dot(v, w), c) for c, _, w in rows if c != q and len(v) == len(w))[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = topk_search.search_top_k(ugly, F.col("vec_id") % 50 == 0).collect()
    assert Counter(want) == Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    empty = topk_search.search_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_few_entries_pass_the_share_of_the_cutoff():
    """The uniform threshold, not a full pass, decides what is resolved."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(0, 0.125, (4000, 64)))
    ids = np.arange(4000)
    q_ids, q = ids[::50], v[::50]
    cut_ids, cut = topk_search.gather(q_ids, q, ids, v, 5)
    at, score, sent = topk_search.collect(q_ids, q, ids, v, cut[:, -1], cut_ids[:, -1], 5)
    every = q @ v.T
    every[np.arange(len(q)), q_ids] = -np.inf
    assert (score == -np.sort(-every, axis=1)[:, :5]).all() and sent < 0.05 * every.size
    # A list that norms hold below the share is not read at all.
    none = topk_search.collect(q_ids, q, ids, v, np.full(len(q), 1 << 40), cut_ids[:, -1], 5)
    assert none[2] == 0 and (none[1] == whole_vectors.NONE).all()


def negatives(rows, anchors):
    want = []
    for a, label, v in rows:
        if not anchors(a):
            continue
        scored = sorted((-dot(v, w), c, other) for c, other, w in rows if c != a and len(v) == len(w))
        for p, c, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            want += [(a, c, n, x[1], -p, -x[0]) for n, x in enumerate(fit, 1)]
    return Counter(want)


def test_hard_negatives_match_brute_force(spark, ugly, monkeypatch):
    small_blocks(monkeypatch)
    monkeypatch.setattr(hard_negatives, "ROOTS", 3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = hard_negatives.mine_hard_negatives(ugly, F.col("vec_id") % 100 == 0, F.col("label"))
    assert negatives(whole(vectors(), True), lambda i: i % 100 == 0) == Counter(tuple(r[c] for c in columns) for r in got.collect())
    empty = hard_negatives.mine_hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0, F.col("label"))
    assert empty.collect() == [] and empty.columns == columns


def test_trees_skip_boxes_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.5, (40, 24))
    v = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.01, (4000, 24))))
    order = hard_negatives.tile(v)
    assert sorted(order) == list(range(4000))
    v, ids = v[order], np.arange(4000)
    tree = hard_negatives.Tree(ids, v)
    q_ids, q = ids[::40], v[::40]
    all_of = np.full(len(q), whole_vectors.NONE + 1), np.full(len(q), 1 << 62)
    _, score, read = tree.walk(q_ids, q, *all_of, 5)
    every = q @ v.T
    every[np.arange(len(q)), q_ids] = -np.inf
    assert (score == -np.sort(-every, axis=1)[:, :5]).all()
    assert read < 0.5 * len(q) * (4000 / hard_negatives.LEAF)
    # A window that no box meets reads nothing.
    assert tree.walk(q_ids, q, np.full(len(q), 1 << 40), np.full(len(q), 1 << 41), 5)[2] == 0


TEXTS = [
    ("New York is big. new york, New York! in New York", "en"), ("new york new york new york", "en"), (None, "en"), ("", None),
    ("a b a b a b a b a b", None), ("a\tb  a b;a b:c", "und"), ("é è é è é è", "fr"), ("x", "fr"), (" .,. ", "fr"),
    ("der der der der der der", "de"), ("one two three four five six seven " * 6, "en"), ("ONE two three four five six seven", "en"),
    ("tail of words without end " * 300, "long"),
]


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        longer = [(" " + g + " ", c) for g, c in counts.items() if c >= least]
        found = []
        for g, a in counts.items():
            w = g.split(" ")
            if len(w) < 2 or a < least or any(len(o) > len(g) + 2 and f" {g} " in o and c >= a for o, c in longer):
                continue
            cuts = []
            for k in range(1, len(w)):
                x, y = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1000 * a * n[lang] // (x * y), k, x, y))
            s, _, x, y = min(cuts)
            found.append((-s, -a, g.encode(), x, y))
        out += [(lang, i, g.decode(), -a, x, y, n[lang], -s) for i, (s, a, g, x, y) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1000)
    clash = "text string, lang string, k string, gram string, n string, f string, phrase string, key string"
    rng = random.Random(2)
    rows = TEXTS + [(" ".join(rng.choice("abcde") for _ in range(400)), "abc"), (", ".join("x y z" for _ in range(50)), "abc")]
    docs = spark.createDataFrame([(*r, *"xxxxxx") for r in rows], clash).repartition(3)
    for least, top in ((3, 2000), (1, 4)):
        got = collocations.mine_collocations(docs, min_count=least, top=top).collect()
        assert brute_phrases(rows, least, top) == Counter(tuple(r[c] for c in PHRASE) for r in got)
    empty = collocations.mine_collocations(docs.where("1 = 0"))
    assert empty.collect() == [] and empty.columns == PHRASE


def test_collocations_of_a_table(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collocations.mine_collocations(docs, min_count=20).collect()
    assert len(got) > 20 and brute_phrases(rows, 20, 2000) == Counter(tuple(r[c] for c in PHRASE) for r in got)


def test_a_full_pair_filter_changes_nothing(spark, monkeypatch):
    """Pairs that the bit array lets through wrongly are counted and fall to the threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = collocations.mine_collocations(docs, min_count=20).collect()
    monkeypatch.setattr(collocations, "_filter", lambda frequent: np.full(16, (1 << 64) - 1, np.uint64))
    assert sorted(map(tuple, collocations.mine_collocations(docs, min_count=20).collect())) == sorted(map(tuple, want))


def test_scores_beyond_64_bits_are_exact(spark):
    """1000 * a * n passes 64 bits; the decimals of the score stay exact."""
    a, n, l, r = 3_000_000_007, 90_000_000_000_001, 4_000_000_003, 5_000_000_021
    got = spark.sql(f"SELECT (cast(1000 * {a}L as decimal(19,0)) * cast({n}L as decimal(19,0))) "
                    f"div (cast({l}L as decimal(19,0)) * cast({r}L as decimal(19,0)))").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_search_queries_are_registered():
    assert {"op11_hard_negatives", "op12_collocations", "op13_topk_search"} <= set(QUERIES)
