"""Chunks and formula boundaries: whole results by brute force, and time that grows with the text alone."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from balsam.functions import text
from balsam.operators import hierarchy


def brute_chunks(t):
    out, depth, start = [], 0, 0
    for i, c in enumerate(t):
        depth = max(0, depth + (c in "([") - (c in ")]"))
        digits = 0 < i < len(t) - 1 and t[i - 1].isdecimal() and t[i + 1].isdecimal()
        if c == "," and depth == 0 and not digits:
            out.append(t[start:i])
            start = i + 1
    return [*out, t[start:]]


def test_chunks_match_brute_force_across_blocks(spark):
    rng = random.Random(3)
    texts = ["", ",", "(", "a,(b,c", "),(,),", "1,2(3,4)", None]
    texts += ["".join(rng.choice("ab1,,()[] 2\n") for _ in range(n)) for n in (5, 30, 200, 4_000, 9_000)]
    texts.append(",".join(["(x"] * 600 + ["y)"] * 700))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.c for r in rows.select("i", text.raw_chunks("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_chunks(t or ""), t and t[:80]


def test_a_million_commas_take_time_in_proportion(spark):
    def seconds(n):
        long = ",".join("i (a" if i % 3 == 0 else "b)" if i % 3 == 1 else "c" for i in range(n))
        docs = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
        start = time.perf_counter()
        rows = docs.select(F.explode(text.raw_chunks("text")).alias("c")).count()
        assert rows == len(brute_chunks(long))
        return time.perf_counter() - start

    seconds(1_000)
    short = seconds(100_000)
    assert seconds(1_000_000) < 12 * short + 2


def brute_boundaries(words, dictionary, index):
    known = lambda a, b: "".join(words[a:b]) in dictionary
    n = len(words)
    lefts = [i for i in range(1, n) if known(0, i)]
    rights = [i for i in range(1, n) if any(known(i, i + k) for k in range(1, 5) if i + k <= n)]
    with_left = [(a, b) for a in lefts for b in rights if a < b and not known(a, b)] if index > 0 else []
    bare = [(0, b) for b in rights if b not in lefts]
    best = with_left or bare
    return (len(best), *min(best)) if best else None


def sections(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, section_no int, raw_header string, body string")


def test_boundaries_match_brute_force(spark):
    rng = random.Random(5)
    names = ["a", "b", "ab", "ba", "abc", "cab", "dd", "add"]
    dictionary = spark.createDataFrame([(n,) for n in names], "key string")
    bodies = [[[rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 5))] for _ in range(120)]
    rows = [(d, 1, "[Set]", ",".join(" ".join(c) for c in body)) for d, body in enumerate(bodies)] + [(999, 1, "", "a x b")]
    got = {(r.doc_id, r.chunk_index): (r.n_splits, r.left_end, r.right_start)
           for r in hierarchy.formula_boundaries(sections(spark, rows), dictionary).collect()}
    want = {(d, i): b for d, body in enumerate(bodies) for i, c in enumerate(body) if (b := brute_boundaries(c, set(names), i))}
    assert got == want and any(v[1] > 0 and v[0] > 1 for v in want.values())


def test_boundaries_of_a_chunk_of_five_thousand_words(spark):
    """All words are known, so nearly every pair of left and right parts would be a split."""
    dictionary = spark.createDataFrame([("a",), ("aa",), ("aaaaaaaa",)], "key string")
    rows = sections(spark, [(1, 1, "[Set]", "a," + " ".join(["a"] * 5_000))])
    start = time.perf_counter()
    got = {r.chunk_index: (r.n_splits, r.left_end, r.right_start) for r in hierarchy.formula_boundaries(rows, dictionary).collect()}
    assert got[1] == brute_boundaries(["a"] * 5_000, {"a", "aa", "aaaaaaaa"}, 1)
    assert time.perf_counter() - start < 30
