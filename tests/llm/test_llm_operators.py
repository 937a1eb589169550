"""Operators of the training-data pipeline against brute force, on small and awkward tables."""

from __future__ import annotations

import glob
import hashlib
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from balsam.functions.settle import checkpoint_dir
from balsam.llm import (
    bpe, char_model, embedding_dedup, line_dedup, minhash, mixing, pii, quality_rules, rule_ensemble, sharding, suffix_dedup,
)
from balsam.llm.common import components
from balsam.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n string, label string, "
          "h string, row string, t string, epochs string, cut string, kept string, component_id string, prefix string")
LINE = "This line of boilerplate stands in a great many documents, word for word"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BASE = " ".join(f"word{i % 97} other{i % 89}" for i in range(150))


def rows():
    texts = [
        (0, None), (1, ""), (2, " \t\n"), (3, "one two three"), (4, "one two three"), (5, BASE), (6, BASE), (6, BASE),
        (7, BASE.replace("word5 ", "changed ")), (8, BASE.upper()), (9, PASSAGE + "\nown words here"), (10, "before it " + PASSAGE),
        (11, "a" * 30_000), (12, "é" * 60), (13, "\U0001f600 " * 30), (None, BASE), (None, None), (14, "x " * 20_000),
        *[(20 + i, f"line {i}\n  {LINE if i % 2 else LINE.upper()}  \nend {i}\n{LINE}") for i in range(8)],
        *[(40 + i, "The quick brown fox jumps over the lazy dog. " * 3 + f"{i} {i * i}") for i in range(6)],
        (60, "mail Anna Schmidt at anna.schmidt@mail1.example.com or +1 (706) 555-3138, then Schmidt again"),
        (61, "from 706-555-3138 and ANNA.SCHMIDT@mail1.example.com at 97.51.17.173, card 4111 1111 1111 1111"),
        (62, "<|endoftext|> don't stop<|startoftext|>ΟΔΟΣ  İ ́"),
    ]
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, [None, "en", "de"][i % 3], [None, "src0", "src1", "src12"][i % 4], None, "k", "n", "l", "h", "r", "t", "e", "c", "x", "c", "p"))
    return out


@pytest.fixture(scope="module")
def ugly(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def docs_of(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def check_repeats(data, got):
    data = [(d, (t or "").encode()) for d, t in data]
    first = {}
    for d, x in data:
        if d is not None:
            for i in range(len(x) - 49):
                first[x[i : i + 50]] = min(d, first.get(x[i : i + 50], d))
    want = []
    for d, x in data:
        gone, upto = bytearray(len(x)), 0
        for i in range(len(x) - 49):
            if d is not None and first[x[i : i + 50]] < d:
                gone[max(i, upto) : i + 50] = b"\1" * (i + 50 - max(i, upto))
                upto = i + 50
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((d, len(x), sum(gone), spans, sha(bytes(c for c, g in zip(x, gone, strict=True) if not g))))
    assert Counter(want) == Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_suffix_dedup_matches_brute_force(spark, ugly, empty, monkeypatch):
    check_repeats(docs_of(spark), QUERIES["op1_suffix_dedup"](spark, SF).collect())
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
    got = suffix_dedup.remove_repeats(ugly, keep_text=True).collect()
    check_repeats([r[:2] for r in rows()], got)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_cover_gives_equal_windows_one_distance():
    rng = np.random.default_rng(3)
    x = rng.integers(97, 100, 5_000).astype(np.uint8)
    x[3_000:3_400] = x[100:500]
    p, _, _, first, last = suffix_dedup.cover(x, np.array([0, 2_000, 5_000]))
    to = {s: q - s for q, a, b in zip(p, first, last, strict=True) for s in range(a, b + 1)}
    assert all(0 <= d < suffix_dedup.REACH for d in to.values())
    assert all(to[100 + i] == to[3_000 + i] for i in range(351))
    assert len(to) == 2_000 - 49 + 3_000 - 49


def test_bpe_matches_the_library(spark, ugly, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded)

    for data, got in ((docs_of(spark), QUERIES["op2_bpe_codec"](spark, SF)), ([r[:2] for r in rows()], bpe.encode_documents(ugly, tokenizer_path()))):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())
        assert got == Counter((d, *want(t)) for d, t in data)
    assert bpe.encode_documents(empty, tokenizer_path()).count() == 0


def test_line_dedup_matches_brute_force(spark, ugly, empty):
    lower = {i: i + 32 for i in range(65, 91)}
    data = [r[:2] for r in rows()]
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    for d, t in data:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 40:
                held[key(line)].add(d)
    want = []
    for d, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < 5 or max(held[key(x)]) == d]
        want.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = line_dedup.digest(line_dedup.deduplicate_lines(ugly)).collect()
    assert Counter(want) == Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got)
    assert sum(r.n_dropped for r in got) > 10
    assert line_dedup.deduplicate_lines(empty).count() == 0


def brute_components(ids, linked):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    edges = [*chain, *star, (539, 100), (7, 7), (9, 8), (8, 9)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({i for e in edges for i in e}, edges)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def check_links(data, got):
    sets = [(d, shingles(t)) for d, t in data]
    known = [(d, s) for d, s in sets if d is not None]
    links = [(a, b) for i, (a, s) in enumerate(known) for b, t in known[:i] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    label = brute_components({d for d, _ in known}, links)
    want = Counter((d, len(s), label.get(d), d is None or label[d] == d) for d, s in sets)
    assert want == Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_near_dedup_matches_brute_force(spark, ugly, empty, monkeypatch):
    check_links(docs_of(spark), QUERIES["op9_minhash_near_dedup"](spark, SF).collect())
    monkeypatch.setattr(minhash, "TILE", 2)  # every larger band is compared in tiles
    check_links([r[:2] for r in rows()], minhash.link_documents(ugly).collect())
    assert minhash.link_documents(empty).count() == 0


def test_near_dedup_keeps_every_text_of_a_repeated_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(200)) for c in "abc"]
    near = [t + " more" for t in texts]
    data = [(1, texts[0]), (1, texts[1]), (1, texts[2]), *[(10 + i, t) for i, t in enumerate(near)]]
    got = minhash.link_documents(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert len(got) == 6 and {r.component_id for r in got} == {1}


def test_sketches_lose_fewer_links_than_bands():
    flips = np.zeros((2 * minhash.SAMPLES + 1, minhash.SKETCH_BITS + 1))  # chance of so many odd bits after so many flips
    flips[0, 0] = 1
    odd = np.arange(minhash.SKETCH_BITS + 1) / minhash.SKETCH_BITS
    for i in range(2 * minhash.SAMPLES):
        flips[i + 1, 1:] += flips[i, :-1] * (1 - odd[:-1])
        flips[i + 1, :-1] += flips[i, 1:] * odd[1:]
    chance = lambda d: math.comb(minhash.SAMPLES, d) * 0.25**d * 0.75 ** (minhash.SAMPLES - d)
    lost = sum(chance(d) * flips[2 * d][minhash._ESTIMATE < minhash.PLAUSIBLE].sum() for d in range(minhash.SAMPLES + 1))
    assert lost < (1 - 0.75**minhash.BAND_ROWS) ** (minhash.SAMPLES // minhash.BAND_ROWS)


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for shared in (1_000, 900, 800, 600):
        one = rng.integers(0, 2**63, 1_000).astype(np.uint64)
        two = np.concatenate([one[:shared], rng.integers(0, 2**63, 1_000 - shared).astype(np.uint64)])
        both = np.concatenate([np.sort(one), np.sort(two)])
        sketch = minhash.odd_sketches(minhash.samples(both, np.array([0, 1_000, 2_000]))).view(np.uint64)
        assert abs(minhash.estimates(sketch[0], sketch[1:])[0] - shared / (2_000 - shared)) < 0.15


def test_embedding_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    vectors = [(centre[i % 12] + rng.normal(size=16) * 0.12).tolist() for i in range(400)]
    data = [(i, v, i % 2) for i, v in enumerate(vectors)]
    data += [(400 + i, vectors[0], 0) for i in range(5)]
    data += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan"), *[1.0] * 15], 1), (503, vectors[1], None),
             (504, [None, *[1.0] * 15], 0), (505, [], 1), (506, [2 * x for x in vectors[2]], 0), (507, vectors[3][:8], 1)]
    monkeypatch.setattr(embedding_dedup, "SHARD_NODES", 120)
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").withColumn("node", embedding_dedup.F.lit("x"))
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(table).collect()}
    sound = {d: (np.array(v), x) for d, v, x in data if v and x is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a in sound for b in sound if a < b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0])
             and sound[a][0] @ sound[b][0] / np.linalg.norm(sound[a][0]) / np.linalg.norm(sound[b][0]) >= 0.93]
    label = brute_components(range(600), links)
    count = Counter(i for pair in links for i in pair)
    assert len(got) == len(data)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * sum(count.values()) <= found <= sum(count.values())
    assert all(r.n_links <= count[d] for d, r in got.items())
    assert np.mean([r.component_id == label[d] for d, r in got.items()]) > 0.98
    assert all(got[d].kept and got[d].n_links == 0 for d in (500, 501, 502, 503, 504, 505, 507))
    assert embedding_dedup.link_vectors(table.limit(0)).count() == 0


def test_embedding_tasks_hold_one_shard_of_queries(spark, monkeypatch):
    seen = []
    whole = embedding_dedup.pieces
    monkeypatch.setattr(embedding_dedup, "SHARD_NODES", 50)
    monkeypatch.setattr(embedding_dedup, "pieces", lambda nodes: seen.append(whole(nodes)) or seen[-1])
    rng = np.random.default_rng(3)
    data = [(i, v, 0) for i, v in enumerate(rng.normal(size=(1_000, 8)).tolist())]  # one label of 20 shards
    embedding_dedup.link_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")).count()
    tasks = [r["count"] for r in seen[0].groupBy("label", "to", "shard").count().collect()]
    assert len(tasks) == 20 * 19 and max(tasks) <= 100 and sum(tasks) == 19 * 1_000


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = [any(0 <= j < len(words) - 2 and windows[tuple(words[j : j + 3])] > 1 for j in (i - 2, i - 1, i)) for i in range(len(words))]
    n, again = len(words), sum(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, again, n < 50 or 100 * again > 50 * n


def check_rules(data, got):
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert Counter((d, *base_rules(t)) for d, t in data) == Counter((r.doc_id, *[r[c] for c in names]) for r in got)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_quality_rules(spark, ugly, empty):
    got = QUERIES["op5_quality_rules"](spark, SF).collect()
    check_rules(docs_of(spark), got)
    passing = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in passing) >= 0.95 * len(passing)
    check_rules([r[:2] for r in rows()], quality_rules.apply_rules(ugly).collect())
    assert quality_rules.apply_rules(empty).count() == 0


def test_language_model_is_a_distribution_and_rejects_noise(spark):
    rng = np.random.default_rng(2)
    words = ["the", "rain", "fell", "over", "hills", "and", "rivers", "while", "people", "slept", "until", "morning"]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(400)]
    noise = ["".join(map(chr, rng.integers(0x3400, 0x4D00, 400))) + " x" * 60]
    noise = [" ".join(noise[0][i : i + 6] for i in range(0, 400, 6))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + noise)], "doc_id bigint, text string, lang string")
    model = char_model.train_model(docs.where("doc_id < 400"))
    x = np.frombuffer(texts[0].encode(), np.uint8)
    hi, lo, _ = char_model.packed_grams(x, np.array([0, len(x)]))
    letters = np.unique(lo & 0x1FFFFF)
    for i in (0, 3, 50):
        total = np.exp(model.log_probability("en", np.full(len(letters), hi[i]), lo[i] & ~0x1FFFFF | letters)).sum()
        assert 0.8 < total < 1.01
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert not got[400].kept and not got[400].base_failed
    assert sum(got[i].kept for i in range(400)) >= 398


def test_language_model_of_a_small_language_does_not_shrink_beside_a_large_one(spark):
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    small_words, large_words = [word("абвгд") for _ in range(300)], [word("abcdefgh") for _ in range(2_000)]
    small = [(i, " ".join(rng.choice(small_words, 60)), "xx") for i in range(8)]
    large = [(100 + i, " ".join(rng.choice(large_words, 6_000)), "en") for i in range(250)]  # 10 million characters
    shape = "doc_id bigint, text string, lang string"
    alone, beside = ({r.doc_id: r.log_perplexity for r in quality_rules.apply_rules(spark.createDataFrame(d, shape)).where("lang = 'xx'").collect()}
                     for d in (small, small + large))
    assert alone.keys() == beside.keys() and all(abs(alone[i] - beside[i]) < 1e-4 for i in alone)


def test_scores_of_blocks_are_those_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(char_model, "BLOCK_BYTES", 3_000)  # many blocks a partition
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    got = {r.doc_id: r.log_perplexity for r in quality_rules.apply_rules(docs).collect()}
    model = char_model.train_model(docs)
    for r in docs.limit(20).collect():
        x = np.frombuffer(r.text.encode(), np.uint8)
        hi, lo, _ = char_model.packed_grams(x, np.array([0, len(x)]))
        assert abs(got[r.doc_id] + model.log_probability(r.lang, hi, lo).mean()) < 1e-4


def kneser_ney(texts):
    """Log probability a character of each text, in plain Python: modified Kneser-Ney, five characters, all interpolated; n-grams
    of two and more that stand once are left out and their place is taken by what backing off leaves."""
    from math import log

    text = {t: ("\0" * 4 + t) for t in texts}
    n = {5: Counter(p[i - 4 : i + 1] for t in texts for p in [text[t]] for i in range(4, len(p)))}
    plain = {5: n[5]}
    for k in (4, 3, 2, 1):
        n[k], plain[k] = Counter(g[1:] for g in n[k + 1]), Counter()
        for g, c in plain[k + 1].items():
            plain[k][g[1:]] += c
    p, score = {"": None}, {}
    for k in range(1, 6):
        of = Counter(n[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = {i: min(max(i - (i + 1) * y * of[i + 1] / max(of[i], 1), 0.1), i - 0.1) if of[i] and of[1] else 0.5 * i for i in (1, 2, 3)}
        total, mass, own, low = Counter(), Counter(), Counter(), Counter()
        for g, c in n[k].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        under = (lambda g: 1 / (len(n[1]) + 1)) if k == 1 else (lambda g: p[g[1:]])
        p.update({g: (c - d[min(c, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * under(g) for g, c in n[k].items()})
        stored = {g for g in n[k] if k == 1 or plain[k][g] >= 2}
        for g in stored:
            own[g[:-1]] += p[g]
            low[g[:-1]] += under(g)
        for g in n[k]:
            weight = log(max(1 - own[g[:-1]], 1e-9) / max(1 - low[g[:-1]], 1e-9)) if g[:-1] in own else 0
            score[g] = log(p[g]) if g in stored else weight + score[g[1:]]
    return [sum(score[text[t][i - 4 : i + 1]] for i in range(4, len(text[t]))) / len(t) for t in texts]


def test_perplexities_are_those_of_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de'").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    wanted = dict(zip(texts, kneser_ney(list(texts.values())), strict=True))
    for stored in (True, False):
        got = {r.doc_id: r.log_perplexity for r in quality_rules.apply_rules(docs, stored=stored).collect()}
        assert all(abs(got[d] + wanted[d]) < 1e-4 for d in texts)


def test_characters_of_all_scripts_keep_their_whole_code(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(map(chr, rng.integers(0x4E00, 0x4E40, 3)))
    words = [word() for _ in range(40)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    # The same low bits in another plane: no text of this script vouches for them.
    foreign = "".join(c if c == " " else chr(ord(c) + 0x3000) for c in texts[0])
    emoji = "".join(c if c == " " else chr(0x10000 + ord(c)) for c in texts[0])
    docs = [(i, t, "zh") for i, t in enumerate([*texts, foreign, emoji])]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].log_perplexity > got[0].log_perplexity + 1 for i in (60, 61))
    wanted = kneser_ney([t for _, t, _ in docs])
    assert all(abs(got[i].log_perplexity + wanted[i]) < 1e-4 for i in got)


def test_grams_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(char_model, "gram_hash", lambda hi, lo: (lo.astype(np.uint64) & np.uint64(1)))
    hi, lo = np.array([1, 1, 2, 1, 2], np.int64), np.array([4, 6, 4, 4, 5], np.int64)
    a, b, n, which = char_model.distinct_grams(hi, lo)
    assert (a[which] == hi).all() and (b[which] == lo).all() and len(a) == 4 and n.sum() == 5 and n[which[0]] == 2


def test_counting_holds_no_more_than_a_few_runs_of_grams():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(4_000)]
    texts = pa.array([" ".join(rng.choice(words, 75_000)) for _ in range(20)])  # 0.5 MB each
    block = char_model.Block(0, 8)
    block.wanted = False
    tracemalloc.start()
    try:
        for _ in block.add(texts):
            pass
        block.close()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert block.n.sum() == sum(len(t) for t in texts.to_pylist())
    assert peak < 64 << 20


def test_only_scores_are_on_disk_when_the_texts_travel(spark, monkeypatch):
    checkpoint_dir(spark)  # the first call sets it
    folder = checkpoint_dir(spark).removeprefix("file:")
    tables, seen = lambda: set(glob.glob(f"{folder}/settled-*")), []
    before, plain = tables(), quality_rules.settle

    def watched(df):
        if "log_perplexity" in df.columns:
            seen.append(len(tables() - before))
        return plain(df)

    monkeypatch.setattr(quality_rules, "settle", watched)
    assert quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet"), stored=True).count() > 0
    assert seen == [1]


def test_perplexity_bands_reject_planted_texts_on_both_sides_and_keep_wrong_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    whole = {r.doc_id: r for r in docs.collect()}
    rng, texts = np.random.default_rng(5), [r.text for r in whole.values() if r.lang == "en" and len(r.text) > 1_500]
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz      "), 2_000)) for _ in range(5)]
    salad = [" ".join("".join(rng.permutation(list(w))) for w in t.split()) for t in texts[:5]]
    repetitive = [" ".join("the" * int(n) for n in rng.integers(1, 60, 200)) for _ in range(5)]
    planted = [(10_000 + i, t, "en") for i, t in enumerate(noise + salad + repetitive)]
    wrong = [(20_000 + i, t + f" {i}", "fr") for i, t in enumerate(texts[5:15])]
    table = docs.union(spark.createDataFrame(planted + wrong, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(table).collect()}
    assert not any(got[d].base_failed or got[d].kept for d, *_ in planted)
    assert all(got[d].kept and got[d].lang == "fr" for d, *_ in wrong if not got[d].base_failed)
    passing = [got[d] for d in whole if not got[d].base_failed]
    assert 0.95 * len(passing) <= sum(r.kept for r in passing)


def test_mixing_matches_its_sql_and_plans_by_siblings_first(spark, ugly, empty):
    leaves = spark.createDataFrame([("a", "en", "a0", 100), ("a", "en", "a1", 1000), ("a", "de", "a0", 500), ("b", "en", "b0", 5000)],
                                   "domain string, language string, leaf_source string, t bigint")
    given = {("a",): 1.0, ("b",): 1.0, ("a", "en"): 1.0, ("a", "de"): 1.0, ("a", "en", "a0"): 9.0, ("a", "en", "a1"): 1.0}
    plan = {(r.domain, r.language, r.leaf_source): r.epochs * r.t + r.rest for r in mixing.plan_leaves(leaves, 2000, given, 2).collect()}
    # a and b share 2000, en and de share 1000; a0 gives 200 at most, its sibling takes over.
    assert plan == {("a", "en", "a0"): 200, ("a", "en", "a1"): 300, ("a", "de", "a0"): 500, ("b", "en", "b0"): 1000}
    got = mixing.mix_sources(ugly).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows()]
    assert 0.9 * sum(words) < sum(r.n_tokens for r in got)
    assert set(ugly.columns) <= set(got[0].__fields__) and all(r.cut == "c" for r in got)
    assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in mixing.mix_sources(ugly.repartition(3)).collect())
    assert mixing.mix_sources(empty).count() == 0


def test_rule_ensemble_on_held_out_rows(spark, ugly, empty):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_rule_ensemble"](spark, sf).toPandas()
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    seen = got.merge(known, on="doc_id").query("held_out")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (seen.predicted == seen.quality).mean() > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    labels = spark.createDataFrame([(5, 1), (5, 1), (9, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    assert rule_ensemble.score_quality(ugly, labels).where("score between 0 and 1").count() == len(rows())
    assert rule_ensemble.score_quality(ugly, labels.limit(0)).select("score").distinct().count() == 1
    assert rule_ensemble.score_quality(empty, labels).count() == 0


def test_pii_surrogates(spark, ugly, empty):
    got = {r.doc_id: r for r in pii.replace_pii(ugly).collect() if r.doc_id is not None}
    source = {d: t for d, t, *_ in rows()}
    assert pii.replace_pii(ugly).count() == len(rows())
    for private in ("Anna", "Schmidt", "anna.schmidt@", "706", "97.51.17.173", "4111 1111 1111 1111"):
        assert all(private.lower() not in (got[d].text or "").lower() for d in (60, 61))
    # One entity, one surrogate, in the shape of each place.
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", got[60].text)
    assert "-".join(phone.groups()) in got[61].text
    mail = re.search(r"\S+@\S+\.com", got[60].text)[0]
    assert mail.upper().split("@")[0] in got[61].text and mail.lower().split("@")[1] in got[61].text
    name = re.search(r"mail (\w+) (\w+) at", got[60].text)
    assert name[1] in pii.GIVEN_NAMES["female", "latin"] and got[60].text.endswith(f"then {name[2]} again")
    card = re.search(r"card ([\d ]+)", got[61].text)[1]
    assert pii.luhn(card.replace(" ", "")) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card)
    clean = [d for d in got if d not in (60, 61)]
    assert all(got[d].text == source[d] and got[d].n_entities == 0 for d in clean)
    assert pii.replace_pii(empty).count() == 0


def check_surrogates(spark, values):
    got = pii.assign_surrogates(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert {(r.kind, r.value) for r in got} == set(values) and len(got) == len(values)
    assert len({(r.kind, r.surrogate) for r in got}) == len(values)
    real = set(values)
    assert not [r for r in got if not r.kind.startswith("given") and (r.kind, r.surrogate) in real]
    return got


def test_pii_surrogates_stay_distinct(spark):
    values = [("national", f"{i:02d}") for i in range(30)] + [("given:male:greek", n) for n in pii.GIVEN_NAMES["male", "greek"]]
    check_surrogates(spark, values)


def test_pii_surrogates_end_where_a_shape_runs_out(spark):
    """60 of 100 two-digit values are taken by the entities themselves: 40 surrogates of that shape for 60 entities."""
    got = check_surrogates(spark, [("national", f"{i:02d}") for i in range(60)] + [("surname", c) for c in "abcdefghijklmnopqrst"])
    assert any(len(r.surrogate) > len(r.value) for r in got)
    longer = next(r for r in got if r.kind == "national" and len(r.surrogate) > 2)
    assert re.sub(r"\D", "", pii.render("national", f"{longer.value[0]}-{longer.value[1]}", longer.surrogate)) == longer.surrogate


def test_pii_in_digits_of_other_scripts(spark):
    texts = ["card ٤١١١ ١١١١ ١١١١ ١١١١ here", "call ٧٠٦-٥٥٥-٣١٣٨ now", "call 706-555-3138 now", "call ७०६-५५५-३१३८", "@ ٧٠٦-٥٥٥-٣١٣٨",
             "Dr. Priya Raman and Mrs Okafor met; Raman left", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(docs).collect()}
    for i, private in ((0, "١١١١"), (1, "٥٥٥-٣١٣٨"), (2, "555-3138"), (3, "५५५-३१३८"), (4, "٥٥٥-٣١٣٨"), (5, "Raman"), (5, "Okafor"), (5, "Priya")):
        assert private not in got[i]
    assert got[6] == texts[6]
    digits = ["".join(str(int(c)) for c in got[i] if c.isdecimal()) for i in (1, 2, 3, 4)]
    assert len(set(digits)) == 1 and re.search("[٠-٩]{3}-[٠-٩]{3}-[٠-٩]{4}", got[1]) and re.search("[०-९]{4}", got[3])
    assert re.fullmatch(r"Dr\. [A-Z]\w+ ([A-Z]\w+) and Mrs [A-Z]\w+ met; \1 left", got[5])


def test_pii_of_a_table_is_coreferent_and_distinct(spark):
    """Every mention of the whole table: one surrogate per entity, different entities apart, all else as it was."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    seen, used = {}, {}
    for r in docs.collect():
        found, at, to = pii.entities(r.text or ""), 0, 0
        assert new[r.doc_id].n_entities == len(found)
        for a, b, kind, value in found:
            assert (r.text[at:a]) == new[r.doc_id].text[to : to + a - at]
            put = new[r.doc_id].text[to + a - at : to + b - at] if kind != "address" and not kind.startswith("given") else None
            if put is None:  # of another length: up to where the text goes on
                rest = re.match(r"[\w.:]+", new[r.doc_id].text[to + a - at :])[0]
                put = rest.rstrip(".:") if kind == "address" else rest
            flat = pii._canonical(kind, put)[1] if kind in ("phone", "card", "national", "iban", "email") else put.lower()
            assert seen.setdefault((kind, value), flat) == flat
            assert used.setdefault((kind, flat), value) == value
            to, at = to + (a - at) + len(put), b
        assert (r.text or "")[at:] == (new[r.doc_id].text or "")[to:]
    assert len(seen) > 10


def check_shards(got, limit):
    size, most = Counter(), Counter()
    for r in got:
        size[r.depth, r.prefix, r.part] += r.bytes
        most[r.depth, r.prefix, r.part] += 1
    assert all(n <= limit or most[k] == 1 for k, n in size.items())
    assert all(size[r.depth, r.prefix, r.part] == r.shard_bytes for r in got)
    return size


def test_sharding_fits_and_splits_only_what_is_too_large(spark, ugly, empty, tmp_path):
    got = sharding.assign_shards(ugly, 4_000).collect()
    assert len(got) == len(rows())
    size = check_shards(got, 4_000)
    by_depth = Counter()
    for (depth, prefix, part), n in size.items():
        if depth < sharding.HASH_BITS:
            by_depth[depth - 1, prefix >> 1] += n
    same = spark.createDataFrame([(1, "x" * 100)] * 500 + [(2, "y" * 90)], "doc_id bigint, text string")
    got = sharding.assign_shards(same, 1_000).collect()
    check_shards(got, 1_000)
    assert len(got) == 501
    sharding.write_shards(ugly, 4_000, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows())
    assert sharding.assign_shards(empty, 10).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    from oracle_check import compare, duck

    assert compare(spark, duck(SF), name, SF)[0] is None


def test_native_plans_hold_no_python(spark, ugly):
    for table in (line_dedup.deduplicate_lines(ugly), sharding.assign_shards(ugly, 4_000)):
        plan = table._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages_match_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, minhash.settle(stage(spark, docs, SF))
        counts[name] = docs.count()
        if name != "bpe_encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            failed = {d for d, t in docs_of(spark) if base_rules(t)[-1]}
            assert not failed & {r.doc_id for r in docs.collect()}
        if name == "minhash_near_dedup":
            kept = {r.doc_id for r in docs.collect()}
            data = [(r.doc_id, r.text) for r in before.collect()]
            sets = {d: shingles(t) for d, t in data}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert kept == {d for d, c in brute_components(set(sets), links).items() if d == c}
        if name == "bpe_encoding":
            texts = Counter((r.doc_id, r.text) for r in before.collect())
            assert Counter(r.doc_id for r in docs.collect()) == Counter(d for d, _ in texts.elements())
    assert corpus_pipeline.run(spark, SF).count() == counts["bpe_encoding"]
