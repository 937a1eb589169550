"""Store, matching and scan operators of the third round: exact answers where one key is hot, and linear plans."""

from __future__ import annotations

import json
import random
import re
import time
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from balsam.operators import scans, segmentation, store, windows
from balsam.sources import readers


def related_fixture(seed: int, n: int = 60):
    rng = random.Random(seed)
    categories = [("c1", "all > x > a"), ("c2", "all > x > b"), ("c3", "all > y > c"), ("", ""), ("c1", "all > z > d")]
    products, records, items, states = [], [], [], []
    for p in range(n):
        category, path = categories[rng.randrange(5)]
        products.append((p, f"s{p % 2}", f"e{p:03d}", category, path, f"2024-01-{1 + rng.randrange(3):02d}"))
        options = [""] if rng.random() < 0.3 else [f"o{i}" for i in range(rng.randrange(1, 4))]
        states.append((p, "not_applicable" if options == [""] else "ready", 0 if options == [""] else len(options), "2030-01-01"))
        for o in options:
            records.append((p, o, f"Option {o}", "2030-01-01"))
            names = [f"hot{rng.randrange(4)}" for _ in range(rng.randrange(1, 4))] + [f"rare{rng.randrange(40)}" for _ in range(rng.randrange(3))]
            for i, name in enumerate(dict.fromkeys(names)):
                items.append((p, o, i, name.upper() if rng.random() < 0.5 else name, name))
    seeds = [(r, i, name) for r in range(n) for i, name in enumerate(dict.fromkeys(x[4] for x in items if x[0] == r and rng.random() < 0.8))]
    return products, records, items, states, seeds


def parent(path):
    parts = [x.strip() for x in path.split(">") if x.strip()]
    return parts[:-1] or None


def brute_related(products, items, seeds, limit):
    at = {p[0]: p for p in products}
    out = []
    for request, me in at.items():
        names = [s[2] for s in sorted(seeds) if s[0] == request]
        scored = []
        for p, other in at.items():
            own = [x for x in items if x[0] == p and x[4] in names]
            if p == request or not own:
                continue
            level = 0 if me[3] and me[3] == other[3] else 1 if parent(me[4]) and parent(me[4]) == parent(other[4]) else 2
            options = sorted({x[1] for x in own} - {""})
            spell = lambda rows: tuple(next((x[3] for x in sorted(rows) if x[4] == n)) for n in names if any(x[4] == n for x in rows))
            found = tuple((o, f"Option {o}", spell([x for x in own if x[1] == o])) for o in options)
            scored.append((level, -len({x[4] for x in own}), -len(options), [-ord(c) for c in other[5]], other[1], other[2], p, found, spell(own)))
        out += [(request, i, s[6], found, names_) for i, s in enumerate(sorted(scored)[:limit], 1) for found, names_ in [s[7:9]]]
    return Counter(out)


def test_related_products_match_brute_force_with_hot_names(spark):
    """Names of a third of all products go by profiles, rare ones by postings; the answer is that of all pairs."""
    for seed, hot, limit in ((1, 10, 5), (2, 0, 3), (3, 10_000, 5), (4, 14, 2)):
        products, records, items, states, seeds = related_fixture(seed)
        frames = [spark.createDataFrame(rows, schema) for rows, schema in (
            (products, "product_id long, source string, external_id string, category string, category_path string, updated_at string"),
            (states, "product_id long, status string, option_count int, expires_at string"),
            (records, "product_id long, option_id string, option_name string, expires_at string"),
            (items, "product_id long, option_id string, position long, ingredient_name string, normalized_name string"),
            (seeds, "request_id long, seed_pos long, name string"))]
        p, s, r, i, seed_rows = [f.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz")) if "expires_at" in f.columns else f for f in frames]
        requests = p.select(F.col("product_id").alias("request_id"), "product_id", "category", "category_path")
        got = store.related_products(requests, seed_rows, p, s, r, i, "2025-01-01", limit=limit, hot_postings=hot).collect()
        assert brute_related(products, items, seeds, limit) == Counter(
            (x.request_id, x["rank"], x.product_id, tuple((o.option_id, o.option_name, tuple(o.matched_ingredients)) for o in x.matched_options),
             tuple(x.matched_ingredients)) for x in got)
        assert all(x.n_matched == len(x.matched_ingredients) and x.n_options == len(x.matched_options) for x in got)


def embedded(spark, *scripts):
    rows = spark.createDataFrame([(1, n, s) for n, s in enumerate(scripts)], "product_id long, script_no int, script string")
    return [(r.option_number, r.option_name) for r in readers.extract_embedded_json(rows).orderBy("seq").collect()]


def test_embedded_options_are_read_from_whole_objects_only(spark):
    option = '{"optionNumber":"1","optionName":"A"}'
    assert embedded(spark, "var x = {a: " + option + "};") == []  # the outermost object is not JSON
    assert embedded(spark, "f(" + option + ', {"optionNumber":"2","optionName":"B } {"}); // }') == [("1", "A"), ("2", "B } {")]
    assert embedded(spark, 'var s = "{"; var x = {"list":[' + option + "]};") == [("1", "A")]
    assert embedded(spark, 'x = {"open": "no end ' + option) == []
    assert embedded(spark, 'x = "trailing \\') == [] and embedded(spark, None, "") == []
    pushed = readers.PUSH_MARKER + json.dumps([1, "5:" + '{"optionList":[' + option + "]}"]) + ")"
    assert embedded(spark, pushed) == [("1", "A")]
    assert embedded(spark, pushed.replace(readers.PUSH_MARKER, "other.push(")) == []
    assert embedded(spark, json.dumps({"goodsNumber": "1", "o": json.loads(option)})) == [("1", "A")]


def test_embedded_options_are_found_in_linear_time():
    scan = readers._option_scanner(readers.OPTION_KEYS, readers.OWNER_KEYS, readers.COMBINATION_KEY).func

    def seconds(n: int) -> float:
        script = pd.Series(["optionNumber {a: " + '{"x": "y"} ' * n + '"' + "\\\\" * n])
        start = time.perf_counter()
        assert scan(script)[0] == []
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(400_000) < 40 * max(seconds(20_000), 0.002)


def test_text_search_folds_ascii_letters_only(spark):
    rows = spark.createDataFrame([("ÄBC", "äbc"), ("Éclat", "éclat"), ("AbC", "abc")], "a string, b string")
    got = rows.select((store._ascii_lower("a") == store._ascii_lower("b")).alias("same")).collect()
    assert [r.same for r in got] == [False, False, True]


def scan_rows(n: int = 4000):
    """One group with nearly all rows, sparse 64-bit order values, nulls and repeated numbers."""
    rng = random.Random(7)
    at = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)})
    return [("all" if rng.random() < 0.97 else None if rng.random() < 0.5 else "few", t, rng.choice([None, f"v{i}"]) if i > 30 else None,
             rng.randrange(20) if rng.random() < 0.9 else None, rng.choice(["a", "b", None])) for i, t in enumerate(at)]


def test_scans_of_one_group_spread_over_blocks(spark):
    rows = scan_rows()
    df = spark.createDataFrame(rows, "g string, t long, v string, n int, label string").repartition(5)
    fill, group, steps = {}, {}, Counter()
    last, top, label, count, prev, rises = {}, {}, {}, Counter(), {}, {}
    for g, t, v, n, name in rows:
        last[g] = v if v is not None else last.get(g)
        fill[t] = last[g]
        if n is not None and top.get(g) is not None and n <= top[g] and (g not in label or label[g] != name):
            count[g] += 1
        group[t] = count[g]
        rises[g] = rises.get(g, True) and not (g in prev and prev[g] is not None and n is not None and n < prev[g])
        prev[g], label[g] = n, name
        top[g] = n if top.get(g) is None else top[g] if n is None else max(top[g], n)
        steps[g] += 1
    assert {r.t: r.v for r in windows.forward_fill(df, "g", "t", ["v"]).collect()} == fill
    assert {r.t: r.o for r in windows.restart_groups(df, "g", "t", "n", "label", "o").collect()} == group
    assert {r.g: (r.n_rows, r.is_monotonic) for r in windows.monotonic(df, "g", "t", "n").collect()} == {g: (steps[g], rises[g]) for g in steps}
    sizes = [r["count"] for r in scans.Blocks(df, ["g"], ["t"], parts=16).rows.where("g = 'all'").groupBy(scans.BLOCK).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 0.3 * len(rows)


def test_numbers_of_sparse_keys_need_no_more_blocks(spark):
    rows = [(t,) for _, t, *_ in scan_rows()]
    df = spark.createDataFrame(rows, "t long").repartition(6)
    got = windows.global_number(df, "t", "n")
    assert {r.t: r.n for r in got.collect()} == {t: i for i, (t,) in enumerate(sorted(rows), 1)}
    assert windows.global_number(df.where("1 = 0"), "t", "n").collect() == []


def needle(option, level, text, mapped):
    return {"option_pos": option, "level": level, "needle": text, "in_mapping_text": mapped}


def test_all_keys_of_a_document_are_found_in_one_pass():
    text = "A1 one, [A1]) x\nAA1 호 a1\nplain B2"
    got = segmentation.occurrences(text, [needle(0, 0, "a1", True), needle(0, 1, "a1one", False), needle(1, 0, "zz9", True),
                                          needle(1, 1, "plainb2", False), needle(2, 3, "a1", True), needle(3, 0, "", True)])
    spans = {(o, level): [(s, e, p, c) for x, y, _, s, e, p, c in got if (x, y) == (o, level)] for o, level, *_ in got}
    assert spans[1, 1] == [(25, 33, "", 0)] and set(spans) == {(0, 0), (1, 1), (2, 3)}
    assert spans[0, 0] == spans[2, 3] == [(0, 2, "", 0), (9, 11, ",[", 2), (17, 19, "A", 0), (22, 24, "AA1 호 ", 0)]
    assert segmentation.occurrences(None, [needle(0, 0, "a1", True)]) == [] and segmentation.occurrences("x", []) == []


def test_documents_with_many_headers_take_linear_time():
    def seconds(n: int) -> float:
        text = "\n".join(f"H{i:06d}x Water, Glycerin" for i in range(n))
        wanted = [needle(i, 0, f"h{i:06d}x", True) for i in range(n)] + [needle(i, 1, f"h{i:06d}x", False) for i in range(n)]
        start = time.perf_counter()
        assert len(segmentation.occurrences(text, wanted)) == n
        return time.perf_counter() - start

    seconds(1_000)
    small = min(seconds(10_000) for _ in range(2))
    assert seconds(40_000) < 6 * small


def test_rule_assertions_read_the_aliases_once(spark, tmp_path):
    from balsam.operators import quality

    rows = [("a", "g", ["One  two", "three", "three"]), ("b", "g", ["THREE", "four"]), ("c", "g", None), ("c", "h", ["five"]), (None, "g", ["four"])]
    spark.createDataFrame(rows, "rule_id string, canonical_group string, aliases array<string>").write.parquet(str(tmp_path / "rules"))
    rules = spark.read.parquet(str(tmp_path / "rules"))
    profiles = spark.createDataFrame([(["g", "x"], None), (None, ["h"])], "helpful_function_groups array<string>, caution_function_groups array<string>")
    need = {"a": ["one two", "four"], "b": [f"word {i}" for i in range(30)], "absent": ["three"]}
    bar = {"a": ["three", "five"], "c": ["five"]}
    out = quality.check_rule_dataset(rules, profiles, ["four"], need, bar)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^\n]*aliases", plan)) == 1
    want = [("duplicate rule", "c"), ("unknown group", "x"), ("shared alias", "three"), ("alias missing", "a: four"),
            ("alias missing", "absent: three"), ("alias forbidden", "a: three"), ("alias forbidden", "c: five")]
    want += [("alias missing", f"b: word {i}") for i in range(30)]
    assert sorted((r.check, r.value) for r in out.collect()) == sorted(want)
    assert quality.check_rule_dataset(rules.limit(0), profiles.limit(0), [], {"a": ["w"]}).collect() == [("alias missing", "a: w")]
