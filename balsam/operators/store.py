"""Product store: validity, completeness, searches and related products.

Tables: products (product_id, source, external_id, product_name, name_key, brand_name, category,
category_path, updated_at), records (product_id, option_id, option_name, …, expires_at), items
(product_id, option_id, position, ingredient_name, normalized_name), states (product_id, status,
option_count, parser_version, options_json, expires_at, …), searches (query_key, searched_at,
expires_at), results (query_key, product_id, rank).  `option_id` is '' for a product without options.

A row is valid while expires_at > as_of; `as_of` is a parameter, never the clock."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.settle import settle
from ..functions.text import strip
from .windows import keep_first, top_k

FINISHED = ("ready", "not_applicable")
RECORD_KEY = ["product_id", "option_id"]


def moment(as_of: str | datetime | Column) -> Column:
    """A point in time as UTC without zone."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def valid_records(records: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """Unexpired records that have at least one item."""
    return records.filter(F.col("expires_at") > moment(as_of)).join(
        items.select(*RECORD_KEY).distinct(), RECORD_KEY, "left_semi"
    )


def complete_products(
    states: DataFrame, records: DataFrame, items: DataFrame, as_of, include_legacy: bool = False
) -> DataFrame:
    """(product_id, kind) of products whose stored list is whole.

    not_applicable: exactly one record without option, and an option count of 0; ready: as many
    valid options as the count says; legacy: no state at all, but a valid record."""
    counts = valid_records(records, items, as_of).groupBy("product_id").agg(
        F.count_if(F.col("option_id") == "").alias("n_common"),
        F.count_if(F.col("option_id") != "").alias("n_options"),
    )
    kept = states.select("product_id", "status", "option_count", F.col("expires_at").alias("until"))
    out = kept.join(counts, "product_id", "full_outer" if include_legacy else "left")
    n_common, n_options = (F.coalesce(c, F.lit(0)) for c in ("n_common", "n_options"))
    alive = F.col("until") > moment(as_of)
    kind = (
        F.when(F.col("status").isNull(), F.lit("legacy") if include_legacy else F.lit(None).cast("string"))
        .when(alive & (F.col("status") == "not_applicable") & (F.col("option_count") == 0)
              & (n_common == 1), "not_applicable")
        .when(alive & (F.col("status") == "ready") & (n_options == F.col("option_count")), "ready")
    )
    return out.select("product_id", kind.alias("kind")).filter("kind IS NOT NULL")


def complete_records(
    states: DataFrame, records: DataFrame, items: DataFrame, as_of, include_legacy: bool = False
) -> DataFrame:
    """Valid records that count for their complete product."""
    complete = complete_products(states, records, items, as_of, include_legacy)
    return (
        valid_records(records, items, as_of).join(complete, "product_id")
        .filter((F.col("kind") == "legacy")
                | ((F.col("kind") == "not_applicable") & (F.col("option_id") == ""))
                | ((F.col("kind") == "ready") & (F.col("option_id") != "")))
        .drop("kind")
    )


def cached_ingredients(
    requests: DataFrame, products: DataFrame, records: DataFrame, items: DataFrame
) -> DataFrame:
    """Stored items of requested (request_id, source, external_id, option_id), in position order.

    One row per item rather than one list per record, so a long list stays many rows."""
    wanted = requests.select(
        "request_id", strip("source").alias("source"), strip("external_id").alias("external_id"),
        strip(F.coalesce("option_id", F.lit(""))).alias("option_id"),
    )
    found = wanted.join(products.select("product_id", "source", "external_id"),
                        ["source", "external_id"])
    return found.join(records.select(*RECORD_KEY, "expires_at"), RECORD_KEY).join(
        items, RECORD_KEY
    ).select("request_id", "product_id", "option_id", "position", "ingredient_name", "expires_at")


def products_with_ingredient(
    requests: DataFrame, items: DataFrame, limit: int = 10
) -> DataFrame:
    """Up to `limit` products per request (request_id, name) that hold the ingredient.

    The reference leaves their order open; here it is the product id.  The limit is applied per
    ingredient, before requests for the same ingredient meet it."""
    wanted = requests.select("request_id", keys.item_key("name").alias("normalized_name")).filter(
        "normalized_name <> ''")
    hits = items.select("normalized_name", "product_id").distinct()
    best = top_k(hits, "normalized_name", "product_id", limit)
    return wanted.join(best, "normalized_name").select("request_id", "product_id")


def _path_parts(c: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ">"),
                        lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def parent_path(c: Column | str) -> Column:
    """The path without its last part; null when there is no parent."""
    parts = _path_parts(c)
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > "))


def category_match_level(category, path, other_category, other_path) -> Column:
    """same_category, then same_parent_path, then other_category."""
    return _match_level(category, parent_path(path), other_category, parent_path(other_path))


def _match_level(category, parent, other_category, other_parent) -> Column:
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    return (
        F.when((c(category) != "") & c(category).eqNullSafe(c(other_category)), "same_category")
        .when(c(parent) == c(other_parent), "same_parent_path")
        .otherwise("other_category")
    )


# Rank of a category match level.
LEVEL_RANK = {"same_category": 0, "same_parent_path": 1, "other_category": 2}


#: Products that hold a name before it is looked up by profiles instead of its postings.
HOT_POSTINGS = 1_000
#: Shares that the profiles of a hot name are joined in.
HOT_SHARES = 16


def _level_rank(level: str | Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, n in LEVEL_RANK.items():
        rank = F.when((F.col(level) if isinstance(level, str) else level) == name, n).otherwise(rank)
    return rank


def _lists(category: Column, parent: Column) -> Column:
    """The candidate lists a product stands in, or a request reads: its category's, its parent path's, and all."""
    return F.array_compact(F.array(
        F.concat(F.lit("c:"), F.nullif(category, F.lit(""))), F.concat(F.lit("p:"), parent), F.lit("all")))


def _options_that_hold(profile: str, names: str) -> Column:
    """How many options of a profile hold one of the names."""
    return F.size(F.filter(profile, lambda o: o["is_option"] & F.arrays_overlap(o["names"], F.col(names))))


def _with_bits(word: str) -> Column:
    """The option bits of a name together with those of the hot names met."""
    return F.aggregate("both", F.col(word), lambda m, e: m.bitwiseOR(e[word]))


_RELATED_ORDER = [F.desc, F.desc, F.desc, F.asc, F.asc]
_RELATED_BY = ["n_matched", "n_options", "updated_at", "source", "external_id"]


def related_products(
    requests: DataFrame, seeds: DataFrame, products: DataFrame, states: DataFrame,
    records: DataFrame, items: DataFrame, as_of, limit: int = 5, include_legacy: bool = False,
    hot_postings: int = HOT_POSTINGS,
) -> DataFrame:
    """Best products that share seed ingredients with each request.

    requests: request_id, product_id (left out of its own result), category, category_path;
    seeds: request_id, seed_pos, name (normalised).  Order: category level, matched ingredients,
    matched options, update time, source, external id.  matched_ingredients are the product's stored
    spellings in seed order; matched_options has each option's id, name and own matched spellings.

    Names are looked up by rarity.  Those that at most `hot_postings` products hold are joined by
    their postings, which gives every product that shares one of them, hot names counted in.  What
    is left shares hot names only, so it matches no more than the request's hot names; a request
    whose places all went to its best level with more matches is done.  For the others, products
    with the same hot names in their options (a profile) tie but for their update time and ids, so
    limit + 1 of each profile and list stand for all, and each distinct set of hot names is matched
    with profiles, in shares, by partial counts.  A product's rank by hot names alone is no better
    than its true one, so whatever stands before it there stands before it in truth, and the lists
    cut at limit + 1 (one place for the request's own product) hold the exact answer."""
    order = [by(c) for by, c in zip(_RELATED_ORDER, _RELATED_BY, strict=True)]
    clean = settle(keep_first(
        seeds.select("request_id", "seed_pos", strip("name").alias("name")).filter("name <> ''"),
        ["request_id", "name"], "seed_pos"))
    usable = complete_records(states, records, items, as_of, include_legacy)
    option_name = F.col("option_name") if "option_name" in records.columns else F.lit(None).cast("string")
    usable = usable.select(*RECORD_KEY, option_name.alias("option_name"))
    asked_names = clean.select(F.col("name").alias("normalized_name")).distinct()
    held = settle(items.join(asked_names, "normalized_name", "left_semi").join(usable, RECORD_KEY).select(
        *RECORD_KEY, "option_name", "position", "ingredient_name", "normalized_name"))
    names = held.select("product_id", "option_id", "normalized_name").distinct()
    hot = settle(held.groupBy("normalized_name").agg(F.count_distinct("product_id").alias("n")).filter(
        F.col("n") > hot_postings).select("normalized_name"))
    rows = products.select("product_id", "source", "external_id", "category", "category_path", "updated_at")

    # Hot names: a request's as one sorted array, a product's as a profile of its options.
    hot_of = clean.join(hot, F.col("name") == F.col("normalized_name"), "left_semi").groupBy("request_id").agg(
        F.sort_array(F.collect_set("name")).alias("hot_names"))
    per_option = names.join(hot, "normalized_name", "left_semi").groupBy("product_id", "option_id").agg(
        F.sort_array(F.collect_set("normalized_name")).alias("names"))
    profile_of = settle(per_option.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("option_id") != "").alias("is_option"), "names"))).alias("profile")))
    asked = settle(requests.select(
        "request_id", F.col("product_id").alias("self_id"), F.col("category").alias("want_category"),
        F.col("category_path").alias("want_path"),
    ).join(clean.select("request_id").distinct(), "request_id", "left_semi").join(hot_of, "request_id", "left"))

    def placed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(~F.col("product_id").eqNullSafe(F.col("self_id")))
        level = _match_level("want_category", "want_parent", "category", "parent")
        return pairs.withColumn("category_match_level", level).withColumn("__level", _level_rank("category_match_level")).select(
            "request_id", "product_id", "category_match_level", "__level", *_RELATED_BY)

    # By the postings of rare names.  A product's options are bits of one or more words, so that the matched ones are
    # counted by an aggregate of numbers; hot names that both sides hold are added to each pair as it is met.
    numbered = names.filter("option_id <> ''").select("product_id", "option_id").distinct().withColumn(
        "bit", F.row_number().over(Window.partitionBy("product_id").orderBy("option_id")) - 1)
    numbered = settle(numbered)
    words = [f"__w{i}" for i in range(1 + (numbered.agg(F.max("bit")).first()[0] or 0) // 63)]
    bits = [F.coalesce(F.when(F.floor(F.col("bit") / 63) == i, F.expr("shiftleft(1L, bit % 63)")), F.lit(0).cast("bigint")).alias(w)
            for i, w in enumerate(words)]
    postings = settle(names.join(numbered, RECORD_KEY, "left").select("product_id", "normalized_name", *bits).groupBy(
        "product_id", "normalized_name").agg(*[F.bit_or(w).alias(w) for w in words]))
    hot_entries = postings.join(hot, "normalized_name", "left_semi").groupBy("product_id").agg(
        F.collect_list(F.struct("normalized_name", *words)).alias("hot_entries"))
    rare = clean.select("request_id", F.col("name").alias("normalized_name")).join(hot, "normalized_name", "left_anti")
    offered = postings.join(hot, "normalized_name", "left_anti").join(
        rows.select("product_id", "category", parent_path("category_path").alias("parent"), "updated_at"), "product_id").join(
        hot_entries, "product_id", "left")
    # Paths are parsed once a side, not once a pair.
    met = settle(offered).join(settle(rare.join(asked, "request_id").withColumn("want_parent", parent_path("want_path"))), "normalized_name").filter(~F.col("product_id").eqNullSafe(F.col("self_id")))
    both = F.filter("hot_entries", lambda e: F.array_contains("hot_names", e["normalized_name"]))
    met = met.select(
        "request_id", "product_id", "updated_at", _level_rank(_match_level(
            "want_category", "want_parent", "category", "parent")).alias("__level"),
        F.coalesce(both, F.array().cast(hot_entries.schema["hot_entries"].dataType)).alias("both"), *words)
    met = met.select("request_id", "product_id", "updated_at", "__level", F.size("both").alias("n_hot"), *[
        _with_bits(w).alias(w) for w in words])
    counted = met.repartition("request_id").groupBy("request_id", "product_id").agg(
        F.min("__level").alias("__level"), F.max("updated_at").alias("updated_at"),
        (F.count("*") + F.max("n_hot")).cast("int").alias("n_matched"), *[F.bit_or(w).alias(w) for w in words])
    counted = counted.withColumn("n_options", reduce(Column.__add__, [F.bit_count(w) for w in words])).drop(*words)
    # Ties but for the ids stay; the ids join what is left.
    near = Window.partitionBy("request_id").orderBy("__level", F.desc("n_matched"), F.desc("n_options"), F.desc("updated_at"))
    counted = counted.withColumn("near", F.rank().over(near)).filter(F.col("near") <= limit).drop("near")
    names_of_level = F.element_at(F.array(*[F.lit(n) for n in LEVEL_RANK]), F.col("__level") + 1)
    counted = counted.join(rows.select("product_id", "source", "external_id"), "product_id").select(
        "request_id", "product_id", names_of_level.alias("category_match_level"), "__level", *_RELATED_BY)
    best = settle(top_k(counted, "request_id", ["__level", *order], limit))

    # Requests with hot names whose places are not all taken by more matches at their best level.
    best_level = F.when(F.col("want_category") != "", 0).when(parent_path("want_path").isNotNull(), 1).otherwise(2)
    taken = best.groupBy("request_id").agg(F.count("*").alias("n"), F.max("__level").alias("worst"), F.min("n_matched").alias("least"))
    done = (F.col("n") >= limit) & (F.col("worst") <= best_level) & (F.col("least") > F.size("hot_names"))
    still = asked.filter("hot_names IS NOT NULL").join(taken, "request_id", "left").filter(~F.coalesce(done, F.lit(False)))
    still = still.withColumn("hot_id", F.sha2(F.concat_ws("\x1f", "hot_names"), 256)).withColumn(
        "want_parent", parent_path("want_path")).withColumn("list", F.explode(_lists(F.col("want_category"), F.col("want_parent"))))
    still = settle(still.select("request_id", "self_id", "want_category", "want_parent", "hot_id", "hot_names", "list"))

    # Profiles stand for their products.
    profiled = profile_of.withColumn("profile_id", F.sha2(F.to_json("profile"), 256)).join(rows, "product_id").withColumn(
        "parent", parent_path("category_path")).withColumn("list", F.explode(_lists(F.col("category"), F.col("parent"))))
    few = settle(top_k(profiled, ["profile_id", "list"], order[2:], limit + 1))
    profiles = few.select("profile_id", "profile").dropDuplicates(["profile_id"])
    shares = F.explode(F.sequence(F.lit(0), F.lit(HOT_SHARES - 1)))
    left = still.select("hot_id", F.explode("hot_names").alias("name")).distinct().withColumn("share", shares)
    right = profiles.select("profile_id", F.explode(F.array_distinct(F.flatten(F.transform("profile", lambda o: o["names"])))).alias("name"))
    right = right.withColumn("share", F.pmod(F.xxhash64("profile_id"), F.lit(HOT_SHARES)).cast("int"))
    met = left.join(right, ["name", "share"]).groupBy("hot_id", "profile_id").agg(F.count("*").cast("int").alias("n_matched"))
    sets = still.select("hot_id", "hot_names").dropDuplicates(["hot_id"])
    met = met.join(sets, "hot_id").join(profiles, "profile_id").withColumn("n_options", _options_that_hold("profile", "hot_names"))
    lists = still.select("hot_id", "list").distinct()
    stand = met.select("hot_id", "profile_id", "n_matched", "n_options").join(few.drop("profile"), "profile_id").join(
        lists, ["hot_id", "list"], "left_semi")
    stand = top_k(stand, ["hot_id", "list"], order, limit + 1)
    by_hot = placed(still.drop("hot_names").join(stand, ["hot_id", "list"]))

    # A product found both ways, or in several lists, keeps its full count.
    # Both steps find a request's rows together.
    both = keep_first(best.unionByName(by_hot).repartition("request_id"), ["request_id", "product_id"], [F.desc("n_matched"), F.desc("n_options")])
    ranked = settle(top_k(both, "request_id", ["__level", *order], limit, rank_col="rank").select(
        "request_id", "rank", "product_id", "category_match_level"))

    # Stored spellings, for the places of the result only.  A product's do not depend on the request: they are found once
    # and meet a request's seeds as one array each, so a place stays one row.  A seed's place is that in its array.
    spelled = held.groupBy(*RECORD_KEY, "option_name", "normalized_name").agg(
        F.min_by("ingredient_name", F.struct("position", "ingredient_name")).alias("spelling"))
    entries = spelled.groupBy("product_id").agg(
        F.collect_list(F.struct("normalized_name", "option_id", "spelling", "option_name")).alias("entries"))
    seeds_of = clean.groupBy("request_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("seed_pos", "name"))), lambda x: x["name"]).alias("names"))
    found = F.transform(F.filter("entries", lambda e: F.array_contains("names", e["normalized_name"])), lambda e: F.struct(
        F.array_position("names", e["normalized_name"]).alias("place"), *[
            e[c].alias(c) for c in ("normalized_name", "option_id", "spelling", "option_name")]))
    out = ranked.join(seeds_of, "request_id").join(entries, "product_id").select(
        "request_id", "rank", "product_id", "category_match_level", F.sort_array(found).alias("found")).filter(F.size("found") > 0)
    ids = F.sort_array(F.array_distinct(F.transform(F.filter("found", lambda x: x["option_id"] != ""), lambda x: F.struct(
        x["option_id"].alias("option_id"), x["option_name"].alias("option_name")))))
    own = lambda o: F.filter("found", lambda x: (x["option_id"] == o["option_id"]) & x["option_name"].eqNullSafe(o["option_name"]))
    options = F.transform(ids, lambda o: F.struct(
        o["option_id"].alias("option_id"), o["option_name"].alias("option_name"),
        F.transform(own(o), lambda x: x["spelling"]).alias("matched_ingredients")))
    # The first option's spelling of a name is the product's.
    first = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1)["normalized_name"] != x["normalized_name"]))
    out = out.withColumns({"matched_options": options, "matched_ingredients": F.transform(first, lambda x: x["spelling"])})
    return out.select(
        "request_id", "rank", "product_id", "category_match_level", F.size("matched_ingredients").alias("n_matched"),
        F.size("matched_options").alias("n_options"), "matched_options", "matched_ingredients")


# --- substring search --------------------------------------------------------------------------

_GRAM = 3


def _grams(c: Column, n: Column | int) -> Column:
    """Distinct substrings of length n."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substr(c, i, n))))


def contains_join(
    texts: DataFrame, text: str, needles: DataFrame, needle: str
) -> DataFrame:
    """Distinct (text, needle) where the text contains the needle, without comparing all pairs.

    A text that contains a needle holds every short substring of it.  Each needle is looked up by
    its rarest substring of (up to) three characters, and the hits are then verified."""
    sized = F.concat(*[
        F.coalesce(_grams(F.col(text), n), F.array().cast("array<string>"))
        for n in range(1, _GRAM + 1)
    ])
    distinct = needles.select(F.col(needle).alias("__needle")).filter("__needle <> ''").distinct()
    probes = distinct.withColumn("__gram", F.explode(_grams(
        F.col("__needle"), F.least(F.length("__needle"), F.lit(_GRAM)))))
    # Equal texts are looked at once, and only by substrings that some needle asks for.
    index = texts.select(text).distinct().select(text, F.explode(sized).alias("__gram")).join(
        probes.select("__gram").distinct(), "__gram", "left_semi")
    frequency = index.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = keep_first(
        probes.join(frequency, "__gram"), "__needle", ["__n", "__gram"]
    ).select("__needle", "__gram")
    found = index.join(rarest, "__gram").filter(F.col(text).contains(F.col("__needle")))
    return found.select(text, F.col("__needle").alias(needle))


def _ascii_lower(c: Column | str) -> Column:
    """A-Z in lower case and all else as it is, as a substring search compares."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _newest_hits(
    queries: DataFrame, products: DataFrame, brand_needle: Column, limit: int
) -> DataFrame:
    """(query_id, product_id, rank): newest products whose name key or brand contains the query
    (ASCII case ignored).

    Queries with the same needles share one result, so it is found and cut once."""
    asked = queries.select(
        "query_id", keys.product_name_key("query").alias("name_needle"),
        _ascii_lower(brand_needle).alias("brand_needle"),
    ).filter("name_needle <> ''")
    wanted = asked.select("name_needle", "brand_needle").distinct()
    rows = products.select("product_id", "name_key", _ascii_lower("brand_name").alias("brand"), "updated_at")
    order = [F.desc("updated_at"), "product_id"]

    def found(text: str, needle: str) -> DataFrame:
        # Only the newest `limit` products of one text can be among the newest of a needle.
        newest = top_k(rows, text, order, limit)
        return contains_join(rows, text, wanted, needle).join(wanted, needle).join(newest, text)

    by_name, by_brand = found("name_key", "name_needle"), found("brand", "brand_needle")
    columns = ["name_needle", "brand_needle", "product_id", "updated_at"]

    def best(df: DataFrame) -> DataFrame:
        return top_k(df.select(*columns), ["name_needle", "brand_needle"], order, limit)

    # Each way is cut on its own first; a product found by both ways counts once.
    both = best(by_name).unionByName(best(by_brand)).distinct()
    ranked = top_k(both, ["name_needle", "brand_needle"], order, limit, rank_col="rank")
    return asked.join(ranked, ["name_needle", "brand_needle"]).select("query_id", "product_id", "rank")


def _searchable(products: DataFrame) -> DataFrame:
    """The columns a text search reads, written once: both needles read them several times."""
    return settle(products.select("product_id", "name_key", "brand_name", "updated_at"))


def search_complete(
    queries: DataFrame, products: DataFrame, states: DataFrame, records: DataFrame,
    items: DataFrame, as_of, limit: int = 5,
) -> DataFrame:
    """Newest complete products whose name or brand contains the query.

    Completeness is checked before the limit."""
    complete = complete_products(states, records, items, as_of).select("product_id")
    usable = _searchable(products.join(complete, "product_id", "left_semi"))
    return _newest_hits(queries, usable, keys.product_name_key("query"), limit)


def search_products(
    queries: DataFrame, products: DataFrame, searches: DataFrame, results: DataFrame,
    states: DataFrame, as_of, limit: int = 10,
) -> DataFrame:
    """Newest products by name or brand that an unexpired search lists or whose collection is
    finished and unexpired."""
    now = moment(as_of)
    listed = results.join(searches.filter(F.col("expires_at") > now), "query_key", "left_semi")
    finished = states.filter((F.col("expires_at") > now) & F.col("status").isin(*FINISHED))
    valid = listed.select("product_id").unionByName(finished.select("product_id")).distinct()
    usable = _searchable(products.join(valid, "product_id", "left_semi"))
    return _newest_hits(queries, usable, strip("query"), limit)


def cached_search(queries: DataFrame, searches: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Products of each query's unexpired search by rank; a hit without products is one row with a
    null product."""
    live = searches.filter(F.col("expires_at") > moment(as_of))
    return (
        queries.select("query_id", keys.product_name_key("query").alias("query_key"))
        .join(live, "query_key").join(results, "query_key", "left")
        .select("query_id", "query_key", "product_id", "rank", "searched_at")
    )


# Fixed value: rows a search shows at most.
MAX_LIMIT = 10


def clamp_limit(c: Column | str, low: int = 1, high: int = MAX_LIMIT) -> Column:
    return F.greatest(F.lit(low), F.least(F.col(c) if isinstance(c, str) else c, F.lit(high)))


def resolve_searches(
    queries: DataFrame, products: DataFrame, searches: DataFrame, results: DataFrame,
    states: DataFrame, as_of, live_results: DataFrame | None = None,
) -> DataFrame:
    """Result of each query (query_id, query, result_limit) and where it came from.

    search_cache, then product_cache (stored products by text), then the live provider's rows
    (query_id, product_id, rank), then an empty search_cache miss.  A later stage only sees the
    queries that no earlier stage answered."""
    asked = queries.withColumn("result_limit", clamp_limit("result_limit"))
    # A result's place depends on its key alone, so a key is cut to the largest limit before any query meets it.
    shown = top_k(results, "query_key", [F.col("rank").asc_nulls_last(), "product_id"], MAX_LIMIT)
    cached = cached_search(asked, searches, shown, as_of)
    first = cached.select("query_id", "product_id", "rank", F.lit("search_cache").alias("provider"),
                          F.lit(True).alias("cache_hit"))
    missed = asked.join(cached.select("query_id").distinct(), "query_id", "left_anti")
    stored = settle(search_products(missed, products, searches, results, states, as_of))
    second = stored.select("query_id", "product_id", "rank", F.lit("product_cache").alias("provider"),
                           F.lit(True).alias("cache_hit"))
    still = missed.join(stored.select("query_id").distinct(), "query_id", "left_anti")
    if live_results is None:
        third = still.select(
            "query_id", F.lit(None).cast("bigint").alias("product_id"),
            F.lit(None).cast("int").alias("rank"), F.lit("search_cache").alias("provider"),
            F.lit(False).alias("cache_hit"))
    else:
        third = still.select("query_id").join(live_results, "query_id", "left").select(
            "query_id", "product_id", "rank", F.lit("provider").alias("provider"),
            F.lit(False).alias("cache_hit"))
    out = first.unionByName(second).unionByName(third)
    # Ranks may have gaps, so the cut counts rows; the largest allowed limit bounds it.
    cut = top_k(
        out.join(asked.select("query_id", "result_limit"), "query_id"), "query_id",
        [F.col("rank").asc_nulls_last(), "product_id"], MAX_LIMIT, rank_col="shown_at")
    return cut.filter("shown_at <= result_limit").drop("result_limit")


# --- restored options ----------------------------------------------------------------------------

OPTION_METADATA = T.ArrayType(T.StructType([
    T.StructField("internal_option_key", T.StringType()),
    T.StructField("source_option_id", T.StringType()),
    T.StructField("raw_option_name", T.StringType()),
    T.StructField("normalized_name", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("source_option_names", T.ArrayType(T.StringType())),
    T.StructField("source_option_ids", T.ArrayType(T.StringType())),
    T.StructField("product_id", T.StringType()),
    T.StructField("option_number", T.StringType()),
    T.StructField("standard_code", T.StringType()),
    T.StructField("normalized_option_name", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("sold_out_flag", T.BooleanType()),
    T.StructField("dom_disabled", T.BooleanType()),
    T.StructField("sort_order", T.IntegerType()),
    T.StructField("representative", T.BooleanType()),
    T.StructField("group_path", T.ArrayType(T.StringType())),
    T.StructField("combination_option_flag", T.BooleanType()),
]))


def restore_options(records: DataFrame, states: DataFrame) -> DataFrame:
    """Option records with their stored metadata; unreadable metadata counts as none."""
    entries = states.select(
        "product_id", F.posexplode(F.from_json("options_json", OPTION_METADATA)).alias("__p", "m")
    ).filter("m.internal_option_key <> ''")
    # The last entry of a key wins.
    meta = keep_first(
        entries.withColumn("option_id", F.col("m.internal_option_key")), RECORD_KEY, F.desc("__p"))
    empty = F.array().cast("array<string>")
    return records.filter("option_id <> ''").join(meta.drop("__p"), RECORD_KEY, "left").select(
        *RECORD_KEY,
        F.coalesce(F.nullif("option_name", F.lit("")), "option_id").alias("option_name"),
        "m.source_option_id", "m.raw_option_name", "m.normalized_name", "m.image_url",
        F.coalesce("m.source_option_names", empty).alias("source_option_names"),
        F.coalesce("m.source_option_ids", empty).alias("source_option_ids"),
        "m.option_number", "m.standard_code",
        F.coalesce("m.normalized_option_name", F.lit("")).alias("normalized_option_name"),
        F.coalesce("m.availability", F.lit("unknown")).alias("availability"),
        "m.sold_out_flag", "m.dom_disabled", "m.sort_order", "m.representative",
        F.coalesce("m.group_path", empty).alias("group_path"), "m.combination_option_flag",
        F.coalesce("cache_status", F.lit("ready")).alias("status"),
    )


def enrich_candidates(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Manifest values, completed from the stored product; entries without any name get a reason."""
    stored = products.select(
        "source", "external_id", *[F.col(c).alias(f"__{c}") for c in
                                   ("product_name", "brand_name", "category", "category_path", "image_url")])

    def pick(*cs: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])

    out = entries.withColumns({"source": strip("source"), "external_id": strip("external_id")}).join(
        stored, ["source", "external_id"], "left")
    name = pick("product_name", "label", "__product_name")
    return out.select(
        "source", "external_id", strip("product_url").alias("product_url"), name.alias("product_name"),
        pick("brand_name", "__brand_name").alias("brand_name"),
        F.coalesce(pick("category", "__category"), F.lit("unknown")).alias("category"),
        pick("category_path", "__category_path").alias("category_path"),
        pick("image_url", "__image_url").alias("image_url"),
        F.when(name.isNull(), "product name or label required").alias("reason"),
    )


