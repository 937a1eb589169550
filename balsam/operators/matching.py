"""Exact matching of ingredient items to regulations, allergens and the ingredient dictionary.

Decisions are made on equal keys only: no substring, no similarity.  Priorities and duplicate
rules depend on the key alone, so they are settled on the registry side once; each item then
joins a clean index.  No join is hinted: Spark broadcasts the index when its measured size is
below the threshold and otherwise shuffles, where adaptive execution splits a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .windows import keep_first

REGULATION_IDENTITY = ["regulation_type", "category", "cas_no", "source_row"]
ALLERGEN_IDENTITY = ["ingredient_kor_name", "source_row"]


def _entry(key: Column, match_type: str, priority: int, matched: Column) -> Column:
    return F.struct(
        key.alias("key"), F.lit(match_type).alias("match_type"),
        F.lit(priority).alias("priority"), matched.alias("matched_name"),
    )


def _index(registry: DataFrame, entries: Column, identity: Sequence[str], seq: str) -> DataFrame:
    """One row per (key, record identity): the entry of the best priority, then input order."""
    rows = (
        registry.withColumn("__e", F.explode(entries))
        .select("*", "__e.*").drop("__e").filter("key <> ''")
    )
    return keep_first(rows, ["key", *identity], ["priority", seq])


def regulation_index(registry: DataFrame, seq: str = "seq") -> DataFrame:
    entries = F.array(
        _entry(keys.registry_key("ingredient_kor_name"), "ingredient_kor_name", 0,
               F.col("ingredient_kor_name")),
        _entry(keys.registry_key("chemical_name"), "chemical_name", 1,
               F.coalesce("chemical_name", F.lit(""))),
    )
    return _index(registry, entries, REGULATION_IDENTITY, seq)


def allergen_index(registry: DataFrame, seq: str = "seq") -> DataFrame:
    named = F.array(
        _entry(keys.registry_key("ingredient_kor_name"), "ingredient_kor_name", 0,
               F.col("ingredient_kor_name")),
        _entry(keys.registry_key("ingredient_eng_name"), "ingredient_eng_name", 1,
               F.coalesce("ingredient_eng_name", F.lit(""))),
        _entry(keys.registry_key("inci_name"), "inci_name", 2, F.coalesce("inci_name", F.lit(""))),
    )
    aliases = F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda a: _entry(keys.registry_key(a), "alias", 3, F.lit(None).cast("string")),
    )
    return _index(registry, F.concat(named, aliases), ALLERGEN_IDENTITY, seq)


def _items(items: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Items with their registry key; a repeated key counts once per owner, at its first place."""
    keyed = items.withColumn("key", keys.registry_key("name")).filter("key <> ''")
    return keep_first(keyed, [*owner, "key"], "position")


def _match(items: DataFrame, index: DataFrame, owner: Sequence[str], seq: str) -> DataFrame:
    left = _items(items, owner).select(
        *dict.fromkeys([*owner, "position"]), F.col("name").alias("query_ingredient"), "key"
    )
    return left.join(index, "key").drop("key").withColumnRenamed(seq, "registry_seq")


def match_regulations(
    items: DataFrame, registry: DataFrame, owner: Sequence[str] = ("product_id",), seq: str = "seq"
) -> DataFrame:
    """Regulations of each owner's items (owner…, position, name) by Korean or chemical name."""
    return _match(items, regulation_index(registry, seq), list(owner), seq)


def regulation_totals(
    items: DataFrame, registry: DataFrame, basis: Column, owner: Sequence[str] = ("product_id",), seq: str = "seq"
) -> DataFrame:
    """What `match_regulations` lists per owner, added up: match_count, type_counts (value, n), and the different
    matched_names, source_ids, match_types and decision_basis_flags (`basis` of each match).

    Rows of the registry are added up per key first, so an item meets one row however many share its name."""
    parts = {"matched_names": F.col("matched_name"), "source_ids": F.col("source_id"), "match_types": F.col("match_type"),
             "decision_basis_flags": basis}
    index = regulation_index(registry, seq)
    types = index.groupBy("key", "regulation_type").agg(
        F.count("*").alias("n"), *[F.collect_set(c).alias(name) for name, c in parts.items()])

    def union(name: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(name))).alias(name)

    counted = F.struct(F.col("regulation_type").alias("value"), "n")
    per_key = types.groupBy("key").agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("regulation_type").isNotNull(), counted)).alias("type_counts"),
        *map(union, parts))
    return _items(items, list(owner)).select(*owner, "key").join(per_key, "key").groupBy(*owner).agg(
        F.sum("n").alias("match_count"), F.flatten(F.collect_list("type_counts")).alias("type_counts"), *map(union, parts))


def match_allergens(
    items: DataFrame, registry: DataFrame, owner: Sequence[str] = ("product_id",), seq: str = "seq"
) -> DataFrame:
    """Allergens of each owner's items; an alias match reports the item's own spelling."""
    out = _match(items, allergen_index(registry, seq), list(owner), seq)
    return out.withColumn("matched_name", F.coalesce("matched_name", "query_ingredient"))


def _match_cas(items, registry, numbers: Column, owner, seq) -> DataFrame:
    index = (
        registry.withColumn("key", F.explode(numbers)).filter("key <> ''")
        .withColumnRenamed(seq, "registry_seq")
        .withColumns({"match_type": F.lit("cas_no"), "matched_name": F.col("key")})
    )
    left = items.select(
        *owner, "position", F.col("name").alias("query_ingredient"),
        keys.cas_key("name").alias("key"),
    ).filter("key <> ''")
    return left.join(index, "key").drop("key")


def match_regulations_by_cas(
    items: DataFrame, registry: DataFrame, owner: Sequence[str] = ("product_id",), seq: str = "seq"
) -> DataFrame:
    """Regulations whose registry-number text holds the item's number."""
    return _match_cas(items, registry, keys.split_cas("cas_no"), list(owner), seq)


def match_allergens_by_cas(
    items: DataFrame, registry: DataFrame, owner: Sequence[str] = ("product_id",), seq: str = "seq"
) -> DataFrame:
    """Allergens that list the item's registry number."""
    numbers = F.transform("cas_numbers", keys.cas_key)
    return _match_cas(items, registry, numbers, list(owner), seq)


CAS_SHAPED = r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"


def match_by_name_or_cas(
    items: DataFrame, registry: DataFrame, kind: str, owner: Sequence[str] = ("product_id",),
    seq: str = "seq",
) -> DataFrame:
    """Inputs shaped like a registry number use the number index, all others the name index.

    Every input is looked up on its own: a repeated name is reported for each place."""
    by_name, by_cas = {
        "regulation": (match_regulations, match_regulations_by_cas),
        "allergen": (match_allergens, match_allergens_by_cas),
    }[kind]
    shaped = F.coalesce(F.col("name").rlike(CAS_SHAPED), F.lit(False))
    names = by_name(items.filter(~shaped), registry, [*owner, "position"], seq).drop("priority")
    numbers = by_cas(items.filter(shaped), registry, owner, seq)
    return names.unionByName(numbers)


# --- ingredient dictionary ----------------------------------------------------------------

def build_dictionary(ingredients: DataFrame) -> DataFrame:
    """Distinct dictionary keys: the Korean name and every comma-separated synonym."""
    names = F.concat(
        F.array(F.col("ingredient_kor_name")),
        F.split(F.coalesce("synonym", F.lit("")), ","),
    )
    return (
        ingredients.select(F.explode(names).alias("name"))
        .select(keys.dictionary_key("name").alias("key"))
        .filter("key <> ''").distinct()
    )


def known_ingredients(items: DataFrame, dictionary: DataFrame, column: str = "name") -> DataFrame:
    """Add `is_known`: the name, or the name without a trailing colour code, is in the dictionary.

    Names are looked up once per distinct spelling and each spelling joins back by equality."""
    probe = items.select(F.col(column).alias("__name")).distinct().select(
        "__name",
        F.explode(F.array_compact(F.array(
            keys.dictionary_key("__name"), keys.dictionary_key_without_code("__name")
        ))).alias("key"),
    )
    known = (
        probe.join(dictionary.select("key"), "key", "left_semi")
        .select("__name").distinct().withColumn("is_known", F.lit(True))
    )
    return (
        items.join(known, items[column] == known["__name"], "left").drop("__name")
        .withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    )
