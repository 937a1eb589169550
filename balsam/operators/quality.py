"""Data-quality checks.  Each returns a table of violations; an empty table is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import casefold, collapse, is_blank
from .windows import duplicates, global_number


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, blank text, empty list or empty map; an absent column is missing."""
    if name not in df.columns:
        return F.lit(True)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return is_blank(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.col(name).isNull() | (F.size(name) == 0)
    return F.col(name).isNull()


def missing_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    """Sorted names of the missing fields of a row."""
    if not fields:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(is_missing(df, f), F.lit(f)) for f in sorted(fields)])
    )


def check_required(df: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    return df.select(seq, missing_fields(df, fields).alias("missing")).filter(F.size("missing") > 0)


def check_source_id(df: DataFrame, expected: str | DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that do not carry the expected source id (a value, or a one-row metadata table)."""
    want = expected.select("source_id").scalar() if isinstance(expected, DataFrame) else F.lit(expected)
    return df.filter(~F.col("source_id").eqNullSafe(want)).select(seq, "source_id")


# Any of these fields is a basis for a restriction.
BASIS_FIELDS = ("max_concentration", "product_scope", "use_conditions", "warning_text")


def has_basis() -> Column:
    """Any basis field is filled; what the evaluation suites ask of every match."""
    return reduce(lambda a, b: a | b, [~is_blank(c) for c in BASIS_FIELDS])


def has_decision_basis() -> Column:
    """Prohibited needs use conditions; restricted needs any basis field."""
    return F.when(F.col("regulation_type") == "prohibited", ~is_blank("use_conditions")).when(
        F.col("regulation_type") == "restricted", has_basis()
    ).otherwise(False)


def check_regulations(df: DataFrame, seq: str = "seq") -> DataFrame:
    known = F.coalesce(F.col("regulation_type").isin("prohibited", "restricted"), F.lit(False))
    reason = F.when(~known, "type not allowed").when(
        ~has_decision_basis() & (F.col("regulation_type") == "prohibited"), "use conditions missing"
    ).when(~has_decision_basis(), "decision basis missing")
    return df.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        seq, "regulation_type", "reason")


def check_allergens(df: DataFrame, expected: int, seq: str = "seq") -> DataFrame:
    """Row reasons, plus table reasons (null seq) for the row count and the numbering 1..n."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("legal_status").eqNullSafe("labeling_required"), "legal status"),
        F.when(~F.col("allergen_type").eqNullSafe("fragrance_allergen"), "allergen type"),
        F.when(F.col("cas_numbers").isNull(), "registry numbers not a list")
        .when(F.size("cas_numbers") == 0, "registry numbers empty"),
    ))
    rows = df.select(F.col(seq).cast("bigint").alias("seq"), F.explode(reasons).alias("reason"))
    table = global_number(df, seq, "__n").agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.col("source_row").eqNullSafe(F.col("__n"))), F.lit(True)).alias("ok"),
    ).select(
        F.lit(None).cast("bigint").alias("seq"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("n") != expected, "row count"),
            F.when(~F.col("ok") | (F.col("n") != expected), "row numbers not contiguous"),
        ))).alias("reason"),
    )
    return rows.unionByName(table)


def check_counts(parts: Sequence[DataFrame], merged: DataFrame) -> DataFrame:
    """One row per broken relation between the merged count and the sum of its parts."""
    tagged = reduce(
        DataFrame.unionByName,
        [p.select(F.lit("part").alias("k")) for p in parts] + [merged.select(F.lit("merged").alias("k"))],
    )
    return tagged.agg(
        F.count_if(F.col("k") == "part").alias("n_parts"),
        F.count_if(F.col("k") == "merged").alias("n_merged"),
    ).withColumn("reason", F.when(F.col("n_merged") > F.col("n_parts"), "more rows than the parts")
                 .when(F.col("n_merged") == 0, "empty")).filter("reason IS NOT NULL")


def check_rule_dataset(
    rules: DataFrame, profiles: DataFrame, allowed_aliases: Sequence[str] = (),
    must_have: Mapping[str, Sequence[str]] | None = None,
    must_not_have: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(check, value): repeated rule ids, profile references to unknown groups, aliases shared by
    rules that are not allow-listed, and named inclusions or exclusions that do not hold."""
    repeated = duplicates(rules, "rule_id").select(
        F.lit("duplicate rule").alias("check"), F.col("rule_id").alias("value"))
    refs = profiles.select(F.explode(F.concat(
        F.coalesce("helpful_function_groups", F.array().cast("array<string>")),
        F.coalesce("caution_function_groups", F.array().cast("array<string>")),
    )).alias("value")).distinct()
    unknown = refs.join(
        rules.select(F.col("canonical_group").alias("value")).distinct(), "value", "left_anti"
    ).select(F.lit("unknown group").alias("check"), "value")
    asserted = rules.sparkSession.createDataFrame(
        [(rule_id, word, wanted) for wanted, table in ((True, must_have or {}), (False, must_not_have or {}))
         for rule_id, words in table.items() for word in words], "rule_id string, value string, wanted boolean")
    pairs = rules.select(
        F.col("rule_id").cast("string").alias("rule_id"), F.explode("aliases").alias("alias")
    ).select("rule_id", collapse(casefold("alias")).alias("value"), F.lit(None).cast("boolean").alias("wanted"))
    # Aliases and assertions meet in one grouping; lists hold failed assertions only.
    held = pairs.unionByName(asserted).groupBy("rule_id", "value").agg(
        F.bool_or(F.col("wanted").isNull()).alias("held"), F.coalesce(F.bool_or("wanted"), F.lit(False)).alias("needed"),
        F.coalesce(F.bool_or(~F.col("wanted")), F.lit(False)).alias("barred"))
    name = F.concat("rule_id", F.lit(": "), "value")
    row = lambda check, value: F.struct(F.lit(check).alias("check"), value.alias("value"))
    failed = F.when(~F.col("held") & F.col("needed"), row("alias missing", name)).when(
        F.col("held") & F.col("barred"), row("alias forbidden", name))
    by_value = held.groupBy("value").agg(F.count_if("held").alias("n"), F.collect_list(failed).alias("failed"))
    allowed = F.col("value").isin(*allowed_aliases) if allowed_aliases else F.lit(False)
    shared = F.when((F.col("n") > 1) & ~allowed, row("shared alias", F.col("value")))
    listed = by_value.select(F.explode(F.concat("failed", F.array_compact(F.array(shared)))).alias("r")).select("r.*")
    return repeated.select("check", F.col("value").cast("string").alias("value")).unionByName(unknown).unionByName(listed)


# Fields that trace a match to its source.
REGULATION_PROVENANCE = (
    "source_id", "source_authority", "source_document", "notice_number", "notice_label",
    "source_section", "source_row",
)
ALLERGEN_PROVENANCE = (
    "source_id", "source_authority", "source_document", "source_section", "source_row",
    "cas_numbers",
)


def check_source_complete(matches: DataFrame, fields: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """Matches whose provenance fields are missing or blank."""
    return matches.select(
        *owner, "query_ingredient", missing_fields(matches, fields).alias("missing")
    ).filter(F.size("missing") > 0)
