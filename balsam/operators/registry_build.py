"""Registry builds: source rows to validated, merged registry tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import SPACE, collapse
from .windows import keep_first

# Category of each restricted-ingredient table, by table number.
TABLE_CATEGORIES = {1: "preservative", 2: "uv_filter", 3: "hair_dye", 4: "restricted_other"}
# Sort rank of a regulation type; others come last.
TYPE_ORDER = {"prohibited": 0, "restricted": 1}
OTHER_TYPE_RANK = 99
# Heading of the numbered allergen table.
NUMBERED_TABLE_HEADER = "연번 성분명 CAS 등록번호"


def carry_forward(
    df: DataFrame, group: str, order: str, column: str, block_rows: int = 100_000
) -> DataFrame:
    """Last non-null value of a column at or above each row of its group.

    A table is filled in blocks of the row number; a value crosses blocks through one summary row
    per block, so a table that holds most of the rows is still many tasks."""
    rows = df.withColumn("__block", F.floor(F.col(order) / block_rows))
    inside = (
        Window.partitionBy(group, "__block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    above = (
        Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    last = rows.filter(F.col(column).isNotNull()).groupBy(group, "__block").agg(
        F.max_by(column, order).alias("__last"))
    blocks = rows.select(group, "__block").distinct()
    carried = (
        blocks.join(last, [group, "__block"], "left")
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(above))
        .drop("__last")
    )
    return (
        rows.withColumn(column, F.last(column, ignorenulls=True).over(inside))
        .join(carried, [group, "__block"])
        .withColumn(column, F.coalesce(column, "__carry"))
        .drop("__block", "__carry")
    )


def fill_merged_cells(rows: DataFrame, full_width: int) -> DataFrame:
    """Registry rows of tables (source_table, source_row, cells) with merged name cells.

    full_width 3: name, number, chemical name; a one-cell row is a name of its own.
    full_width 5: name, limit, notes, number, chemical name; other widths are dropped (see
    `unexpected_rows`).  A two-cell row inherits the current name, limit and notes."""
    cells = F.transform("cells", lambda c: F.coalesce(collapse(c), F.lit("")))
    n = F.size("cells")

    def cell(i: int) -> Column:
        return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))

    full = n >= full_width
    lone = (n == 1) if full_width == 3 else F.lit(False)
    sets = (full | lone) & (cell(0) != "")
    wide = full_width == 5
    own = F.struct(
        cell(0).alias("name"),
        (cell(1) if wide else F.lit("")).alias("usage_limit"),
        (cell(2) if wide else F.lit("")).alias("notes"),
    )
    base = rows.filter("source_row > 1").withColumn("cells", cells)
    current = carry_forward(
        base.withColumn("__current", F.when(sets, own)), "source_table", "source_row", "__current"
    )
    pair = n == 2
    name = F.when(full | lone, cell(0)).when(pair, F.col("__current.name"))

    def inherited(field: str, own_cell: Column) -> Column:
        return F.when(full, own_cell).when(pair, F.col(f"__current.{field}")).otherwise("")

    number = F.when(full, cell(full_width - 2)).when(pair, cell(0)).otherwise("")
    chemical = F.when(full, cell(full_width - 1)).when(pair, cell(1)).otherwise("")
    return current.filter(F.coalesce(name, F.lit("")) != "").select(
        "source_table", "source_row",
        name.alias("ingredient_kor_name"),
        F.coalesce(inherited("usage_limit", cell(1) if wide else F.lit("")), F.lit(""))
        .alias("usage_limit"),
        F.coalesce(inherited("notes", cell(2) if wide else F.lit("")), F.lit("")).alias("notes"),
        F.when(number == "-", "").otherwise(number).alias("cas_no"),
        F.nullif(chemical, F.lit("")).alias("chemical_name"),
    )


def unexpected_rows(rows: DataFrame, full_width: int) -> DataFrame:
    """Rows whose width no rule covers."""
    n = F.size("cells")
    known = (n >= full_width) | (n == 2) | ((n == 1) if full_width == 3 else F.lit(False))
    return rows.filter((F.col("source_row") > 1) & ~known)


def table_category(table: Column | str) -> Column:
    """Category of a restricted-ingredient table number."""
    out = F.lit(None).cast("string")
    for number, name in TABLE_CATEGORIES.items():
        out = F.when(F.col(table) == number, name).otherwise(out)
    return out


def extract_numbered_rows(pages: DataFrame, header: str = NUMBERED_TABLE_HEADER) -> DataFrame:
    """Rows 'n name CAS No x' after the table heading of each page (page_id, text)."""
    start = F.instr("text", header)
    table = F.when(start > 0, F.trim(F.substring(F.col("text"), start + F.lit(len(header)),
                                                 F.length("text"))))
    row = (
        rf"(?i)(\d{{1,2}}){SPACE}+([^\n]+?){SPACE}+CAS{SPACE}+No{SPACE}+(\d{{2,7}}-\d{{2}}-\d)"
        rf"(?={SPACE}+\d{{1,2}}{SPACE}+|{SPACE}*$)"
    )

    def part(i: int) -> Column:
        return F.regexp_extract_all("__table", F.lit(row), F.lit(i))

    return (
        pages.withColumn("__table", table).filter("__table IS NOT NULL")
        .select("page_id", F.explode(F.arrays_zip(
            part(1).alias("source_row"), part(2).alias("name"), part(3).alias("cas"))).alias("r"))
        .select(
            "page_id", F.col("r.source_row").cast("int").alias("source_row"),
            keys.clean_text("r.name").alias("ingredient_kor_name"),
            F.array(keys.clean_text("r.cas")).alias("cas_numbers"),
        )
    )


def pages_without_rows(pages: DataFrame, rows: DataFrame, header: str = NUMBERED_TABLE_HEADER) -> DataFrame:
    """Pages that must be rejected: no table heading, or no row below it."""
    return pages.join(rows.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id",
        F.when(F.instr("text", header) == 0, "heading not found").otherwise("no rows").alias("reason"),
    )


def attach_source_metadata(rows: DataFrame, meta: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Stamp every row with fields of the one-row metadata table.

    A scalar subquery: Spark itself fails the job if the table has more than one row."""
    stamp = meta.select(F.struct(*fields)).scalar()
    return rows.withColumn("__meta", stamp).select("*", *[f"__meta.{f}" for f in fields]).drop("__meta")


def missing_metadata(meta: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Required metadata fields that are absent, null or blank."""
    from .quality import missing_fields

    present = [f for f in fields if f in meta.columns]
    absent = F.array(*[F.lit(f) for f in fields if f not in meta.columns]).cast("array<string>")
    return meta.select(
        F.explode(F.sort_array(F.concat(absent, missing_fields(meta, present)))).alias("field")
    )


def merge_registries(*parts: DataFrame, seq: str = "seq") -> DataFrame:
    """Concatenate registries; `part` and the sequence column give the total order."""
    out = None
    for i, df in enumerate(parts):
        df = df.withColumn("part", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _identity(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


REGISTRY_IDENTITY = ("ingredient_kor_name", "cas_no", "regulation_type", "category")


def deduplicate_registry(merged: DataFrame, order: Sequence[str] = ("part", "seq")) -> DataFrame:
    """First record of every (name, number, type, category)."""
    named = {f"__{c}": _identity(c) for c in REGISTRY_IDENTITY}
    return keep_first(merged.withColumns(named), list(named), list(order)).drop(*named)


def duplicate_count(merged: DataFrame) -> DataFrame:
    """How many records the de-duplication removes, in one pass of partial counts."""
    return (
        merged.groupBy(*[_identity(c).alias(c) for c in REGISTRY_IDENTITY])
        .agg(F.count("*").alias("n"))
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_kept"),
             F.sum(F.col("n") - 1).alias("n_removed"))
    )


def type_rank(c: str = "regulation_type") -> Column:
    out = F.lit(OTHER_TYPE_RANK)
    for name, rank in TYPE_ORDER.items():
        out = F.when(F.col(c) == name, rank).otherwise(out)
    return out


def sort_registry(regs: DataFrame) -> DataFrame:
    """Type, category, name, number; input order breaks ties."""
    ties = [c for c in ("part", "seq") if c in regs.columns]
    return regs.orderBy(
        type_rank(), *[F.coalesce(c, F.lit("")) for c in
                       ("category", "ingredient_kor_name", "cas_no")], *ties
    )


def registry_summary(regs: DataFrame) -> DataFrame:
    """Record counts by regulation type and by category, in one scan."""
    unknown = F.lit("unknown")
    return (
        regs.select(F.explode(F.array(
            F.struct(F.lit("regulation_type").alias("facet"),
                     F.coalesce("regulation_type", unknown).alias("value")),
            F.struct(F.lit("category").alias("facet"), F.coalesce("category", unknown).alias("value")),
        )).alias("e"))
        .groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))
    )
