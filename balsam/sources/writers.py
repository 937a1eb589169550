"""Writers, and the table changes that a store makes in place: here each returns the new table.

A changed table is written to a new place and swapped in; a job never overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, texts
from ..functions.text import is_blank, strip
from ..operators.options import collection_status
from ..operators.store import FINISHED, RECORD_KEY, moment
from ..operators.windows import global_number, keep_first


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; nulls are written, text stays UTF-8."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def text_corpus(docs: DataFrame, order: str = "row", bucket_rows: int = 1_000_000) -> DataFrame:
    """Numbered text blocks (n, value) of rendered records, in the order of a unique integer."""
    numbered = global_number(docs, order, "n", bucket_rows)
    return numbered.select("n", F.concat(
        F.lit(f"[{texts.CORPUS_BLOCK} "), F.col("n").cast("string"), F.lit("]\n"), F.col("content"), F.lit("\n"),
    ).alias("value"))


def write_text_corpus(docs: DataFrame, path: str, order: str = "row") -> None:
    """Numbered blocks as text files that are in order by file name."""
    blocks = text_corpus(docs, order)
    blocks.repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)


def publish_documents(docs: DataFrame, path: str) -> None:
    """Replace the published collection with these documents."""
    docs.write.mode("overwrite").parquet(path)


# --- products and records ------------------------------------------------------------------------

PRODUCT_FIELDS = ("brand_name", "product_name", "category", "category_path", "product_url", "image_url")


def upsert_products(current: DataFrame, incoming: DataFrame, as_of, order: str = "seq") -> DataFrame:
    """Products after an upsert on (source, trimmed external id).

    A known product takes every incoming attribute, also a null one; of several incoming rows of
    one product the last counts.  `changed` marks inserted and overwritten rows."""
    fresh = keep_first(
        incoming.withColumns({"source": strip("source"), "external_id": strip("external_id")}),
        ["source", "external_id"], F.desc(order),
    ).select("source", "external_id", *[F.col(c).alias(f"__{c}") for c in PRODUCT_FIELDS], F.lit(True).alias("__in"))
    both = current.join(fresh, ["source", "external_id"], "full_outer")
    hit = F.coalesce("__in", F.lit(False))
    picked = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in PRODUCT_FIELDS}
    out = both.withColumns(picked)
    return out.select(
        "source", "external_id", *PRODUCT_FIELDS,
        F.when(hit, keys.product_name_key("product_name")).otherwise(F.col("name_key")).alias("name_key"),
        F.when(hit, moment(as_of)).otherwise(F.col("updated_at")).alias("updated_at"), hit.alias("changed"))


def check_records(incoming: DataFrame) -> DataFrame:
    """Incoming records (product_id, option_id, raw_ingredients, ingredients, success, …) with the
    first reason to refuse each."""
    reason = (
        F.when(~F.coalesce("success", F.lit(False)), "extraction failed")
        .when(is_blank("raw_ingredients"), "raw text blank")
        .when(F.coalesce(F.size("ingredients"), F.lit(0)) <= 0, "no ingredients")
        .when(~F.col("product_id").eqNullSafe(F.col("result_product_id")), "product differs"))
    return incoming.withColumn("option_id", strip(F.coalesce("option_id", F.lit("")))).withColumn("reason", reason)


def _stored(accepted: DataFrame, as_of, expires_at) -> DataFrame:
    raw = strip("raw_ingredients")
    return accepted.select(
        *RECORD_KEY, "option_name", raw.alias("raw_ingredients"), F.sha2(raw, 256).alias("ingredient_hash"),
        "extraction_method", moment(as_of).alias("extracted_at"), moment(as_of).alias("last_checked_at"),
        moment(expires_at).alias("expires_at"))


def last_records(accepted: DataFrame, order: str | None) -> DataFrame:
    """Of accepted records with the same (product, option) the one that is last by `order`."""
    return accepted if order is None else keep_first(accepted, RECORD_KEY, F.desc(order))


def replace_records(records: DataFrame, accepted: DataFrame, as_of, expires_at, order: str | None = None) -> DataFrame:
    """Records after accepted ones replace those with their (product, option).

    `order` names the column that tells repeated records of one batch apart: the last one stays.
    Without it the batch must hold each (product, option) once."""
    accepted = last_records(accepted, order)
    kept = records.join(accepted.select(*RECORD_KEY), RECORD_KEY, "left_anti")
    return kept.unionByName(_stored(accepted, as_of, expires_at), allowMissingColumns=True)


def exploded_items(accepted: DataFrame) -> DataFrame:
    """Items at their 1-based place; blanks are skipped after counting, so places keep gaps."""
    rows = accepted.select(*RECORD_KEY, F.posexplode("ingredients").alias("p", "name")).withColumn(
        "ingredient_name", strip("name")).filter("ingredient_name <> ''")
    return rows.select(
        *RECORD_KEY, (F.col("p") + 1).cast("bigint").alias("position"), "ingredient_name",
        keys.item_key("ingredient_name").alias("normalized_name"))


def replace_items(items: DataFrame, accepted: DataFrame, order: str | None = None) -> DataFrame:
    """Items after accepted records replace all items of their records; `order` as in `replace_records`."""
    accepted = last_records(accepted, order)
    return items.join(accepted.select(*RECORD_KEY), RECORD_KEY, "left_anti").unionByName(exploded_items(accepted))


# --- whole collections --------------------------------------------------------------------------------

def check_collections(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """Collections (product_id, status, …) with the first reason to refuse each.

    A collection needs a finished status, entries without repeated options or broken results, and
    the empty option id exactly when the product has no options."""
    checked = check_records(entries)
    per_option = checked.groupBy("product_id", "option_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("reason").isNotNull()).alias("broken"))
    facts = per_option.groupBy("product_id").agg(
        F.sum("n").alias("n_entries"), F.max("n").alias("most"), F.count_if(F.col("option_id") == "").alias("n_blank"),
        F.bool_or("broken").alias("broken"))
    rows = heads.join(facts, "product_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)), "status not finished")
        .when(F.col("n_entries").isNull(), "no entries").when(F.col("most") > 1, "option repeated")
        .when((F.col("status") == "not_applicable") & ~((F.col("n_entries") == 1) & (F.col("n_blank") == 1)),
              "needs one entry without option")
        .when((F.col("status") == "ready") & (F.col("n_blank") > 0), "option id blank")
        .when(F.col("broken"), "entry incomplete"))
    return rows.withColumn("reason", reason).drop("most", "n_blank", "broken")


def replace_collection(
    records: DataFrame, items: DataFrame, states: DataFrame, queue: DataFrame, heads: DataFrame,
    entries: DataFrame, as_of, expires_at,
) -> dict[str, DataFrame]:
    """Records, items, states and queue after complete collections replace what was stored.

    Options that a collection does not name are deleted with their items; refused collections
    (see `check_collections`) change nothing."""
    good = check_collections(heads, entries).filter("reason IS NULL").drop("reason", "n_entries")
    touched = good.select("product_id")
    new = check_records(entries).join(touched, "product_id", "left_semi").drop("reason")
    counts = new.groupBy("product_id").agg(F.count_if(F.col("option_id") != "").cast("int").alias("option_count"))

    def without(df: DataFrame) -> DataFrame:
        return df.join(touched, "product_id", "left_anti")

    fresh_states = good.join(counts, "product_id").select(
        "product_id", "status", "option_count", "parser_version", "options_json",
        moment(as_of).alias("collected_at"), moment(expires_at).alias("expires_at"))
    known = queue.join(touched, "product_id", "left_semi").withColumns({
        "status": F.lit("complete"), "next_retry_at": F.lit(None).cast("timestamp_ntz"), "updated_at": moment(as_of)})
    added = touched.join(queue.select("product_id"), "product_id", "left_anti").select(
        "product_id", F.lit("complete").alias("status"), F.lit(0).alias("attempt_count"),
        moment(as_of).alias("updated_at"))
    return {
        "records": without(records).unionByName(_stored(new, as_of, expires_at), allowMissingColumns=True),
        "items": without(items).unionByName(exploded_items(new)),
        "states": without(states).unionByName(fresh_states, allowMissingColumns=True),
        "queue": without(queue).unionByName(known).unionByName(added, allowMissingColumns=True),
    }


def finalize_collection(
    records: DataFrame, states: DataFrame, heads: DataFrame, ids: DataFrame, as_of, expires_at
) -> dict[str, DataFrame]:
    """Records without the options that are not listed, and states with the new status and count.

    heads: product_id, status, parser_version, options_json; ids: product_id, option_id."""
    listed = ids.select("product_id", strip("option_id").alias("option_id")).distinct()
    touched = heads.select("product_id")
    counts = listed.groupBy("product_id").agg(F.count_if(F.col("option_id") != "").cast("int").alias("option_count"))
    fresh = heads.join(counts, "product_id", "left").select(
        "product_id", "status", F.coalesce("option_count", F.lit(0)).alias("option_count"), "parser_version",
        "options_json", moment(as_of).alias("collected_at"), moment(expires_at).alias("expires_at"))
    mine = records.join(touched, "product_id", "left_semi")
    return {
        "records": records.join(touched, "product_id", "left_anti").unionByName(
            mine.join(listed, RECORD_KEY, "left_semi")),
        "states": states.join(touched, "product_id", "left_anti").unionByName(fresh, allowMissingColumns=True),
    }


def snapshot_option_status(
    records: DataFrame, items: DataFrame, states: DataFrame, results: DataFrame, parser_version: str,
    as_of, expires_at,
) -> dict[str, DataFrame]:
    """Records, items and states after a snapshot of every option's status.

    results: product_id, option_id, option_name, status, ingredients.  Ready options store their
    list, others lose theirs; options outside the snapshot lose their status but stay; a product
    without state gets one that is never ready."""
    snap = results.select(
        *RECORD_KEY, F.col("option_name").alias("__name"), F.col("status").alias("__status"),
        F.col("ingredients").alias("__list"), F.lit(True).alias("__in"))
    products = results.select("product_id").distinct().withColumn("__touched", F.lit(True))
    both = records.join(snap, RECORD_KEY, "full_outer").join(products, "product_id", "left")
    hit, ready = F.coalesce("__in", F.lit(False)), F.coalesce(F.col("__status") == "ready", F.lit(False))
    stale = F.coalesce("__touched", F.lit(False)) & ~hit & (F.col("option_id") != "")
    raw = F.when(hit, F.when(ready, F.array_join("__list", ", ")).otherwise("")).otherwise(F.col("raw_ingredients"))

    def status(new: Column, old: str) -> Column:
        return F.when(hit, new).when(~stale, F.col(old))

    new_records = both.select(
        *RECORD_KEY, F.when(hit, F.col("__name")).otherwise(F.col("option_name")).alias("option_name"),
        raw.alias("raw_ingredients"),
        F.when(hit, moment(expires_at)).otherwise(F.col("expires_at")).alias("expires_at"),
        status(F.col("__status"), "cache_status").alias("cache_status"),
        status(F.lit(parser_version), "cache_version").alias("cache_version"))
    accepted = results.filter("status = 'ready'")
    new_items = items.join(results.select(*RECORD_KEY), RECORD_KEY, "left_anti").unionByName(exploded_items(accepted))
    level = collection_status(results, results).select(
        "product_id", F.col("collection_status").alias("__collection"), F.col("n_options").cast("int").alias("__n"),
        F.col("n_ready").cast("int").alias("__ready"))
    joined = states.join(level, "product_id", "full_outer")
    seen = F.col("__n").isNotNull()
    new_states = joined.select(
        "product_id", F.coalesce("status", F.lit("mapping_failed")).alias("status"),
        F.coalesce("option_count", F.lit(0)).alias("option_count"),
        F.coalesce("parser_version", F.lit(parser_version)).alias("parser_version"),
        F.coalesce("options_json", F.lit("[]")).alias("options_json"),
        F.coalesce("expires_at", moment(expires_at)).alias("expires_at"),
        F.when(seen, F.col("__collection")).otherwise(F.col("cache_collection_status")).alias("cache_collection_status"),
        F.when(seen, F.col("__n")).otherwise(F.col("cache_option_count")).alias("cache_option_count"),
        F.when(seen, parser_version).otherwise(F.col("cache_version")).alias("cache_version"),
        F.col("__ready").alias("cache_ready_count"))
    return {"records": new_records, "items": new_items, "states": new_states}


def save_search_results(
    searches: DataFrame, results: DataFrame, queue: DataFrame, states: DataFrame, incoming: DataFrame,
    searched_at, expires_at,
) -> dict[str, DataFrame]:
    """Searches, results and queue after storing incoming rows (query_key, place, product_id).

    A query's results are replaced; a repeated product keeps its first place, and places stay as
    they were, so ranks may have gaps.  Unseen products join the queue: complete while their
    collection is unexpired, else pending."""
    rows = incoming.withColumn("query_key", strip("query_key")).filter("query_key <> ''")
    asked = rows.select("query_key").distinct()
    first = rows.filter("product_id IS NOT NULL").groupBy("query_key", "product_id").agg(F.min("place").alias("rank"))
    alive = states.filter(F.col("expires_at") > moment(searched_at)).select("product_id", F.lit(True).alias("__alive"))
    unseen = first.select("product_id").distinct().join(queue.select("product_id"), "product_id", "left_anti").join(
        alive, "product_id", "left").select(
        "product_id", F.when(F.col("__alive"), "complete").otherwise("pending").alias("status"),
        F.lit(0).alias("attempt_count"), moment(searched_at).alias("updated_at"))
    return {
        "searches": searches.join(asked, "query_key", "left_anti").unionByName(asked.select(
            "query_key", moment(searched_at).alias("searched_at"), moment(expires_at).alias("expires_at"))),
        "results": results.join(asked, "query_key", "left_anti").unionByName(first),
        "queue": queue.unionByName(unseen, allowMissingColumns=True),
    }


def backfill_derived(df: DataFrame, column: str, expression: Column) -> DataFrame:
    """Rows whose derived column differs from its recomputed value, with the new value."""
    return df.withColumn("__new", expression).filter(~F.col(column).eqNullSafe(F.col("__new"))).withColumn(
        column, F.col("__new")).drop("__new")
