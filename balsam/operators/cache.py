"""Cache decisions, option lookups, collection queue and prefetch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.settle import settle
from ..functions.text import strip
from .store import RECORD_KEY, moment, restore_options, valid_records

# Queue timing.
LEASE_SECONDS = 90
MAX_EXPONENT = 20


def _seconds(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def to_utc(c: Column | str) -> Column:
    """A zoned or zone-less ISO text as UTC without zone; text without a zone is UTC already."""
    text = F.col(c) if isinstance(c, str) else c
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(
        zoned, F.to_utc_timestamp(text.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    ).otherwise(text.cast("timestamp_ntz"))


def cache_decision(
    requests: DataFrame, records: DataFrame, as_of, cache_only: bool = False
) -> DataFrame:
    """hit, extract or unavailable per request (request_id, product_id, option_id)."""
    found = requests.withColumn("option_id", strip(F.coalesce("option_id", F.lit("")))).join(
        records.select(*RECORD_KEY, "expires_at"), RECORD_KEY, "left")
    expired = F.coalesce(F.col("expires_at") <= moment(as_of), F.lit(False))
    hit = F.col("expires_at").isNotNull() & ~expired
    return found.select(
        "request_id", *RECORD_KEY, expired.alias("cache_expired"), hit.alias("cache_hit"),
        F.when(hit, "hit").otherwise("unavailable" if cache_only else "extract").alias("action"),
    )


def accept_extractions(results: DataFrame, as_of, ttl_days: int) -> DataFrame:
    """Extraction results with `accepted`, `reason` and the expiry a stored row gets.

    Rejected results change nothing: an expired row stays as it is."""
    reason = (
        F.when(~F.coalesce("success", F.lit(False)), "extraction failed")
        .when(F.coalesce(F.size("ingredients"), F.lit(0)) <= 0, "no ingredients")
    )
    return results.withColumn("reason", reason).withColumns({
        "accepted": F.col("reason").isNull(),
        "expires_at": F.when(F.col("reason").isNull(), moment(as_of) + _days(ttl_days)),
    })


# --- preparations -----------------------------------------------------------------------------

def _alive(states: DataFrame, as_of) -> DataFrame:
    return states.filter(F.col("expires_at") > moment(as_of))


def cached_preparation(states: DataFrame, records: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """(product_id, status, option_count, parser_version) of whole, unexpired collections.

    A product without options needs a valid record without option, however many there are."""
    counts = valid_records(records, items, as_of).groupBy("product_id").agg(
        F.count_if(F.col("option_id") == "").alias("n_common"),
        F.count_if(F.col("option_id") != "").alias("n_options"))
    return _alive(states, as_of).join(counts, "product_id").filter(
        ((F.col("status") == "not_applicable") & (F.col("option_count") == 0) & (F.col("n_common") > 0))
        | ((F.col("status") == "ready") & (F.col("n_options") == F.col("option_count")))
    ).select("product_id", "status", "option_count", "parser_version")


def option_cache_preparation(
    states: DataFrame, records: DataFrame, items: DataFrame, as_of
) -> DataFrame:
    """Option-level preparation where every status column is filled, the count agrees and every
    ready option has items; otherwise the plain preparation of the product."""
    unexpired = records.filter((F.col("expires_at") > moment(as_of)) & (F.col("option_id") != ""))
    stocked = items.select(*RECORD_KEY).distinct().withColumn("has_items", F.lit(True))
    whole = unexpired.join(stocked, RECORD_KEY, "left").groupBy("product_id").agg(
        F.count("*").alias("n"),
        F.bool_and(
            F.col("cache_status").isNotNull() & F.col("cache_version").isNotNull()
            & ((F.col("cache_status") != "ready") | F.coalesce("has_items", F.lit(False)))
        ).alias("all_filled"))
    level = _alive(states, as_of).filter(
        "cache_collection_status IS NOT NULL AND cache_version IS NOT NULL "
        "AND cache_option_count IS NOT NULL"
    ).join(whole, "product_id", "left").filter(
        (F.coalesce("n", F.lit(0)) == F.col("cache_option_count")) & F.coalesce("all_filled", F.lit(True))
    ).select(
        "product_id", F.col("cache_collection_status").alias("status"),
        F.col("cache_option_count").alias("option_count"), F.col("cache_version").alias("parser_version"),
        F.lit("option").alias("level"))
    plain = cached_preparation(states, records, items, as_of).withColumn("level", F.lit("product"))
    return level.unionByName(plain.join(level.select("product_id"), "product_id", "left_anti"))


def usable_preparation(
    preparations: DataFrame, records: DataFrame, states: DataFrame, as_of, parser_version: str
) -> DataFrame:
    """Preparations a request may use: right parser version, not failed, and mapping keys that
    are neither empty nor repeated within the product."""
    options = restore_options(records.filter(F.col("expires_at") > moment(as_of)), states)
    named = options.select("product_id", keys.option_mapping_key(
        F.coalesce(F.nullif("raw_option_name", F.lit("")), "option_name")).alias("key"))
    per_key = named.groupBy("product_id", "key").agg(F.count("*").alias("n"))
    broken = per_key.filter("key = '' OR n > 1").select("product_id").distinct()
    needs_version = F.col("status").isin("ready", "partial")
    fitting = preparations.filter(
        (F.col("status") == "not_applicable")
        | (needs_version & (F.col("parser_version").isNull() | (F.col("parser_version") == parser_version)))
    )
    return fitting.filter("status = 'not_applicable'").unionByName(
        fitting.filter("status <> 'not_applicable'").join(broken, "product_id", "left_anti"))


def resolve_option_lookups(
    requests: DataFrame, preparations: DataFrame, options: DataFrame, records: DataFrame,
    items: DataFrame, as_of,
) -> DataFrame:
    """Outcome per request (request_id, product_id, option_key): the first reason that applies,
    else 'hit'.  A missing option is never replaced by the product's whole list.

    `options` are restored options with a status; only ready ones can be analysed."""
    asked = requests.withColumn("option_id", strip(F.coalesce("option_key", F.lit(""))))
    ready = options.filter("status = 'ready'").select(
        *RECORD_KEY, F.lit(True).alias("is_ready"))
    prepared = preparations.select("product_id", F.lit(True).alias("is_prepared"))
    stocked = items.select(*RECORD_KEY).distinct().withColumn("has_items", F.lit(True))
    found = (
        asked.join(prepared, "product_id", "left").join(ready, RECORD_KEY, "left")
        .join(records.select(*RECORD_KEY, "expires_at"), RECORD_KEY, "left")
        .join(stocked, RECORD_KEY, "left")
    )
    outcome = (
        F.when(F.col("option_id") == "", "blank option key")
        .when(F.col("is_prepared").isNull() | F.col("is_ready").isNull(), "option not ready")
        .when(F.col("expires_at").isNull(), "no record")
        .when(F.col("expires_at") <= moment(as_of), "expired")
        .when(F.col("has_items").isNull(), "empty list")
        .otherwise("hit")
    )
    return found.select("request_id", *RECORD_KEY, outcome.alias("outcome"))


# --- queue ----------------------------------------------------------------------------------------

def _retry_due(as_of) -> Column:
    return (F.col("status") == "failed") & (
        F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= moment(as_of)))


def _stale(as_of, lease_seconds: int) -> Column:
    """A lease is stale only when it is strictly older than the timeout."""
    return (F.col("status") == "collecting") & (
        F.col("last_attempt_at") < moment(as_of) - _seconds(lease_seconds))


def claim_attempts(
    queue: DataFrame, wanted: DataFrame, as_of, lease_seconds: int = LEASE_SECONDS,
    force: bool = False,
) -> DataFrame:
    """Queue after claiming the wanted products, with `claimed`; unknown products join the queue."""
    asked = wanted.select("product_id").distinct().withColumn("__wanted", F.lit(True))
    rows = queue.join(asked, "product_id", "full_outer").withColumns({
        "status": F.coalesce("status", F.lit("pending")),
        "attempt_count": F.coalesce("attempt_count", F.lit(0)),
    })
    claimable = ~F.col("status").isin("collecting", "failed") | _retry_due(as_of) | F.coalesce(
        _stale(as_of, lease_seconds), F.lit(False))
    claimed = F.coalesce("__wanted", F.lit(False)) & (F.lit(True) if force else claimable)
    now = moment(as_of)
    return rows.withColumn("claimed", claimed).select(
        "product_id",
        F.when(F.col("claimed"), "collecting").otherwise(F.col("status")).alias("status"),
        (F.col("attempt_count") + F.col("claimed").cast("int")).alias("attempt_count"),
        F.when(F.col("claimed"), now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
        F.when(~F.col("claimed"), F.col("next_retry_at")).alias("next_retry_at"),
        F.when(F.col("claimed"), now).otherwise(F.col("updated_at")).alias("updated_at"),
        "claimed",
    )


def finish_attempts(
    queue: DataFrame, outcomes: DataFrame, as_of, base_seconds: int, cap_seconds: int
) -> DataFrame:
    """Queue after outcomes (product_id, success): complete, or failed with a doubling delay."""
    now = moment(as_of)
    rows = queue.join(outcomes.select("product_id", "success"), "product_id", "full_outer").withColumns({
        "attempt_count": F.coalesce("attempt_count", F.when(F.col("success"), 0).otherwise(1)),
        "last_attempt_at": F.when(
            F.col("status").isNull() & ~F.col("success"), now).otherwise(F.col("last_attempt_at")),
    })
    exponent = F.least(F.greatest(F.col("attempt_count") - 1, F.lit(0)), F.lit(MAX_EXPONENT))
    delay = F.least(F.lit(cap_seconds).cast("bigint"),
                    (F.lit(base_seconds) * F.pow(F.lit(2), exponent)).cast("bigint"))
    touched = F.col("success").isNotNull()
    return rows.select(
        "product_id",
        F.when(~touched, F.col("status")).when(F.col("success"), "complete").otherwise("failed")
        .alias("status"),
        "attempt_count", "last_attempt_at",
        F.when(~touched, F.col("next_retry_at")).when(~F.col("success"), now + _seconds(delay))
        .alias("next_retry_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def due_queue(
    queue: DataFrame, as_of, limit: int | None = None, lease_seconds: int = LEASE_SECONDS
) -> DataFrame:
    """Pending rows, failed rows whose retry is due and stale leases, oldest update first."""
    due = queue.filter(
        (F.col("status") == "pending") | _retry_due(as_of) | _stale(as_of, lease_seconds)
    ).orderBy("updated_at", "product_id")
    return due if limit is None else due.limit(limit)


# --- prefetch -----------------------------------------------------------------------------------------

def plan_prefetch(
    manifest: DataFrame, preparations: DataFrame, outcomes: DataFrame | None = None,
    force: bool = False, dry_run: bool = False, continue_on_error: bool = False,
) -> DataFrame:
    """Status per manifest entry (entry_no, product_id): cache_hit, skipped, to_collect, or with
    outcomes (product_id, success) collected and failed.

    Without continue_on_error nothing runs after the first failure: such entries are dropped.
    The first failure is one minimum over the manifest, not an ordered pass over it."""
    known = preparations.select("product_id", F.lit(True).alias("__cached"))
    rows = manifest.join(known, "product_id", "left")
    cached = F.coalesce("__cached", F.lit(False))
    if dry_run:
        return rows.withColumn("status", F.when(cached, "cache_hit").otherwise("skipped")).drop("__cached")
    served = cached & F.lit(not force)
    if outcomes is None:
        return rows.withColumn("status", F.when(served, "cache_hit").otherwise("to_collect")).drop("__cached")
    done = rows.join(outcomes.select("product_id", "success"), "product_id", "left").withColumn(
        "status", F.when(served, "cache_hit").when(F.coalesce("success", F.lit(False)), "collected")
        .otherwise("failed")).drop("__cached", "success")
    if continue_on_error:
        return done
    done = settle(done)
    stop = done.filter("status = 'failed'").agg(F.min("entry_no").alias("n")).scalar()
    return done.filter(stop.isNull() | (F.col("entry_no") <= stop))


def prefetch_summary(results: DataFrame, total: DataFrame) -> DataFrame:
    """Counts by status and the number of manifest entries."""
    return results.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("collected", "cache_hit", "skipped", "failed")
    ]).withColumn("total", total.agg(F.count("*").alias("n")).scalar())


def queue_run_summary(results: DataFrame) -> DataFrame:
    """Selected, completed and failed attempts of a queue run (rows with `success`)."""
    return results.agg(
        F.count("*").alias("selected"), F.count_if(F.col("success")).alias("complete"),
        F.count_if(~F.col("success")).alias("failed"))


