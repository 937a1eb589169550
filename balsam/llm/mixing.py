"""Mix sources to target weights by budgets that flow down a domain-language-source tree.

A node shares its budget among its children by weight; a child gets no more than its documents give in
`MAX_EPOCHS` passes, and what it leaves goes to its siblings.  Only what a whole subtree lacks reaches
the siblings of its ancestors.  A leaf takes whole epochs and, of one more, the documents that a seeded
order puts first.  The cut of that order is found from sums per hash bucket, so the leaf that holds a
third of all rows is never sorted, and texts are filtered where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

LEVELS = ("domain", "language", "leaf_source")
#: Target weight of a node without a given one: its tokens to this power, which lifts small sources.
TEMPERATURE = 0.7
#: Tokens asked for, as a share of all; most passes over a document; seed of the orders.
BUDGET_SHARE, MAX_EPOCHS, SEED = 1.0, 2, 20
#: Leading bits of the 60-bit order that are summed before rows are looked at.
BUCKET_BITS = 16

ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, text, coalesce(source, '') AS leaf_source, coalesce(lang, '') AS language,
         regexp_replace(coalesce(source, ''), '[0-9]$', '') AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, leaf_source, sum(n_tokens)::BIGINT AS t FROM rows_ GROUP BY ALL),
l1 AS (SELECT domain, sum(t)::DOUBLE * 2 AS cap, pow(sum(t), 0.7) AS w, (SELECT sum(t)::DOUBLE FROM leaves) AS b FROM leaves GROUP BY ALL),
s1 AS (SELECT *, sum(cap) OVER o - cap AS before_cap, sum(w) OVER () - (sum(w) OVER o - w) AS rest_w FROM l1
       WINDOW o AS (ORDER BY cap / greatest(w, 1e-300), domain ROWS UNBOUNDED PRECEDING)),
f1 AS (SELECT *, cap * rest_w <= (b - before_cap) * w AS full_ FROM s1),
a1 AS (SELECT domain, CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (WHERE full_) OVER (), 0))
       / nullif(sum(w) FILTER (WHERE NOT full_) OVER (), 0) END AS b FROM f1),
l2 AS (SELECT domain, language, sum(t)::DOUBLE * 2 AS cap, pow(sum(t), 0.7) AS w, any_value(b) AS b FROM leaves JOIN a1 USING (domain) GROUP BY ALL),
s2 AS (SELECT *, sum(cap) OVER o - cap AS before_cap, sum(w) OVER p - (sum(w) OVER o - w) AS rest_w FROM l2
       WINDOW p AS (PARTITION BY domain), o AS (PARTITION BY domain ORDER BY cap / greatest(w, 1e-300), language ROWS UNBOUNDED PRECEDING)),
f2 AS (SELECT *, cap * rest_w <= (b - before_cap) * w AS full_ FROM s2),
a2 AS (SELECT domain, language, CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (WHERE full_) OVER p, 0))
       / nullif(sum(w) FILTER (WHERE NOT full_) OVER p, 0) END AS b FROM f2 WINDOW p AS (PARTITION BY domain)),
l3 AS (SELECT domain, language, leaf_source, sum(t)::DOUBLE * 2 AS cap, pow(sum(t), 0.7) AS w, any_value(b) AS b, sum(t) AS t
       FROM leaves JOIN a2 USING (domain, language) GROUP BY ALL),
s3 AS (SELECT *, sum(cap) OVER o - cap AS before_cap, sum(w) OVER p - (sum(w) OVER o - w) AS rest_w FROM l3
       WINDOW p AS (PARTITION BY domain, language),
              o AS (PARTITION BY domain, language ORDER BY cap / greatest(w, 1e-300), leaf_source ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT *, cap * rest_w <= (b - before_cap) * w AS full_ FROM s3),
a3 AS (SELECT domain, language, leaf_source, t, floor(CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (WHERE full_) OVER p, 0))
       / nullif(sum(w) FILTER (WHERE NOT full_) OVER p, 0) END + 1e-6)::BIGINT AS take FROM f3 WINDOW p AS (PARTITION BY domain, language)),
plan AS (SELECT *, CASE WHEN t > 0 THEN take // t ELSE 0 END AS epochs, CASE WHEN t > 0 THEN take % t ELSE 0 END AS rest FROM a3),
ordered AS (
  SELECT r.*, epochs, rest, ('0x' || substr(md5('20|' || epochs::BIGINT::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS ord
  FROM rows_ r JOIN plan USING (domain, language, leaf_source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, leaf_source ORDER BY ord RANGE UNBOUNDED PRECEDING)
             - sum(n_tokens) OVER (PARTITION BY domain, language, leaf_source, ord) AS before_tokens FROM ordered)
SELECT doc_id, unnest(range(0, (epochs + (before_tokens < rest)::INT)::BIGINT))::BIGINT AS epoch, domain, language, leaf_source, n_tokens FROM summed
"""


def token_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Rows (parent, name, cap, w, b) with `b` set to the node's share of its parent's budget b.

    Children fill in the order of cap / w; each is full if the budget left for it and those after it
    covers its cap; the others share the rest by weight."""
    of_parent = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of_parent.orderBy(F.col("cap") / F.greatest("w", F.lit(1e-300)), name).rowsBetween(Window.unboundedPreceding, 0)
    filled = nodes.withColumns({"before_cap": F.sum("cap").over(order) - F.col("cap"),
                                "rest_w": F.sum("w").over(of_parent) - (F.sum("w").over(order) - F.col("w"))})
    filled = filled.withColumn("full", F.col("cap") * F.col("rest_w") <= (F.col("b") - F.col("before_cap")) * F.col("w"))
    left = F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(of_parent), F.lit(0.0))
    weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(of_parent)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * left / F.when(weight != 0, weight))
    return filled.withColumn("b", F.coalesce(share, F.lit(0.0))).drop("before_cap", "rest_w", "full")


def plan_leaves(leaves: DataFrame, budget: float, weights: dict[tuple[str, ...], float] | None = None,
                max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """LEVELS, t, epochs, rest per leaf from (LEVELS, t): whole passes, and tokens of one pass more.

    `weights` gives target weights of nodes by path; other nodes weigh their tokens to TEMPERATURE."""
    plan = leaves.withColumn("b", F.lit(float(budget)))
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = plan.groupBy(*path).agg((F.sum("t").cast("double") * max_epochs).alias("cap"),
                                        F.pow(F.sum("t"), F.lit(TEMPERATURE)).alias("w"), F.max("b").alias("b"))
        for given, weight in (weights or {}).items():
            if len(given) == depth + 1:
                same = F.lit(True)
                for column, value in zip(path, given, strict=True):
                    same = same & (F.col(column) == value)
                nodes = nodes.withColumn("w", F.when(same, F.lit(float(weight))).otherwise(F.col("w")))
        shared = share_out(nodes, path[:-1], name).select(*path, "b")
        plan = settle(plan.drop("b").join(shared, path))
    take = F.floor(F.col("b") + 1e-6).cast("bigint")
    out = plan.withColumn("take", take).select(
        *LEVELS, "t", F.when(F.col("t") > 0, F.expr("take div t")).otherwise(0).alias("epochs"),
        F.when(F.col("t") > 0, F.expr("take % t")).otherwise(0).alias("rest"))
    return settle(out)


def mix_sources(docs: DataFrame, budget_share: float = BUDGET_SHARE, weights: dict[tuple[str, ...], float] | None = None,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED, text: str = "text", id_column: str = "doc_id",
                lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of `docs` with domain, language, leaf_source, n_tokens and epoch: one row per pass that takes them.

    Sources whose names differ in a last digit form a domain.  Tokens are words.  A leaf's last pass
    takes a document if those before it in the seeded order hold fewer tokens than the leaf still
    wants; ties (equal ids and texts) are taken together.  Null languages and sources are empty names,
    null ids and texts hash as empty ones; documents without words come with whole passes only; an
    empty table gives no rows.  Other columns pass through, except those of the added names."""
    added = ["domain", "language", "leaf_source", "n_tokens", "epoch"]
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    tree = {"domain": F.regexp_replace(name, "[0-9]$", ""), "language": F.coalesce(F.col(lang).cast("string"), F.lit("")),
            "leaf_source": name, "n_tokens": token_count(text)}
    plain = docs.select(*[c for c in docs.columns if c not in added])
    rows = plain.withColumns(tree)
    mark = F.md5(F.coalesce(F.col(text), F.lit("")))
    narrow = settle(rows.select(*LEVELS, "n_tokens", F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), mark.alias("mark")))
    leaves = settle(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t")))
    total = leaves.agg(F.sum("t")).first()[0] or 0
    plan = plan_leaves(leaves, total * budget_share, weights, max_epochs)

    def ordinal(epoch: str, doc: Column, mark: Column) -> Column:
        key = F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), doc, mark)
        return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")

    ordered = narrow.join(plan, list(LEVELS)).where("rest > 0").withColumn("ord", ordinal("epochs", F.col("id"), F.col("mark")))
    ordered = ordered.withColumn("bucket", F.shiftright("ord", 60 - BUCKET_BITS))
    by_bucket = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.max("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(by_bucket), F.lit(0)))
    # The bucket in which a leaf's wish ends, and there the first position that is not taken.
    last = sums.where("before < rest and before + in_bucket >= rest").select(*LEVELS, "bucket", "before")
    inside = ordered.join(last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "bucket", "ord").agg(
        F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    running = Window.partitionBy(*LEVELS, "bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("so_far", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0))).where("so_far < rest").groupBy(
        *LEVELS).agg(F.max("ord").alias("cut"))
    goal = settle(plan.join(cut, list(LEVELS), "left").select(
        *[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("epochs").alias("__epochs"), F.coalesce("cut", F.lit(-1)).alias("__cut")))
    discard(narrow, leaves)
    same = [F.col(c) == F.col(f"__{c}") for c in LEVELS]
    more = (ordinal("__epochs", F.coalesce(F.col(id_column).cast("string"), F.lit("")), mark) <= F.col("__cut")).cast("int")
    out = rows.join(goal, same).withColumn("__passes", F.col("__epochs") + more).where("__passes > 0")
    passes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__passes") - 1))
    return out.select(*plain.columns, *[c for c in added if c != "epoch"], passes.alias("epoch"))
