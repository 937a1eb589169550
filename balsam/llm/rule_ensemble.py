"""Quality scores from a sparse ensemble of rules over text statistics.

Spark grows a forest of shallow trees on the labelled rows; each path from a root to a node is a rule,
a conjunction of bounds on statistics.  A lasso logistic regression on the rules gives most of them no
weight.  The rules left are compiled into one Spark column expression, so scoring is a projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

#: Statistics of a text that rules look at; none is an id, a label, a language or a source.
STATISTICS = ["log_words", "word_length", "distinct_words", "upper_share", "symbol_share", "bang_share",
              "digit_share", "stop_share", "symbol_words", "line_words"]
TREES, DEPTH, SEED = 24, 3, 17
LASSO = 2e-4
PREDICT_FROM = 0.3
HELD_OUT_PARTS = 5
_WORD = r"[^\x20\x09-\x0D]+"


def held_out(id_column: str) -> Column:
    """Rows never learned from: crc32 of the id as text divides by five (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % HELD_OUT_PARTS == 0


def statistics(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """doc_id and STATISTICS per row, from whole texts; all 0 for a null or empty one."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("double")
    raw = docs.select(F.col(id_column).alias("doc_id"), t.alias("t")).select(
        "doc_id", F.length("t").cast("double").alias("n"), F.regexp_extract_all("t", F.lit(f"({_WORD})")).alias("w"),
        count("[A-Z]").alias("upper"), count(r"[#*$%&|<>]").alias("symbols"), count("!").alias("bangs"),
        count("[0-9]").alias("digits"), count("[.,;:?]").alias("stops"), count(r"[#*$%&|<>!](?=[\x20\x09-\x0D]|$)").alias("marked"),
        (count("\n") + 1).alias("lines"))
    raw = raw.withColumns({"words": F.size("w").cast("double"), "distinct": F.size(F.array_distinct("w")).cast("double")})
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return raw.select(
        "doc_id", F.log1p("words").alias("log_words"), per("n", "words").alias("word_length"),
        per("distinct", "words").alias("distinct_words"), per("upper", "n").alias("upper_share"),
        per("symbols", "n").alias("symbol_share"), per("bangs", "n").alias("bang_share"), per("digits", "n").alias("digit_share"),
        per("stops", "n").alias("stop_share"), per("marked", "words").alias("symbol_words"), per("words", "lines").alias("line_words"))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper bound, value) that all hold, and the rule's weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, upper, value in self.bounds:
            out = out & ((F.col(name) <= value) if upper else (F.col(name) > value))
        return out


def tree_rules(forest) -> list[Rule]:
    """The paths to all nodes of all trees, equal ones once, each without bounds that a later one tightens."""
    found: dict[Rule, None] = {}

    def walk(node, bounds):
        if bounds:
            tight = {}
            for name, upper, value in bounds:
                old = tight.get((name, upper), value)
                tight[name, upper] = min(old, value) if upper else max(old, value)
            found[Rule(tuple((n, u, v) for (n, u), v in sorted(tight.items())))] = None
        if node.numDescendants() > 0:
            split = node.split()
            name, value = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*bounds, (name, True, value)])
            walk(node.rightChild(), [*bounds, (name, False, value)])

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


@dataclass(frozen=True)
class Ensemble:
    """A logistic score: bias and weighted rules."""

    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(rows: DataFrame) -> Ensemble:
    """Learn from rows with STATISTICS and a column `label` of 0 or 1.

    Without rows, or with one label only, the score is the smoothed share of label 1."""
    ones = rows.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    n, k = ones["n"], int(ones["k"] or 0)
    if k in (0, n):
        return Ensemble(math.log((k + 1) / (n - k + 1)), ())
    vector = array_to_vector(F.array(*STATISTICS))
    data = settle(rows.select(*STATISTICS, F.col("label").cast("double").alias("label")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="onethird",
                                    cacheNodeIds=False).fit(data.select(vector.alias("features"), "label"))
    rules = tree_rules(forest)
    flags = array_to_vector(F.array(*[r.column().cast("double") for r in rules]))
    weights = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5, standardization=False).fit(
        settle(data.select(flags.alias("features"), "label").repartition(_parts(data))))
    discard(data)
    kept = tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights.coefficients, strict=True) if abs(w) > 1e-9)
    return Ensemble(float(weights.intercept), kept)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
                  label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Labels are learned from all labelled rows that are not held out; a null label or id teaches
    nothing, and a doc_id labelled twice teaches its largest label.  Null and empty texts get the score
    of zero statistics.  Other columns are ignored; an empty table gives no rows."""
    made = settle(statistics(docs, text, id_column).withColumn("held_out", held_out("doc_id")))
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(
        F.max(label).alias("label"))
    ensemble = fit_rules(made.where("not held_out").join(known, "doc_id"))
    scored = made.withColumn("score", ensemble.score())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
