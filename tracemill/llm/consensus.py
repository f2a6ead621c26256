"""Confidence-aware truth discovery over several annotators' labels.

Alternates two steps until no bound moves. Annotator step: on the items that look true and on those
that look false, an annotator's error variance has the upper bound ``sum of squared distances /
chi-squared quantile``; few labels give a small quantile, hence a large bound and little weight, so
that rare contributors are neither trusted nor punished for luck. Item step: the consensus is the label at
the least weighted distance from all labels. A label's distance from a candidate is, by its annotator's
bound on the candidate's side, the logarithm of one over the bound if it differs and of one over what the
bound leaves if it agrees: a careful annotator's disagreement is far, a careless one's is near. So an annotator
who mostly says the opposite counts for the opposite, and one who says yes to everything on one side only.

Bounds stay between ``LEAST`` and ``1 - LEAST``, half a label being added to every count, and take half a step
a turn, so that they can't swing. A bound doesn't go beyond one half unless the plain error rate does: few
labels must not turn a poor annotator into an opposite one.

The label rows are partitioned by item once and kept; a turn moves only sums per annotator.

Edge cases: labels or keys that are null count for nothing; of several labels of an annotator on an
item the latest counts (equal times: the true one). Unreadable times come before all others. An item
without labels has a null consensus; a tie is false. An empty table gives empty results. Should the bounds
not settle in ``MAX_TURNS`` turns, a warning says so and ``settled`` is false in the report on annotators.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import kept, sized_broadcast, written

#: Lower quantile of the chi-squared distribution used for the bounds: standard normal at 5 %.
Z = -1.6448536269514722
MAX_TURNS = 60
SETTLED = 1e-3
LEAST = 0.005
#: Annotators whose bounds are sent to all tasks (some MB); more are joined.
SENT = 500_000


def latest(df: DataFrame, item: str, annotator: str, label: str, ts: str) -> DataFrame:
    """``item, annotator, x``: one label of each annotator on each item, annotators in one spelling."""
    who = F.upper(F.regexp_replace(F.col(annotator), r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    when = F.expr(f"coalesce(try_cast(regexp_replace(trim({ts}), 'Z$', '') as timestamp_ntz), timestamp_ntz'0001-01-01 00:00:00')")
    rows = df.select(F.col(item).alias("item"), who.alias("annotator"), when.alias("ts"), F.col(label).alias("x"))
    return rows.where("item is not null and annotator is not null and x is not null").groupBy("item", "annotator").agg(F.max(F.struct("ts", "x"))["x"].alias("x"))


def chi2_low(n: Column) -> Column:
    """The lower quantile at ``Z`` of chi-squared with ``n`` degrees of freedom (Wilson and Hilferty)."""
    n = F.greatest(n, F.lit(1e-6))
    return F.greatest(n * F.pow(F.greatest(1 - 2 / (9 * n) + Z * F.sqrt(2 / (9 * n)), F.lit(0.0)), F.lit(3.0)), n * 0.02)


def bounds(rows: DataFrame) -> DataFrame:
    """``annotator, n, u1, u0, n1, e1, e0`` from rows ``annotator, x, p`` (p: 1 where the item looks true, between 0 and 1 at first)."""
    sums = rows.groupBy("annotator").agg(
        F.count("*").alias("n"), F.sum("p").alias("n1"), F.sum(F.when(F.col("x"), F.lit(0.0)).otherwise(F.col("p"))).alias("e1"), F.sum(F.when(F.col("x"), 1 - F.col("p")).otherwise(F.lit(0.0))).alias("e0"),
    )

    def upper(e: Column, n: Column) -> Column:
        bound = F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), (e + 0.25) / chi2_low(n + 0.5)))
        plain = (e + 0.5) / (n + 1)
        return F.when(plain < 0.5, F.least(bound, F.lit(0.5))).otherwise(plain)

    return sums.select("annotator", "n", upper(F.col("e1"), F.col("n1")).alias("u1"), upper(F.col("e0"), F.col("n") - F.col("n1")).alias("u0"), "n1", "e1", "e0")


def placed(labels: DataFrame, rates: DataFrame, n_annotators: int) -> DataFrame:
    """Labels with ``margin``, by which false is farther than true from all labels of their item, and ``p``, 1 where it is; no shuffle of labels."""
    far = {True: F.log(F.col("u0") / (1 - F.col("u1"))), False: F.log((1 - F.col("u0")) / F.col("u1"))}  # to true, less to false
    weights = rates.select("annotator", far[True].alias("w1"), far[False].alias("w0"))
    rows = labels.join(sized_broadcast(weights, n_annotators, SENT), "annotator")
    away = F.when(F.col("x"), -F.col("w1")).otherwise(-F.col("w0"))
    rows = rows.withColumn("margin", F.sum(away).over(W.partitionBy("item")))
    return rows.withColumn("p", (F.col("margin") > 0).cast("double"))


def discover(labels: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Placed labels ``item, annotator, x, margin, p``, the annotators' bounds, and whether they settled."""
    spark = labels.sparkSession
    labels = written(labels, "labels")
    parts = max(spark.sparkContext.defaultParallelism, labels.count() // 500_000)
    labels = kept(labels.repartition(parts, "item"))
    first = labels.withColumn("p", F.avg(F.col("x").cast("double")).over(W.partitionBy("item")))
    rates = written(bounds(first).coalesce(8), "rates")
    n = rates.count()
    settled = n == 0
    for _ in range(0 if settled else MAX_TURNS):
        old = rates.select("annotator", F.col("u1").alias("a"), F.col("u0").alias("b"))
        new = bounds(placed(labels, rates, n)).join(old, "annotator")
        new = new.select("annotator", "n", ((F.col("u1") + F.col("a")) / 2).alias("u1"), ((F.col("u0") + F.col("b")) / 2).alias("u0"), "n1", "e1", "e0", F.greatest(F.abs(F.col("u1") - F.col("a")), F.abs(F.col("u0") - F.col("b"))).alias("moved"))
        rates = written(new.coalesce(8), "rates")
        if rates.agg(F.max("moved")).first()[0] < SETTLED:
            settled = True
            break
    if not settled:
        warnings.warn(f"the bounds of annotators did not settle in {MAX_TURNS} turns", stacklevel=2)
    return placed(labels, rates, n), rates, settled


def consensus(df: DataFrame, item: str = "audit_id", annotator: str = "annotator", label: str = "genuine_paste", ts: str = "ts") -> DataFrame:
    """``item, consensus, confidence, agreement, n_labels`` for every item of ``df``.

    ``agreement`` is the share of pairs of an item's labels that are equal (1 for a single label).
    """
    rows, _, _ = discover(latest(df, item, annotator, label, ts))
    n, k = F.count("*"), F.count_if("x")
    same = F.when(n < 2, F.lit(1.0)).otherwise((k * (k - 1) + (n - k) * (n - k - 1)) / (n * (n - 1)))
    out = rows.groupBy("item").agg((F.first("p") > 0.5).alias("consensus"), (1 / (1 + F.exp(-F.least(F.abs(F.first("margin")), F.lit(50.0))))).alias("confidence"), same.alias("agreement"), n.alias("n_labels"))
    items = df.select(F.col(item).alias("item")).where("item is not null").distinct()
    return items.join(out, "item", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0))).withColumnRenamed("item", item)


def reliability(df: DataFrame, item: str = "audit_id", annotator: str = "annotator", label: str = "genuine_paste", ts: str = "ts") -> DataFrame:
    """``annotator, n_labels, hit_rate_true, hit_rate_false, reliability, settled`` against the consensus.

    ``reliability`` is the mean of the lower bounds of both hit rates, so it is careful with rare annotators.
    """
    _, rates, settled = discover(latest(df, item, annotator, label, ts))
    return rates.select(
        "annotator", F.col("n").alias("n_labels"), (1 - F.try_divide("e1", "n1")).alias("hit_rate_true"), (1 - F.try_divide(F.col("e0"), F.col("n") - F.col("n1"))).alias("hit_rate_false"),
        ((2 - F.col("u1") - F.col("u0")) / 2).alias("reliability"), F.lit(settled).alias("settled"),
    )
