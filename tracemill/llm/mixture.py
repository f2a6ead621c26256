"""Mixing sources to target shares, measured in tokens.

The size of the whole is the largest at which every source that has text can hold its share without
any document being used more than ``max_repeats`` times; a caller may ask for less. A source's budget
is that size times its share of the weights of the sources that have text: as many whole epochs as
fit, then a hash-random order of its documents up to the rest of the budget. The order is cut by
distributed prefix sums: documents fall into ranges of their random key, the ranges' sums are added
up, and only then are documents added up inside their range, so a source with a third of all rows is
spread over many tasks.

Edge cases: documents without tokens (null or empty text) or of a source that is not listed, null
included, take no part. Sources are compared in lower case without blanks at the edges. A listed
source without documents or with a weight of zero or null gets share 0 and leaves its share to the
others. Spellings of one listed source count once: their weights are added up, the least ``max_repeats`` holds. ``max_repeats`` below 1 or null counts as 1. A document that crosses the end of the budget is
taken if more than half of it fits. Repeated texts under other ids are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.bpe import FOLDER, count_tokens
from tracemill.session import kept, written

#: Ranges of the random key per source, as bits.
RANGE_BITS = 12
#: Blanks and invisible signs at the edges of a source's name.
EDGES = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"


def named(c: str) -> Column:
    """A source's name in one spelling."""
    return F.lower(F.regexp_replace(c, EDGES, ""))


def sized(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``doc_id, source, n_tokens, key`` of the documents that have tokens; written once, as it is read often."""
    rows = docs.where("source is not null and text <> ''").select("doc_id", named("source").alias("source"), "text")
    key = F.xxhash64(F.lit("mix"), F.col("doc_id"))
    # written before it is filtered: a filter on the count would have every text tokenized once more
    return written(count_tokens(rows, "text", "n_tokens", folder).select("doc_id", "source", "n_tokens", key.alias("key")), "sized").where("n_tokens > 0")


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per listed source: ``share, have, budget, epochs, rest``."""
    t = targets.select(named("source").alias("source"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    t = t.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n_docs"))
    t = t.where("source is not null").join(have, "source", "left").na.fill({"have": 0, "n_docs": 0})
    live = F.when((F.col("have") > 0) & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)
    every = W.partitionBy(F.lit(1))  # the listed sources only
    t = t.withColumn("wanted", F.try_divide("weight", F.sum("weight").over(every))).withColumn("share", F.coalesce(F.try_divide(live, F.sum(live).over(every)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("have") * F.col("max_repeats") / F.col("share"))).over(every)
    whole = most if total is None else F.least(most, F.lit(float(total)))
    t = t.withColumn("budget", F.coalesce(F.col("share") * whole, F.lit(0.0)))
    epochs = F.when(F.col("have") > 0, F.floor((F.col("budget") + 1e-6) / F.col("have"))).otherwise(0)
    return t.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("have")))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``doc_id, source, copies, n_tokens``: the documents in the mix (see ``sized`` for ``docs``)."""
    p = kept(plan(docs, targets, total))
    span = F.shiftrightunsigned("key", 64 - RANGE_BITS)
    d = docs.join(F.broadcast(p.select("source", "epochs", "rest", "max_repeats")), "source").withColumn("range", span)  # one row per listed source
    sums = d.groupBy("source", "range").agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # at most 2 ** RANGE_BITS rows a source
    starts = sums.select("source", "range", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    d = d.join(starts, ["source", "range"]).withColumn("upto", F.col("start") + inside)
    more = F.col("upto") - F.col("n_tokens") / 2 < F.col("rest")
    copies = F.least(F.col("max_repeats"), F.col("epochs") + F.when(more, 1).otherwise(0))
    return d.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "copies", "n_tokens")


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """The report: wanted and reached share of every listed source."""
    got = mix(docs, targets, total).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("used_docs"))
    out = plan(docs, targets, total).join(got, "source", "left").na.fill({"tokens": 0, "most_copies": 0, "used_docs": 0})
    reached = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0))
    return out.select("source", "wanted", F.col("share").alias("target_share"), reached.alias("reached_share"), "tokens", "budget", "have", "n_docs", "used_docs", "most_copies", "max_repeats")
