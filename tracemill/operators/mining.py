"""Mining a conversation corpus: samples, neighbours, screens and joins by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified(df: DataFrame, item: str, text: str, source: str, limit: int, strict: bool = True) -> DataFrame:
    """``limit`` items per source, evenly from the thirds of text length, in hash order.

    Items with equal text count once (least id). A source with fewer items fails the query, or with
    ``strict`` false gives all it has. Thirds come from exact counts of lengths, which are few whatever the number of items.
    """
    d = df.where(F.col(text).isNotNull() & F.col(source).isNotNull()).groupBy(source, F.sha2(F.col(text).cast("binary"), 256).alias("_h")).agg(F.min(item).alias(item), F.first(F.length(text)).alias("_n"))
    lengths = d.groupBy(source, "_n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(source).orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("c").over(W.partitionBy(source))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q / 3), F.col("_n")))
    cuts = lengths.select(source, "_n", upto.alias("upto"), total.alias("total")).groupBy(source).agg(at(1).alias("lo"), at(2).alias("hi"), F.max("total").alias("_total"))
    if strict:
        short = F.raise_error(F.concat(F.col(source), F.lit(": only "), F.col("_total").cast("string"), F.lit(f" items for {limit}")))
        cuts = cuts.where(F.when(F.col("_total") < limit, short.cast("boolean")).otherwise(True))
    b = d.join(cuts, source).withColumn("bucket", F.when(F.col("_n") <= F.col("lo"), 0).when(F.col("_n") <= F.col("hi"), 1).otherwise(2))
    key = F.sha2(F.concat_ws(":", source, F.col(item).cast("string")).cast("binary"), 256)
    # ranks beyond the limit can't be drawn: the window keeps only a top of each bucket
    r = b.withColumn("rank", F.row_number().over(W.partitionBy(source, "bucket").orderBy(key))).where(F.col("rank") <= limit)
    drawn = r.withColumn("draw", F.row_number().over(W.partitionBy(source).orderBy("rank", "bucket"))).where(F.col("draw") <= limit)
    return drawn.select(source, item, "bucket", "rank")


def neighbours(df: DataFrame, key: str, vector: str, label: str, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` nearest rows (by cosine, then key) of every query row, itself aside.

    Queries are a stated set, taken in blocks: a block is broadcast, every partition keeps its best k
    per query by matrix products, and the partial lists are merged by a window. Null or zero vectors
    are no neighbours and have none.
    """
    spark = df.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(key, vector).orderBy(key)
    out = None
    rows = q.toLocalIterator(prefetchPartitions=True)
    while True:
        part = [r for _, r in zip(range(block), rows, strict=False)]
        if not part:
            break
        ids, m = [r[0] for r in part], np.array([r[1] for r in part], dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        shared = spark.sparkContext.broadcast((ids, m))

        def top(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, m = shared.value
            for pdf in it:
                v = np.array(pdf[vector].tolist(), dtype=np.float64)
                n = np.linalg.norm(v, axis=1)
                pdf, v = pdf[n > 0], v[n > 0] / n[n > 0][:, None]
                if not len(pdf):
                    continue
                s = np.round(m @ v.T, 9)
                own = pdf[key].to_numpy()
                s[np.array(ids)[:, None] == own[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                take = np.take_along_axis(s, order, 1)
                keep = np.isfinite(take)
                yield pd.DataFrame({"q": np.repeat(ids, order.shape[1])[keep.ravel()], "id": own[order].ravel()[keep.ravel()], "score": take.ravel()[keep.ravel()], "label": pdf[label].to_numpy()[order].ravel()[keep.ravel()]})

        kind = dict(df.dtypes)
        part_df = df.where(F.col(vector).isNotNull()).select(key, vector, label).mapInPandas(top, f"q {kind[key]}, id {kind[key]}, score double, label {kind[label]}")
        out = part_df if out is None else out.unionByName(part_df)
    if out is None:
        return df.select(F.col(key).alias("q"), F.col(key).alias("id"), F.lit(0.0).alias("score"), label, F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def vote(nearest: DataFrame, queries: DataFrame, key: str, label: str) -> DataFrame:
    """Share of neighbours with the query's own label, and whether it is at least one half."""
    n = nearest.join(queries.select(F.col(key).alias("q"), F.col(label).alias("own")), "q")
    return n.groupBy("q").agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("share")).withColumn("agrees", F.col("share") >= 0.5)


def first_turn(conversations: DataFrame) -> DataFrame:
    """``conversation_hash, text``: the first user turn of arrays of (role, content)."""
    mine = F.filter("conversation", lambda t: t["role"] == "user")
    return conversations.select("conversation_hash", F.try_element_at(mine, F.lit(1))["content"].alias("text"))


def collapsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes of texts equal but for case and layout: representative (least key) and size; partial aggregates only."""
    bare = F.lower(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.trim(bare).cast("binary"), 256).alias("class")).agg(F.min(key).alias("representative"), F.count("*").alias("size"))


def screened(df: DataFrame, text: str) -> DataFrame:
    """Structural screen of first turns: a request, a blank line, a body of several lines or a fence, a short last paragraph."""
    parts = F.split(F.trim(text), r"\n[ \t]*\n")
    body = F.size(parts) >= 3
    short = (F.length(F.element_at(parts, -1)) <= 200) & (F.length(F.element_at(parts, 1)) <= 400)
    return df.where(F.col(text).isNotNull() & body & short)
