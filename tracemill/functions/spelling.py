"""Canonical spellings of names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import sized_broadcast

#: Characters that carry no meaning at the edges of an identifier: white space, controls, BOM, zero width.
EDGE = r"[\s\p{Z}\p{Cc}\p{Cf}]+"


def squeezed(c: Column) -> Column:
    """Lower case, without blanks and invisible characters at the edges, inner blanks as one space."""
    bare = F.regexp_replace(F.regexp_replace(c, rf"^{EDGE}|{EDGE}$", ""), r"[\s\p{Z}]+", " ")
    return F.lower(F.when(c.rlike("[^!-~]"), bare).otherwise(c))  # most are plain and need no rewriting


def canonical_model(df: DataFrame, registry: DataFrame, column: str = "model", to: str = "model_key") -> DataFrame:
    """Add ``to``: the registry's key for any of a model's names, else the squeezed spelling; null stays null."""
    names = (
        registry.select(F.col("model").alias("_key"), F.explode(F.array("model", "display_name", "route")).alias("_name"))
        .select(squeezed(F.col("_key")).alias("_key"), squeezed(F.col("_name")).alias("_name"))
        .where("_name is not null")
        .groupBy("_name")
        .agg(F.min("_key").alias("_key"))
    )
    out = df.withColumn("_name", squeezed(F.col(column)))
    return out.join(sized_broadcast(names, names.count()), "_name", "left").withColumn(to, F.coalesce("_key", "_name")).drop("_key", "_name")
