"""Append-only run logs as streams: latest usable row per key, kept up to date batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tracemill.operators.labels import latest


def read_log(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def _manifest(spark: SparkSession, path: str, epoch: int) -> dict[str, int]:
    """Which epoch holds each bucket after ``epoch``; an error if that epoch is missing."""
    if epoch < 0:
        return {}
    return json.loads(spark.read.text(f"{path}/manifest/epoch={epoch}").first()[0])


def _of(spark: SparkSession, path: str, buckets: dict[str, int], schema: StructType) -> DataFrame | None:
    files = [f"{path}/data/epoch={e}/_b={b}" for b, e in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*files) if files else None


def upserted(batch: DataFrame, epoch: int, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Bring the table up to date with a batch: only the buckets of keys that the batch touches are rewritten.

    Each epoch writes its buckets to a folder of its own and then a manifest that says where every bucket is; a repeated
    epoch writes the same again. A missing earlier manifest is an error, so that history is never silently lost.
    """
    spark = batch.sparkSession
    known = _manifest(spark, path, epoch - 1)
    new = batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [str(r[0]) for r in new.select("_b").distinct().collect()]  # at most ``buckets``
    old = _of(spark, path, {b: known[b] for b in touched if b in known}, batch.schema)
    if touched:
        rows = batch if old is None else old.unionByName(batch)
        rows = latest(rows, keys, order).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/data/epoch={epoch}")
    manifest = json.dumps(known | dict.fromkeys(touched, epoch), sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest/epoch={epoch}")


def table_at(spark: SparkSession, path: str, epoch: int, schema: StructType) -> DataFrame:
    """The table as it was after an epoch."""
    found = _of(spark, path, _manifest(spark, path, epoch), schema)
    return spark.createDataFrame([], schema) if found is None else found


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda b, e: upserted(b, e, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and failures per window and key; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"))
