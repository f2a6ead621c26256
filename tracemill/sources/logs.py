"""Reading and writing JSON Lines and Parquet logs, and paged web sources."""

from __future__ import annotations

import difflib
import json
import re
import time
from collections.abc import Callable, Iterator
from hashlib import sha256
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracemill.operators.labels import latest

RESULT = "model string, case_id string, response string, finish_reason string, error string, temperature double"


def qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, as the reader of files gives it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: str | StructType = RESULT) -> DataFrame:
    """Typed rows of JSON Lines with the keys each line had, its file and its place; blank lines are skipped.

    An unreadable line fails the read and is quoted in the error. Files keep the order given; a folder's files share
    its place and are ordered by name. Large files are read in parts: a line's number is the lines of the parts before
    it and its place in its own part.
    """
    paths = [qualified(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    lines = spark.read.text(paths).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    part = W.partitionBy("file", "_part")
    lines = lines.withColumn("_n", F.row_number().over(part.orderBy("_at")))
    sizes = lines.groupBy("file", "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy("file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(sizes.select("file", "_part", before.alias("_before")), ["file", "_part"]).withColumn("line_no", F.col("_before") + F.col("_n")).where(F.trim("line") != "")
    places = spark.createDataFrame([(i, p.rstrip("/")) for i, p in enumerate(paths)], "file_no int, path string")
    named = lines.select("file").distinct().join(F.broadcast(places), (F.col("file") == F.col("path")) | F.col("file").startswith(F.concat("path", F.lit("/"))))  # the paths given
    order = named.groupBy("file").agg(F.min("file_no").alias("file_no"))
    keys = F.json_object_keys("line")
    bad = F.raise_error(F.concat(F.lit("unreadable line "), F.col("line_no").cast("string"), F.lit(" of "), "file", F.lit(": "), F.left("line", F.lit(200))))
    row = F.from_json(F.when(keys.isNotNull(), F.col("line")).otherwise(bad.cast("string")), schema, {"mode": "FAILFAST"})
    return lines.join(order, "file").select("file_no", "file", "line_no", keys.alias("keys"), row.alias("r")).select("file_no", "file", "line_no", "keys", "r.*")


def merged_histories(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key over several files: of a later file, then of a later line."""
    return latest(rows, keys, ["file_no", "file", "line_no"])


def trace_path(results: str) -> str:
    """The companion file of a result log: ``x.jsonl`` has its traces in ``x.traces.jsonl``."""
    return f"{results[:-6]}.traces.jsonl" if results.endswith(".jsonl") else f"{results}.traces.jsonl"


def append_run(results: DataFrame, traces: DataFrame, path: str, resume: bool = False) -> None:
    """Append result rows and their traces to a log and its companion."""
    write_jsonl(results, path, resume)
    write_jsonl(traces, trace_path(path), resume)


def write_jsonl(df: DataFrame, path: str, resume: bool = False) -> None:
    """One JSON object a line, UTF-8, nulls kept; an existing output is refused unless resuming."""
    df.write.mode("append" if resume else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_partitioned(df: DataFrame, path: str, column: str = "release_partition") -> None:
    df.repartition(column, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(16))).write.partitionBy(column).parquet(path)


def read_shards(spark: SparkSession, glob: str, columns: list[str], key: str | None = None) -> DataFrame:
    """Columns of Parquet shards; with a key, the row of the first shard (by name) that has it. Only the columns are read."""
    rows = spark.read.parquet(glob).select(*columns, F.col("_metadata.file_path").alias("_shard"))
    if key is None:
        return rows.drop("_shard")
    rest = [c for c in columns if c != key]
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_shard", *rest)).alias("_r"))
    return first.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in columns])


def fingerprints(spark: SparkSession, glob: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))


def canonical(payload: object) -> tuple[str, str]:
    """Canonical JSON of a report and its hash."""
    s = json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
    return s, sha256(s.encode()).hexdigest()


def check(payload: object, expected: str) -> list[str]:
    """Lines in which a report differs from an earlier canonical one; none if they agree."""
    now = canonical(payload)[0]
    return [x for x in difflib.unified_diff(expected.splitlines(), now.splitlines(), lineterm="", n=0) if not x.startswith(("---", "+++", "@@"))]


def report(df: DataFrame, order: list[str], most: int = 10_000) -> list[dict]:
    """A small report as dicts in order; a table of more than ``most`` rows is refused."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("not a report: too many rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown(rows: list[dict]) -> str:
    if not rows:
        return ""
    head = list(rows[0])
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows)]) + "\n"


def get_json(url: str, attempts: int = 4, timeout: int = 60, opened: Callable = urlopen, sleep: Callable = time.sleep) -> object:
    """JSON of a URL; waits 1, 2, 4 .. seconds between attempts."""
    for k in range(attempts):
        try:
            with opened(url, timeout=timeout) as f:
                return json.load(f)
        except OSError:
            if k == attempts - 1:
                raise
            sleep(2**k)
    raise AssertionError


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class PagedSource(DataSource):
    """Rows of a paged web API, one partition a page: options url (with {offset}), rows, page, field."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "offset long, row string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [Page(k) for k in range(0, int(self.o["rows"]), int(self.o.get("page", 100)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        doc = get_json(self.o["url"].format(offset=partition.offset))
        for k, row in enumerate(doc[self.o.get("field", "rows")]):
            if partition.offset + k < int(self.o["rows"]):
                yield partition.offset + k, json.dumps(row, ensure_ascii=False)


class SequentialSource(DataSource):
    """Rows of a paged web API that says whether there are more pages (``has_more``): one reader, page after page.

    Options: url (with {page}), pages (the most to read), field (of the rows), more (of the flag).
    """

    @classmethod
    def name(cls) -> str:
        return "sequential_json"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SequentialReader(dict(self.options))


class SequentialReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(1, int(self.o.get("pages", 4)) + 1):
            doc = get_json(self.o["url"].format(page=page))
            for row in doc[self.o.get("field", "items")]:
                yield page, json.dumps(row, ensure_ascii=False)
            if not doc.get(self.o.get("more", "has_more")):
                return


#: Readers of source items by name: each takes a session and options and gives a frame.
LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        LOADERS[name] = f
        return f

    return add


@loader("jsonl")
def _load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, path, schema)


@loader("parquet")
def _load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@loader("paged")
def _load_paged(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(**options).load()


@loader("sequential")
def _load_sequential(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(SequentialSource)
    return spark.read.format("sequential_json").options(**options).load()


def write_array(df: DataFrame, path: str, order: list[str], most: int = 10_000) -> None:
    """A small table as one JSON array (a pilot's cases); a table of more than ``most`` rows is refused."""
    rows = report(df, order, most)
    df.sparkSession.createDataFrame([(json.dumps(rows, ensure_ascii=False, indent=2, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
