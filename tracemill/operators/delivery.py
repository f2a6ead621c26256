"""At-least-once delivery: keep exactly one row per message.

The identifiers seen so far are kept as immutable runs of sorted arrays, by prefix of the identifier's
hash, in the shared folder. A batch is first reduced to its best row per identifier (a partial aggregate,
so that one identifier with a third of all rows is no problem), then binary-searched in the runs of the
prefixes it touches: identifiers that are new, or whose new row is better than the one kept, become the
prefix's next run. Nothing that was written is changed: an entry of a later run stands for the same
identifier's entries of earlier ones. Once a prefix has more than ``max_runs`` runs they are merged to one.
A manifest per batch says which folders hold each prefix's runs; other prefixes aren't read or written.

Edge cases: a row with a null in any identifier column is a message of its own and always stays.
Null ``error`` and an ``error`` of blanks are no error text. Rows equal in every column but ``seq``
are copies. An empty table gives an empty index. Columns beyond those named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import fresh_path, written

INDEX = "prefix long, run int, hi array<long>, lo array<long>, clean array<boolean>, seq array<long>"
#: One run, and whether it stands for all earlier ones of its prefix.
RUN = "prefix long, whole boolean, hi array<long>, lo array<long>, clean array<boolean>, seq array<long>"
ROWS_PER_PREFIX = 200_000


class Runs:
    """Sorted runs of one prefix. An identifier is 128 bits: ``hi`` sorts, ``lo`` settles ties."""

    def __init__(self, max_runs: int = 8) -> None:
        self.runs: list[list[np.ndarray]] = []
        self.max_runs = max_runs

    @staticmethod
    def find(run: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Position of each identifier in the run, or -1."""
        at = np.searchsorted(run[0], hi, side="left")
        found = np.full(len(hi), -1)
        open_ = np.arange(len(hi))
        while len(open_):  # more than one turn only where 64 bits collide
            open_ = open_[at[open_] < len(run[0])]
            open_ = open_[run[0][at[open_]] == hi[open_]]
            same = run[1][at[open_]] == lo[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return found

    @staticmethod
    def best(hi: np.ndarray, lo: np.ndarray, clean: np.ndarray, seq: np.ndarray) -> list[np.ndarray]:
        """Sorted, with the best row of each identifier: one without error text, then the largest ``seq``."""
        order = np.lexsort((-seq, ~clean, lo, hi))
        hi, lo, clean, seq = (a[order] for a in (hi, lo, clean, seq))
        first = np.ones(len(hi), bool)
        first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        return [a[first] for a in (hi, lo, clean, seq)]

    def add(self, hi: np.ndarray, lo: np.ndarray, clean: np.ndarray, seq: np.ndarray) -> list[np.ndarray] | None:
        """Look a batch up in the runs, the latest first; what is new or better becomes a run, which is returned."""
        hi, lo, clean, seq = self.best(hi, lo, clean, seq)
        open_, keep = np.ones(len(hi), bool), np.ones(len(hi), bool)
        for run in reversed(self.runs):
            at = self.find(run, hi, lo)
            known = open_ & (at >= 0)
            p, c, s = at[known], clean[known], seq[known]
            keep[known] = (c & ~run[2][p]) | ((c == run[2][p]) & (s > run[3][p]))
            open_ &= ~known
        if not keep.any():
            return None
        self.runs.append([a[keep].copy() for a in (hi, lo, clean, seq)])
        if len(self.runs) > self.max_runs:
            self.merge()
        return self.runs[-1]

    def merge(self) -> None:
        """All runs as one. A later entry is the better one, so the best of each identifier stands."""
        self.runs = [self.best(*(np.concatenate(x) for x in zip(*self.runs, strict=True)))]


def message_rows(df: DataFrame, keys: list[Column], error: Column, seq: Column, batch: Column) -> DataFrame:
    """Rows ``hi, lo, clean, seq, batch`` of the messages with a whole identifier."""
    key = F.concat_ws("\x1f", *keys)
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole = whole & k.isNotNull()
    return df.where(whole & seq.isNotNull()).select(
        F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("second"), F.reverse(key)).alias("lo"),
        (F.coalesce(F.regexp_replace(error, r"[\s\p{Z}\p{Cf}]+", ""), F.lit("")) == "").alias("clean"),
        seq.cast("long").alias("seq"), F.coalesce(batch, F.lit("")).alias("batch"),
    )


def _taken(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return p["hi"].to_numpy(np.int64), p["lo"].to_numpy(np.int64), p["clean"].to_numpy(bool), p["seq"].to_numpy(np.int64)


def _prefix(hi: str, bits: int) -> Column:
    return F.shiftrightunsigned(hi, 64 - bits) if bits else F.lit(0).cast("long")


def bits_for(rows: int) -> int:
    """Bits of the prefix with which a prefix's identifiers fit in one task: by the number of rows expected in all."""
    return max(3, (max(1, rows) // ROWS_PER_PREFIX).bit_length())


def ingest(rows: DataFrame, n_rows: int, max_runs: int = 8) -> DataFrame:
    """The index of a whole table (see ``message_rows``), its batches taken in one after the other."""
    bits = bits_for(n_rows)
    best = rows.groupBy("hi", "lo", "batch").agg(F.max(F.struct("clean", "seq")).alias("m"))
    news = best.select(_prefix("hi", bits).alias("prefix"), "hi", "lo", "m.clean", "m.seq", "batch")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(max_runs)
        for _, p in pdf.groupby("batch"):
            runs.add(*_taken(p))
        runs.merge()
        out = [(pdf["prefix"].iloc[0], i, *map(list, r)) for i, r in enumerate(runs.runs)]
        return pd.DataFrame(out, columns=["prefix", "run", "hi", "lo", "clean", "seq"])

    return news.groupBy("prefix").applyInPandas(one, INDEX)


class Index:
    """The runs of arrivals that come in one after the other, in a folder; ``expected`` rows in all fix the prefixes."""

    def __init__(self, spark: SparkSession, path: str, expected: int, max_runs: int = 8) -> None:
        self.spark, self.path, self.bits, self.max_runs = spark, path, bits_for(expected), max_runs
        #: Prefix to the batches whose folders hold its runs, in their order; at most 2 ** bits entries.
        self.manifest: dict[str, list[int]] = {}
        self.batch = -1

    @classmethod
    def opened(cls, spark: SparkSession, path: str, batch: int, expected: int, max_runs: int = 8) -> Index:
        """The index as it was after a batch."""
        out = cls(spark, path, expected, max_runs)
        out.manifest, out.batch = json.loads(spark.read.text(f"{path}/manifest/batch={batch}").first()[0]), batch
        return out

    def _read(self, prefixes: list[str]) -> DataFrame:
        """The runs of some prefixes with the batch they came with."""
        files = sorted({f"{self.path}/runs/batch={b}/prefix={p}" for p in prefixes for b in self.manifest.get(p, [])})
        if not files:
            return self.spark.createDataFrame([], f"{RUN}, batch int")
        return self.spark.read.option("basePath", f"{self.path}/runs").schema(f"{RUN}, batch int").parquet(*files)

    def add(self, rows: DataFrame) -> None:
        """Take in one batch (see ``message_rows``)."""
        best = rows.groupBy("hi", "lo").agg(F.max(F.struct("clean", "seq")).alias("m")).select(_prefix("hi", self.bits).alias("prefix"), "hi", "lo", "m.clean", "m.seq")
        best = written(best, "batch")
        touched = [str(r[0]) for r in best.select("prefix").distinct().collect()]  # at most 2 ** bits
        limit = self.max_runs

        def one(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            runs = Runs(limit)
            for r in old.sort_values("batch").itertuples():
                runs.runs.append([np.asarray(r.hi, np.int64), np.asarray(r.lo, np.int64), np.asarray(r.clean, bool), np.asarray(r.seq, np.int64)])
            had = len(runs.runs)
            run = runs.add(*_taken(new)) if len(new) else None
            out = [] if run is None else [(key[0], len(runs.runs) <= had, *map(list, run))]
            return pd.DataFrame(out, columns=["prefix", "whole", "hi", "lo", "clean", "seq"])

        self.batch += 1
        made = best.groupBy("prefix").cogroup(self._read(touched).groupBy("prefix")).applyInPandas(one, RUN)
        where = f"{self.path}/runs/batch={self.batch}"
        made.write.mode("overwrite").partitionBy("prefix").parquet(where)
        if touched:
            for r in self.spark.read.schema(RUN).parquet(where).select("prefix", "whole").collect():  # one row a touched prefix
                p = str(r.prefix)
                self.manifest[p] = [self.batch] if r.whole else [*self.manifest.get(p, []), self.batch]
        self.spark.createDataFrame([(json.dumps(self.manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/batch={self.batch}")

    def table(self) -> DataFrame:
        """The index as one merged run a prefix, in the form of ``ingest``."""

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            runs = Runs()
            runs.runs = [[np.asarray(r.hi, np.int64), np.asarray(r.lo, np.int64), np.asarray(r.clean, bool), np.asarray(r.seq, np.int64)] for r in pdf.itertuples()]
            runs.merge()
            return pd.DataFrame([(key[0], 0, *map(list, runs.runs[0]))], columns=["prefix", "run", "hi", "lo", "clean", "seq"])

        return self._read(list(self.manifest)).groupBy("prefix").applyInPandas(one, INDEX)


def survivors(index: DataFrame) -> DataFrame:
    return index.select(F.explode("seq").alias("seq"))


def index_of(df: DataFrame, keys: list[Column], error: Column, seq: Column, batch: Column) -> DataFrame:
    """Build the persisted index of a whole table and read it back from the shared folder."""
    rows = message_rows(df, keys, error, seq, batch)
    path = fresh_path(df.sparkSession, "message-index")
    ingest(rows, df.select(F.lit(1)).count()).write.parquet(path)
    return df.sparkSession.read.schema(INDEX).parquet(path)


def redundant(df: DataFrame, index: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """Rows of ``df`` that must go: identified, and not the survivor of their message."""
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole = whole & k.isNotNull()
    return df.where(whole & F.col(seq).isNotNull()).join(survivors(index).withColumnRenamed("seq", seq), seq, "left_anti")


def deduplicated(df: DataFrame, index: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """``df`` with exactly one row of each message; rows without a whole identifier stay."""
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole = whole & k.isNotNull()
    lone = df.where(~whole | F.col(seq).isNull())
    return df.join(survivors(index).withColumnRenamed("seq", seq), seq, "left_semi").select(df.columns).unionByName(lone)


def batches(files: Iterator[DataFrame], keys: list[Column], error: Column, seq: Column, batch: Column, path: str, expected: int) -> DataFrame | None:
    """Take in arrivals one after the other; ``expected`` rows in all. None if nothing arrived."""
    index = None
    for df in files:
        index = index or Index(df.sparkSession, path, expected)
        index.add(message_rows(df, keys, error, seq, batch))
    return None if index is None else index.table()
