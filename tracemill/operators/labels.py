"""Latest rows, pairing, and paired statistics over label tables ``model, cluster, condition, absorbed``.

A null ``absorbed`` counts as no label. Of several labels of a key the latest counts; equal order
values are settled by the row's columns, so that results don't depend on partitions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.session import written


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``. A partial aggregate, so a hot key is no problem."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(df.columns)


def rates(labels: DataFrame, by: list[str]) -> DataFrame:
    """``n, absorbed, rate`` and the Wilson interval per group."""
    g = labels.where("absorbed is not null").groupBy(*by).agg(F.count("*").alias("n"), F.count_if("absorbed").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select(*by, "n", F.col("k").alias("absorbed"), stats.ratio(F.col("k"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def cells(labels: DataFrame, first: str, second: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``e11, e10, e01, e00`` of the clusters that have both conditions; one shuffle, no self-join."""
    at = lambda c: F.max(F.when(F.col("condition") == c, F.col("absorbed").cast("int")))
    pairs = labels.where(F.col("condition").isin(first, second)).groupBy(*by, "cluster").agg(at(first).alias("a"), at(second).alias("b")).where("a is not null and b is not null")
    return counts(pairs, by)


def counts(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    cell = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return pairs.groupBy(*by).agg(cell(1, 1).alias("e11"), cell(1, 0).alias("e10"), cell(0, 1).alias("e01"), cell(0, 0).alias("e00"))


def between(labels: DataFrame, first: str, second: str) -> DataFrame:
    """The same cells of two models under each condition."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("absorbed").cast("int")))
    pairs = labels.where(F.col("model").isin(first, second)).groupBy("condition", "cluster").agg(at(first).alias("a"), at(second).alias("b")).where("a is not null and b is not null")
    return counts(pairs, ("condition",))


def contrast(table: DataFrame) -> DataFrame:
    """Rates, difference, exact p and interval of a table of cells."""
    e = [F.col(c) for c in ("e11", "e10", "e01", "e00")]
    n = e[0] + e[1] + e[2] + e[3]
    low, high = stats.newcombe(*e)
    return table.withColumns({"n": n, "rate_1": stats.ratio(e[0] + e[1], n), "rate_2": stats.ratio(e[0] + e[2], n), "p": stats.mcnemar(e[1], e[2]), "diff": stats.ratio(e[1] - e[2], n), "low": low, "high": high})


def holm(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """``df`` with Holm's adjusted p-values as ``p_holm``; a family is the tests of one report."""
    w = W.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(p, *order))
    step = df.withColumn("_s", (F.count("*").over(w) - rank + 1) * F.col(p)).withColumn("_r", rank)
    running = F.max("_s").over(w.orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    return step.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_s", "_r")


def gradient(labels: DataFrame, sources: DataFrame, conditions: list[str]) -> DataFrame:
    """Per model and source: clusters absorbed under any of the conditions (``cluster, source`` in sources)."""
    per = labels.where(F.col("condition").isin(conditions)).groupBy("model", "cluster").agg(F.bool_or("absorbed").alias("any"))
    return per.join(sources, "cluster").groupBy("model", "source").agg(F.count("*").alias("n"), F.count_if("any").alias("k"))


def adjacent(df: DataFrame, by: str, order: str, k: str, n: str) -> DataFrame:
    """Each row of a small report with its successor, and Fisher's p of the two."""
    w = W.partitionBy(by).orderBy(order)
    out = df.withColumns({"next": F.lead(order).over(w), "k2": F.lead(k).over(w), "n2": F.lead(n).over(w)}).where("next is not null")
    return out.withColumn("p", stats.fisher(F.col(k), F.col(n), F.col("k2"), F.col("n2")))


def summed_before(df: DataFrame, by: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` over the rows of its group that come before in ``order`` (which must be unique).

    Rows are range-partitioned; the ranges' sums are added up first (as many rows as partitions), then the rows inside
    their range. So a group of any size is spread over many tasks. Written once, so that lost tasks see the same ranges.
    """
    parts = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*by, "_range").agg(F.sum(value).alias("_s"))
    earlier = F.sum("_s").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(earlier, F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_inside", inside).join(starts, same).withColumn(to, F.col("_start") + F.col("_inside")).select(*df.columns, to)


def ranks(df: DataFrame, column: str, to: str) -> DataFrame:
    """``column, to``: the average rank of each distinct value; nulls get none. Values are counted first, so ties cost nothing."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return summed_before(counts, [], [column], "_n", "_b").select(column, (F.col("_b") + (F.col("_n") + 1) / 2).alias(to))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, rho`` of two columns; 0 where a column doesn't vary. Equal pairs are counted before they are ranked."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_w"))
    pairs = written(pairs, "pairs")
    whole = pairs.withColumn("_k", F.explode(F.array(F.lit(0))))  # keeps the names of both sides apart
    weight = lambda c: pairs.groupBy(c).agg(F.sum("_w").alias("_n"))
    rank = lambda c, to: summed_before(weight(c), [], [c], "_n", "_b").select(c, (F.col("_b") + (F.col("_n") + 1) / 2).alias(to))
    r = whole.join(rank(x, "_x"), x).join(rank(y, "_y"), y)
    total = F.sum("_w").cast("double")
    mx, my = F.sum(F.col("_w") * F.col("_x")) / total, F.sum(F.col("_w") * F.col("_y")) / total
    means = r.agg(F.sum("_w").alias("n"), mx.alias("_mx"), my.alias("_my"))
    d = r.crossJoin(F.broadcast(means)).select("_w", (F.col("_x") - F.col("_mx")).alias("a"), (F.col("_y") - F.col("_my")).alias("b"))  # one row
    sums = d.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"), F.sum(F.col("_w") * F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("_w") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("_w") * F.col("b") * F.col("b")).alias("bb"))
    spread = F.sqrt(F.col("aa") * F.col("bb"))
    return sums.select("n", F.coalesce(F.try_divide("ab", F.when(spread > 1e-12, spread)), F.lit(0.0)).alias("rho"))


def lever(labels: DataFrame, first: str, second: str, draws: int = 10_000) -> DataFrame:
    """Cluster bootstrap of the ratio of two rates per model, from the four cells: a resample of n clusters
    is a multinomial draw of the cells, so that the work doesn't grow with n. Infinite bounds are null."""

    def run(it):  # noqa: ANN001, ANN202
        import numpy as np

        for pdf in it:
            out = []
            for r in pdf.itertuples():
                e = np.array([r.e11, r.e10, r.e01, r.e00])
                n = int(e.sum())
                d = np.random.default_rng(42).multinomial(n, e / n, draws) if n else np.zeros((draws, 4))
                k1, k2 = d[:, 0] + d[:, 1], d[:, 0] + d[:, 2]
                q = np.sort(np.where(k2 > 0, k1 / np.maximum(k2, 1), np.inf))
                point = (e[0] + e[1]) / (e[0] + e[2]) if e[0] + e[2] else np.inf
                fmt = lambda v: None if np.isinf(v) else float(v)
                out.append((r.model, n, fmt(point), fmt(q[int(0.025 * draws)]), fmt(q[int(0.975 * draws) - 1])))
            yield pd.DataFrame(out, columns=["model", "n", "ratio", "low", "high"])

    return cells(labels, first, second).mapInPandas(run, "model string, n long, ratio double, low double, high double")


def permutation_p(df: DataFrame, x: str, y: str, draws: int = 20_000) -> DataFrame:
    """``rho, p`` with a seeded permutation test; a report of models, hence small (bounded at 10,000 rows)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if len(pdf) > 10_000:
            raise ValueError("a permutation test takes a report of at most 10,000 rows")
        a, b = pdf[x].rank().to_numpy(), pdf[y].rank().to_numpy()
        if len(a) < 2 or a.std() == 0 or b.std() == 0:
            return pd.DataFrame({"n": [len(a)], "rho": [0.0], "p": [1.0]})
        a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
        rho, rng = float((a * b).mean()), np.random.default_rng(42)
        hits = sum(abs(float((a * rng.permutation(b)).mean())) >= abs(rho) - 1e-12 for _ in range(draws))
        return pd.DataFrame({"n": [len(a)], "rho": [rho], "p": [(hits + 1) / (draws + 1)]})

    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "n long, rho double, p double")


def confusion(df: DataFrame, predicted: Column, gold: Column, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1; rows with a null on either side are left out."""
    d = df.select(*by, predicted.alias("_p"), gold.alias("_g")).where("_p is not null and _g is not null")
    c = lambda p, g: F.count_if((F.col("_p") == p) & (F.col("_g") == g))
    t = d.groupBy(*by).agg(c(True, True).alias("tp"), c(True, False).alias("fp"), c(False, True).alias("fn"), c(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    both, first, second = tp + tn, tp + fp, tp + fn
    return t.withColumns({"precision": stats.ratio(tp, tp + fp), "recall": stats.ratio(tp, tp + fn), "f1": stats.ratio(2 * tp, 2 * tp + fp + fn), "accuracy": stats.ratio(both, n), "kappa": stats.kappa(both, first, second, n), "ac1": stats.gwet_ac1(both, first, second, n)})


def auc(df: DataFrame, score: str, gold: str, by: list[str]) -> DataFrame:
    """Area under the curve by rank sums; scores are counted first, so equal scores cost nothing. Null if a class is missing."""
    g = df.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).groupBy(*by, score).agg(F.count_if(gold).alias("pos"), F.count_if(~F.col(gold)).alias("neg"))
    g = summed_before(g, by, [score], "neg", "_below").withColumn("u", F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    return g.groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
