"""Output health: an expected grid, flags per answer, counts per model and condition, paired counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.functions import text as T
from tracemill.functions.spelling import squeezed

FLAGS = ("missing", "error", "empty_response", "length_truncated", "nonstop_finish", "refusal_like", "empty_artifact_span", "severely_short_vs_clean", "python_syntax_error")


def grid(log: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case of the clusters and conditions a model was run on, with its row if there is one."""
    c = cases.where("id is not null").select(squeezed(F.col("id")).alias("case_key"), F.col("composition_event_id").alias("cluster"), "source", "genre", "condition").dropDuplicates(["case_key"])
    run = log.join(c, "case_key")
    seen = run.select("model_key", "cluster").distinct()
    conditions = run.select("model_key", "condition").distinct()
    expected = c.join(seen, "cluster").join(conditions, ["model_key", "condition"], "left_semi")
    return expected.join(log.withColumn("row_present", F.lit(True)), ["model_key", "case_key"], "left").na.fill({"row_present": False})


def flagged(expected: DataFrame) -> DataFrame:
    """Rows of a grid with lengths of answer and span (``chars``, ``response_words``, ``artifact_chars``, ``words``) and ``flags``; a missing
    row has that flag alone. ``parses_without_tags`` tells of code that isn't Python whether it is without lines of boundary tags."""
    size = lambda c: F.coalesce(c, F.lit(0))
    g = expected.withColumn("span", T.artifact_span("response", "genre")).withColumns({
        "words": size(T.word_count(F.col("span"))), "chars": size(F.length("response")), "response_words": size(T.word_count(F.col("response"))), "artifact_chars": size(F.length("span"))})
    g = g.withColumn("_bad", F.when((F.col("genre") == "code") & (F.coalesce("span", F.lit("")) != ""), T.python_problem("span")))
    clean = g.where("condition = 'clean' and row_present").groupBy("model_key", "cluster").agg(F.max("words").alias("clean_words"))
    g = g.join(clean, ["model_key", "cluster"], "left")
    text = F.coalesce("response", F.lit(""))
    rules = {
        "error": F.coalesce("error", F.lit("")) != "", "empty_response": F.col("chars") == 0, "length_truncated": F.col("finish_reason") == "length",
        "nonstop_finish": F.col("finish_reason").isNotNull() & (F.col("finish_reason") != "stop"), "refusal_like": T.refuses(F.col("response")),
        "empty_artifact_span": (text != "") & (F.coalesce("span", F.lit("")) == ""),
        "severely_short_vs_clean": (F.col("condition") != "clean") & (F.col("clean_words") >= 80) & (F.col("words") < 12) & (F.col("words") < 0.15 * F.col("clean_words")),
        "python_syntax_error": F.col("_bad").isNotNull(),
    }
    flags = F.when(~F.col("row_present"), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))
    retried = F.when(F.col("_bad").isNotNull(), T.python_problem(T.without_tag_lines(F.col("span"))).isNull())
    g = g.withColumns({"flags": flags, "parses_without_tags": retried})
    return g.select("model_key", "case_key", "cluster", "source", "genre", "condition", "row_present", "error", "finish_reason", "chars", "response_words", "artifact_chars", "words", "span", "parses_without_tags", "flags")


def summary(rows: DataFrame) -> DataFrame:
    """Rows and counts of each flag per model and condition."""
    return rows.groupBy("model_key", "condition").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS])


def paired(rows: DataFrame, flag: str, treated: str) -> DataFrame:
    """Clusters with the flag in both, only clean, only treated, none, and the exact p."""
    at = lambda c: F.max(F.when(F.col("condition") == c, F.array_contains("flags", flag).cast("int")))
    pairs = rows.groupBy("model_key", "cluster").agg(at("clean").alias("a"), at(treated).alias("b")).where("a is not null and b is not null")
    cell = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    out = pairs.groupBy("model_key").agg(cell(1, 1).alias("both"), cell(1, 0).alias("clean_only"), cell(0, 1).alias("treated_only"), cell(0, 0).alias("neither"))
    return out.withColumn("p", stats.mcnemar(F.col("clean_only"), F.col("treated_only")))


def plain_flags(expected: DataFrame) -> DataFrame:
    """The flags that don't depend on the artifact's span."""
    keep = ("missing", "error", "empty_response", "length_truncated", "nonstop_finish", "refusal_like")
    text = F.coalesce("response", F.lit(""))
    rules = {"error": F.coalesce("error", F.lit("")) != "", "empty_response": text == "", "length_truncated": F.col("finish_reason") == "length", "nonstop_finish": F.col("finish_reason").isNotNull() & (F.col("finish_reason") != "stop"), "refusal_like": T.refuses(F.col("response"))}
    flags = F.when(~F.col("row_present"), F.array(F.lit(keep[0]))).otherwise(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))
    return expected.select("model_key", "case_key", "cluster", "condition", flags.alias("flags"))


def syntax_rates(rows: DataFrame) -> DataFrame:
    """Per condition: code answers, those that are no Python, and their share."""
    code = rows.where("genre = 'code' and row_present").groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.array_contains("flags", "python_syntax_error")).alias("invalid"))
    return code.withColumn("share", stats.ratio(F.col("invalid"), F.col("n")))
