"""Building cases: instructions, length ranges, afterthoughts and further conditions of existing cases."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import compose

#: Least and greatest length of an artifact by the kind of its source; others have no bounds.
LENGTHS = {"code": (80, 4000), "prose": (80, 6000), "technical": (120, 6000)}


def first_text(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def within_lengths(df: DataFrame, artifact: str, genre: str, lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Rows whose artifact has a fit length for its genre; a null artifact has none."""
    n, keep = F.length(artifact), F.lit(True)
    for k, (lo, hi) in (lengths or LENGTHS).items():
        keep = F.when(F.col(genre) == k, n.between(lo, hi)).otherwise(keep)
    return df.where(F.col(artifact).isNotNull() & keep)


def without_prefix(c: Column) -> Column:
    """An edit's source text without the instruction before its first colon, where it begins with a short verb phrase."""
    return F.regexp_replace(c, r"^(?:[A-Z][a-z]+(?: [a-z]+){0,8}):\s+", "")


def instruction(genre: Column, own: Column) -> Column:
    """The task of a case: its own instruction where there is one, else the usual one of its genre; it asks for the text alone."""
    own = F.nullif(F.trim(own), F.lit(""))
    kind = F.when(genre == "code", "code").when(genre == "technical", "post").otherwise("passage")
    told = F.concat(F.lit("Edit this "), kind, F.lit(" as follows: "), own, F.lit("\nGive back the edited "), kind, F.lit(" alone."))
    usual = F.concat(F.lit("Make this "), kind, F.lit(" clearer and more correct. Give back the edited "), kind, F.lit(" alone."))
    return F.when(own.isNotNull() & (genre != "technical"), told).otherwise(usual)


# -- pools of afterthoughts, from small lists by rule

_WHO = {"personal_context": ("my umbrella", "my bicycle key", "the spare charger", "my library card"), "workflow_note": ("the printer paper", "the meeting room", "the guest list", "the travel forms")}
_WHAT = {"personal_context": ("I left {} on the tram.", "I still can't find {}.", "Somebody borrowed {} again."), "workflow_note": ("Remember that {} must be ordered by Friday.", "Could someone check {} before noon?", "Nobody has looked after {} this week.")}
_NATIVE = {
    "code": ("the cache is never cleared", "the timeout is too short", "two tests still fail", "the flag has no default", "the log fills the disk", "the parser skips tabs", "the retry never stops", "the lock is held too long", "the port is fixed", "the path has a blank", "the field may be null"),
    "prose": ("the second visitor came later", "the garden closes at dusk", "the ferry was painted green", "the letter was never sent", "the old mill still turns", "the bells rang twice", "the map shows no bridge", "the road was under water", "the picture hung in the hall", "the lamp was left burning", "the winter was mild"),
    "technical": ("the adapter needs its own supply", "the sensor drifts when warm", "the driver wants a restart", "the cable must be shielded", "the fan runs all night", "the update takes an hour", "the battery loses charge", "the screen flickers as well", "the case gets very hot", "the switch sticks at times", "the valve opens too late"),
    "scientific": ("the second sample was smaller", "the control group was older", "the effect fades in a week", "the scale has five points", "the error bars overlap", "the dose was halved", "the survey had two waves", "the effect was not replicated", "the raters were not blind", "the sites differ in size", "the model omits season"),
}


def casual_pool() -> list[tuple[str, str, str]]:
    """24 entries ``role, text, witness``."""
    return [(role, text.format(who), " ".join(who.split()[-2:])) for role in _WHO for text in _WHAT[role] for who in _WHO[role]]


def native_pool() -> list[tuple[str, str, str]]:
    """44 entries ``genre, text, witness`` in the register of a genre's artifacts."""
    return [(genre, f"Note that {x}.", " ".join(x.split()[-2:])) for genre, xs in _NATIVE.items() for x in xs]


#: Items that one cycle serves; a source with more has several cycles side by side.
CYCLE = 20_000


def chosen(items: DataFrame, pool: list[tuple[str, str, str]], by: str, key: str, haystack: str, seed: int = 42) -> DataFrame:
    """``items`` with ``afterthought_role, afterthought, witness`` from the pool, each entry about equally often.

    The items of a group go through a shuffled cycle in the order of their key: an entry whose text or witness the
    haystack holds is passed over for that item, and the cycle goes on behind the entry taken. A large group is split by
    hash into cycles of their own, so no task grows with it. With ``by`` naming a column, entries of the group's own
    role are used where the pool has any. No free entry fails the query. Null keys and groups are values like others.
    """
    if not pool or len(pool) > 10_000:
        raise ValueError("the pool is a short list")
    sizes = items.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_g")
    rows = items.join(sizes, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / CYCLE).cast("long"))).drop("_n")
    schema = items.schema.add("afterthought_role", "string").add("afterthought", "string").add("witness", "string")

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [e for e in pool if e[0] == group[0]] or pool
        order = random.Random(f"{seed}:{group[0]}:{group[1]}").sample(own, len(own))
        pdf = pdf.drop(columns="_c").sort_values(key, kind="stable", na_position="first")
        taken, at = [], 0
        for text in pdf[haystack].fillna("").str.lower():
            free = next((i for i in range(len(order)) if not any(x.lower() in text for x in order[(at + i) % len(order)][1:])), None)
            if free is None:
                raise ValueError(f"no entry of the pool is free for an item of {group[0]}")
            taken.append(order[(at + free) % len(order)])
            at = (at + free + 1) % len(order)
        pdf["afterthought_role"], pdf["afterthought"], pdf["witness"] = zip(*taken, strict=True) if taken else ([], [], [])
        return pdf

    return rows.groupBy(by, "_c").applyInPandas(run, schema)


def with_condition(cases: DataFrame, afterthoughts: DataFrame, condition: str = "newline_R") -> DataFrame:
    """A new condition of existing clean cases: their columns are carried over, ``afterthoughts`` has ``cluster, afterthought``."""
    base = cases.where("condition = 'clean'").select(F.col("composition_event_id").alias("cluster"), F.lit(condition).alias("condition"), F.col("task_instruction").alias("task"), "artifact", "source", "genre", "license")
    return compose.composed(base.join(afterthoughts.select("cluster", "afterthought"), "cluster"))


def incomplete(cases: DataFrame, conditions: list[str], prefixed: tuple[str, ...] = ("clean", "newline", "blank")) -> DataFrame:
    """``cluster, problem``: clusters that lack a condition, have one twice, or whose messages differ before the afterthought."""
    head = F.when(F.col("condition").isin(*prefixed), F.substring(F.col("message"), F.lit(1), F.length(F.concat(F.coalesce("task_instruction", F.lit("")), F.lit("\n\n"), F.coalesce("artifact", F.lit(""))))))
    g = cases.groupBy(F.col("composition_event_id").alias("cluster")).agg(F.array_sort(F.collect_set("condition")).alias("have"), F.count("condition").alias("n"), F.count_distinct(head).alias("heads"))
    want = F.array(*[F.lit(c) for c in sorted(conditions)])
    rules = {"conditions": F.col("have") != want, "repeated": F.col("n") > F.size("have"), "prefix": F.col("heads") > 1}
    return g.select("cluster", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("problem"))


def pilot(family: DataFrame) -> DataFrame:
    """``family`` (``artifact, task_pre, task_post, resume``) with ``variant, message``: the request before, after, around, or before a fenced text."""
    c = lambda *parts: F.concat(*[F.col(p) if p in family.columns else F.lit(p) for p in parts])
    forms = {"pre": c("task_pre", "\n\n", "artifact"), "post": c("artifact", "\n\n", "task_post"), "sandwich": c("task_pre", "\n\n", "artifact", "\n\n", "resume"), "fenced": c("task_pre", "\n\n```\n", "artifact", "\n```")}
    return family.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), m.alias("message")) for k, m in forms.items()]))).select(*family.columns, "_f.variant", "_f.message")


def rejoined(candidates: DataFrame, conversations: DataFrame, key: str = "conversation_hash", order: str = "n") -> DataFrame:
    """Candidates (``key`` and their place ``order``) with their conversations, of several equal keys the least one; sort by ``order`` to read."""
    rest = [c for c in conversations.columns if c != key]
    one = conversations.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.to_json(F.struct(*rest)).alias("_s"), *[F.col(c) for c in rest]])).alias("_r"))
    return candidates.join(one, key).select(*candidates.columns, *[F.col("_r")[c].alias(c) for c in rest])


def placebo(outputs: DataFrame, identities: list[tuple[str, list[str]]], own: str, text: str) -> DataFrame:
    """``own, identity, fired``: each output against the witnesses of identities that aren't its own (a short list)."""
    from tracemill.functions.text import has_witness

    tokens = F.array(*[F.struct(F.lit(i).alias("identity"), F.array(*[F.lit(t) for t in ts]).alias("tokens")) for i, ts in identities])
    pairs = outputs.withColumn("_i", F.explode(tokens)).where(~F.col(own).eqNullSafe(F.col("_i.identity")))
    return pairs.select(own, F.col("_i.identity").alias("identity"), has_witness(F.col(text), F.col("_i.tokens")).alias("fired"))


def token_windows(df: DataFrame, text: str, encode: object, decode: object, most: int) -> DataFrame:
    """``df`` with ``window``: head and tail of texts of more than ``most`` tokens (three fifths and two), by a tokenizer's two functions."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out = []
            for t in s:
                ids = encode(t) if t is not None else []
                head = int(most * 0.6)
                out.append(t if len(ids) <= most else f"{decode(ids[:head])}\n\n...[ARTIFACT BODY TRUNCATED]...\n\n{decode(ids[head - most :])}")
            yield pd.Series(out, dtype=object)

    return df.withColumn("window", F.pandas_udf(run, "string")(F.col(text)))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its place in ``order`` as ``n`` (a report; one window)."""
    return df.withColumn("n", F.row_number().over(W.orderBy(*order)))
