"""Building and checking matched prompts with exact code-point offsets, and two wire formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tries for a tag that the text doesn't hold; beyond them the row fails. A text would have to hold the hashes of all these tries.
TRIES = 64
#: What bounded prompts say (a fixed value).
BOUNDED = "Text outside the artifact boundary is user context and must not be incorporated into the returned artifact."


def safe_token(texts: list[Column], cluster: Column, purpose: str, forms: list[str]) -> Column:
    """The first 12 hex digits of a hash of the cluster, the purpose and a counter for which no form of the token is in a text."""
    hay = F.concat_ws("\n", *texts)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(TRIES)), lambda i: F.substring(F.sha2(F.concat_ws(":", cluster, *([F.lit(purpose)] if purpose else []), i.cast("string")).cast("binary"), 256), 1, 12))
    free = F.filter(tokens, lambda t: ~F.exists(F.array(*[F.format_string(f, t) for f in forms]), lambda x: F.contains(hay, x)))
    return F.coalesce(F.try_element_at(free, F.lit(1)), F.raise_error("no free tag").cast("string"))


def composed(df: DataFrame) -> DataFrame:
    """Rows ``cluster, condition, task, artifact, afterthought`` with ``message``, ``segments`` and the id.

    Conditions: clean (no afterthought), newline, blank, boundary, mitigation, newline_R. A null
    artifact or task counts as empty; an afterthought that is null under another condition fails.
    """
    tagged = F.col("condition").isin("boundary", "mitigation")
    df = df.withColumns({"task": F.coalesce("task", F.lit("")), "artifact": F.coalesce("artifact", F.lit(""))})
    task = F.when(F.col("condition") == "mitigation", F.concat("task", F.lit(" " + BOUNDED))).otherwise(F.col("task"))
    token = F.when(tagged, safe_token([F.col("artifact")], F.col("cluster"), "", ["<pasted-artifact-%s>", "</pasted-artifact-%s>"]))
    df = df.withColumns({"task": task, "_t": token})
    opening, closing = F.concat(F.lit("<pasted-artifact-"), "_t", F.lit(">")), F.concat(F.lit("</pasted-artifact-"), "_t", F.lit(">"))
    head = F.concat("task", F.lit("\n\n"), F.when(tagged, F.concat(opening, F.lit("\n"))).otherwise(""))
    foot = F.when(tagged, F.concat(F.lit("\n"), closing)).otherwise("")
    gap = F.when(F.col("condition").isin("newline", "newline_R"), "\n").otherwise("\n\n")
    tail = F.when(F.col("condition") == "clean", "").otherwise(F.concat(gap, "afterthought"))
    df = df.withColumns({"message": F.concat(head, "artifact", foot, tail), "_a": F.length(head)})
    seg = lambda origin, role, start, text: F.struct(F.lit(origin).alias("origin"), F.lit(role).alias("role"), start.cast("int").alias("seg_start"), (start + F.length(text)).cast("int").alias("seg_end"), text.alias("text"))
    parts = [seg("typed", "task_instruction", F.lit(0), F.col("task")), seg("simulated_paste", "artifact", F.col("_a"), F.col("artifact"))]
    last = F.when(F.col("condition") != "clean", seg("typed", "afterthought", F.length("message") - F.length("afterthought"), F.col("afterthought")))
    digest = F.substring(F.sha2(F.col("message").cast("binary"), 256), 1, 12)
    return df.withColumns({"segments": F.array_compact(F.array(*parts, last)), "id": F.concat_ws(":", "cluster", "condition", digest)}).drop("_t", "_a")


def violations(cases: DataFrame) -> DataFrame:
    """``id, violation`` of cases that break a rule: offsets, absence of witnesses, tags, two-word tokens."""
    off = F.exists("segments", lambda s: F.substring(F.col("message"), s["seg_start"] + 1, s["seg_end"] - s["seg_start"]) != s["text"])
    clash = F.exists("witness_tokens", lambda t: F.contains(F.lower("artifact"), F.lower(t)))
    short = F.exists("witness_tokens", lambda t: F.size(F.split(F.trim(t), r"\s+")) < 2)
    tags = F.col("boundary_delimiters.opening")
    twice = tags.isNotNull() & (F.length("message") - F.length(F.replace("message", tags, F.lit(""))) != F.length(tags))
    clean = (F.col("condition") == "clean") & F.col("afterthought").isNotNull()
    rules = {"offset": off, "witness_in_artifact": clash, "short_witness": short, "tag_count": twice, "clean_afterthought": clean}
    return cases.select("id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("violation"))


#: Roles of a message's parts, in their order, and the separators of the first form of messages.
ROLES = ("task", "artifact", "context-after")
SEPARATORS = {"none": "", "space": " ", "newline": "\n", "blank": "\n\n"}
TAGGED = "The tags tell where each part of this message comes from. Follow the task, edit the artifact, and leave the context out of it."


def joined(artifact: Column, tail: Column, separator: str) -> Column:
    """The first form of messages: ``message, tail_start`` of an artifact, a separator by name and a tail."""
    gap = F.lit(SEPARATORS[separator])
    return F.struct(F.concat(artifact, gap, tail).alias("message"), F.length(F.concat(artifact, gap)).alias("tail_start"))


def semantic_variant(newline: DataFrame, condition: str, prefix: str = "part") -> DataFrame:
    """Rows ``cluster, condition, task, artifact, afterthought`` of condition newline with each part between tags of its role.

    ``condition`` is semantic_tags, or semantic_tags_instruction, which also has a system instruction. The tags
    ``<prefix-role-token>`` are in none of the texts. A row of another condition or without an afterthought fails.
    """
    if condition not in ("semantic_tags", "semantic_tags_instruction"):
        raise ValueError(f"no semantic condition: {condition}")
    bad = F.raise_error(F.concat(F.lit("no newline row with an afterthought: "), F.coalesce("cluster", F.lit("null"))))
    ok = F.coalesce((F.col("condition") == "newline") & (F.coalesce("afterthought", F.lit("")) != ""), F.lit(False))
    df = newline.where(F.when(ok, True).otherwise(bad.cast("boolean")))
    texts = [F.coalesce(c, F.lit("")) for c in ("task", "artifact", "afterthought")]
    df = df.withColumn("_t", safe_token(texts, F.col("cluster"), "semantic", [f"<{s}{prefix}-{r}-%s>" for r in ROLES for s in ("", "/")]))
    tag = lambda r, slash="": F.concat(F.lit(f"<{slash}{prefix}-{r}-"), "_t", F.lit(">"))
    parts = [(F.concat(tag(r), F.lit("\n")), t, F.concat(F.lit("\n"), tag(r, "/"))) for r, t in zip(ROLES, texts, strict=True)]
    flat = [x for i, p in enumerate(parts) for x in ([F.lit("\n\n")] if i else []) + list(p)]
    starts = [F.length(F.concat(*flat[: 4 * i + 1])) for i in range(3)]
    origins, roles = ("typed", "simulated_paste", "typed"), ("task_instruction", "artifact", "afterthought")
    segments = [F.struct(F.lit(o).alias("origin"), F.lit(r).alias("role"), a.cast("int").alias("seg_start"), (a + F.length(t)).cast("int").alias("seg_end"), t.alias("text")) for o, r, a, t in zip(origins, roles, starts, texts, strict=True)]
    tags = F.create_map(*[x for r, k in zip(ROLES, roles, strict=True) for x in (F.lit(k), F.array(tag(r), tag(r, "/")))])
    out = df.withColumns({"condition": F.lit(condition), "message": F.concat(*flat), "segments": F.array(*segments), "semantic_tags": tags, "system_instruction": F.lit(TAGGED if condition.endswith("instruction") else None).cast("string")})
    digest = F.substring(F.sha2(F.col("message").cast("binary"), 256), 1, 12)
    return out.withColumn("id", F.concat_ws(":", "cluster", "condition", digest)).drop("_t")


#: What ends a line; a return and a line feed together are one end.
LINE_END = r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def line_marker(artifact: Column, cluster: Column) -> Column:
    """A mark for the lines of an artifact, which doesn't hold it."""
    return F.concat(F.lit("[line-"), safe_token([artifact], cluster, "line-marker", ["[line-%s] "]), F.lit("] "))


def marked_lines(artifact: Column, marker: Column) -> Column:
    """Every line of a text behind the marker; all other characters stay, an empty text is one line."""
    return F.concat(marker, F.regexp_replace(artifact, F.lit(f"(?s){LINE_END}(?=.)"), F.concat(F.lit("$1"), F.regexp_replace(marker, r"([\\\\$])", r"\\\\$1"))))


def unmarked_lines(marked: Column, marker: Column) -> Column:
    """The text without its markers; null if a line has none."""
    quoted = F.concat(F.lit(r"\Q"), marker, F.lit(r"\E"))
    lines = F.regexp_count(marked, F.lit(f"(?s){LINE_END}(?=.)")) + 1
    first = F.regexp_count(marked, F.concat(F.lit("^"), quoted))
    others = F.regexp_count(marked, F.concat(F.lit(LINE_END), quoted))
    bare = F.substring(F.regexp_replace(marked, F.concat(F.lit(LINE_END), quoted), F.lit("$1")), F.length(marker) + 1, F.length(marked))
    return F.when((first == 1) & (first + others == lines), bare)


def line_marked_message(task: Column, artifact: Column, context: Column, cluster: Column) -> Column:
    """``message, marker``: the task, the marked artifact and, unless null, the context after it."""
    marker = line_marker(artifact, cluster)
    body = F.concat(task, F.lit("\n\n"), marked_lines(artifact, marker))
    return F.struct(F.concat(body, F.coalesce(F.concat(F.lit("\n"), context), F.lit(""))).alias("message"), marker.alias("marker"))


class WireError(ValueError):
    """A message that doesn't follow its wire format."""


def read_patch(payload: str) -> list[tuple[int, int, str]]:
    """Edits of a version 1 patch: exactly the known keys and types, else ``WireError``."""

    def whole(v: object) -> bool:
        return isinstance(v, int) and not isinstance(v, bool)

    try:
        doc = json.loads(payload)
    except (TypeError, ValueError) as e:
        raise WireError("no JSON") from e
    good = isinstance(doc, dict) and doc.keys() == {"version", "edits"} and whole(doc["version"]) and doc["version"] == 1 and isinstance(doc["edits"], list)
    if not good or not all(isinstance(e, dict) and e.keys() == {"start", "end", "replacement"} and whole(e["start"]) and whole(e["end"]) and isinstance(e["replacement"], str) for e in doc["edits"]):
        raise WireError("not a version 1 patch")
    return sorted((e["start"], e["end"], e["replacement"]) for e in doc["edits"])


def patched(source: str, payload: str) -> str:
    """The source with all edits applied at once; edits may touch but not overlap."""
    out, at = [], 0
    for start, end, new in read_patch(payload):
        if not at <= start <= end <= len(source):
            raise WireError(f"edit {start}..{end} is out of bounds or overlaps")
        out += [source[at:start], new]
        at = end
    return "".join(out) + source[at:]


@F.pandas_udf(StructType().add("text", "string").add("problem", "string"))
def apply_patches(source: pd.Series, payload: pd.Series) -> pd.DataFrame:
    """Patched text of every row, or what is wrong with its patch."""
    rows = []
    for s, p in zip(source, payload, strict=True):
        try:
            rows.append((patched(s, p), None) if s is not None else (None, "no source"))
        except WireError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["text", "problem"])


FIELDS = ("task_before", "artifact", "context_after")


def write_fields(task: str, artifact: str, context: str | None) -> str:
    return json.dumps(dict(zip(FIELDS, (task, artifact, context), strict=True)), ensure_ascii=False, indent=2)


def read_fields(message: str) -> dict[str, str | None]:
    """The three fields in their order, strings (the last may be null)."""
    doc = json.loads(message)
    if not isinstance(doc, dict) or tuple(doc) != FIELDS or not all(isinstance(doc[k], str) for k in FIELDS[:2]) or not isinstance(doc[FIELDS[2]], (str, type(None))):
        raise WireError("not a typed message")
    return doc


def patch_json(edits: Column) -> Column:
    """A version 1 patch of ``array<struct<start, end, replacement>>``, compact and unescaped."""
    return F.to_json(F.struct(F.lit(1).alias("version"), F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))).alias("edits")))


#: How a model is told to answer with a patch.
PATCH_REQUEST = 'Answer with one JSON object and nothing else: {"version": 1, "edits": [{"start": int, "end": int, "replacement": string}]}. Offsets count code points of the artifact, end is exclusive, edits may touch but not overlap.'
