"""Schemas that drift between the files of a run.

Each line is parsed once, inside the JVM. Lines have few different schemas, so a file's header is read
from those: the schemas of all lines of all files are counted in parallel, taken apart to fields (nested
ones joined by dots, at any depth), and folded through the promotion lattice

    null  <  boolean, number, string, array, object  <  mixed

(whole and other numbers are one type). Headers of consecutive files are compared; a field that goes
and one that comes are the same field under a new name where both have the same type and the corpus
knows both names for the same content: the profiles of their values (signs, magnitudes, words,
shapes), taken over all files, agree. The best pair is taken first, then the best of what is left.

The headers of all files, folded once more, are the union schema: ``unified`` casts every line to it.

Edge cases: blank lines, unreadable lines, lines that are no object and objects with something after
them add nothing to a header and no row to the table. A line loaded twice counts once in headers and
table. A file whose predecessor is missing has no changes. A field with nothing but nulls has no type
and is never retyped; it may still be renamed. An empty object is a field of type ``object``; a field that
is an object in one line and something else in another has its own path and those inside. Null
``run_id`` or ``file_no`` rows are left out of the report (they have no predecessor) but not of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import alone, one_object
from tracemill.session import written

#: Least cosine of two names' value profiles.
SAME_CONTENT = 0.85
#: Names of fields that may be handled on the driver (a schema's, not the data's size; more are refused).
NAMES = 10_000

#: The shape of results, and the words by which a field is known at first.
TARGET = {"model": "string", "case_id": "string", "response": "string", "finish_reason": "string", "error": "string", "temperature": "double"}
SQL_TYPE = {"boolean": "boolean", "number": "double", "string": "string"}


def parsed(raw: DataFrame) -> DataFrame:
    """The rows whose line is one JSON object, with the object as ``v``."""
    return raw.withColumn("v", one_object(F.col("line"))).where("v is not null")


def readable(raw: DataFrame) -> DataFrame:
    """One copy of each readable line."""
    return parsed(raw.groupBy("run_id", "file_no", "line_no", "line").agg(F.min("file_name").alias("file_name"), F.min("written_at").alias("written_at")))


def fields(schema: str) -> list[tuple[str, str | None]]:
    """Paths and kinds of the fields of an object's schema as Spark writes it: ``OBJECT<a: BIGINT, b: OBJECT<`c d`: STRING>>``."""
    out: list[tuple[str, str | None]] = []
    at = 0

    def skip(what: str) -> bool:
        nonlocal at
        if schema.startswith(what, at):
            at += len(what)
            return True
        return False

    def name() -> str:
        nonlocal at
        if skip("`"):
            parts = []
            while True:
                end = schema.index("`", at)
                parts.append(schema[at:end])
                at = end + 1
                if not skip("`"):  # two of them stand for one
                    return "`".join(parts)
        end = schema.index(": ", at)
        at, start = end, at
        return schema[start:end]

    def value(path: str) -> None:
        nonlocal at
        if skip("OBJECT<"):
            if skip(">"):
                if path:
                    out.append((path, "object"))
                return
            while True:
                inner = name()
                skip(": ")
                value(f"{path}.{inner}" if path else inner)
                if not skip(", "):
                    break
            skip(">")
        elif skip("ARRAY<"):
            kept = len(out)
            value("")
            del out[kept:]
            skip(">")
            out.append((path, "array"))
        else:
            end = at
            while end < len(schema) and schema[end] not in ",>":
                end = schema.index(")", end) if schema[end] == "(" else end + 1
            kind, at = schema[at:end], end
            out.append((path, {"VOID": None, "STRING": "string", "BOOLEAN": "boolean"}.get(kind, "number")))

    value("")
    return out


def headers(raw: DataFrame) -> DataFrame:
    """The files' headers ``run_id, file_no, path, kind``."""
    lines = raw.where("run_id is not null and file_no is not null").select("run_id", "file_no", "line", F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))).alias("v"))
    # a filter on the parsed line would have it parsed once more, so unreadable lines go only after the few schemas are counted
    lines = lines.select("run_id", "file_no", F.schema_of_variant("v").alias("schema"), alone(F.col("line"), F.col("v")).alias("alone"))
    seen = lines.groupBy("run_id", "file_no", "schema", "alone").count().where("alone and schema like 'ARRAY<OBJECT<%'")
    seen = written(seen.select("run_id", "file_no", F.expr("substring(schema, 7, length(schema) - 7)").alias("schema")), "schemas")

    def opened(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(s, p, k) for s in pdf["schema"] for p, k in fields(s)], columns=["schema", "path", "kind"])

    cells = seen.join(seen.select("schema").distinct().mapInPandas(opened, "schema string, path string, kind string"), "schema")
    return written(cells.groupBy("run_id", "file_no", "path").agg(folded(F.col("kind")).alias("kind")), "headers")


def folded(kind: Column) -> Column:
    """The least kind of the lattice that is above all (null for none)."""
    kinds = F.collect_set(kind)  # at most the kinds there are
    return F.when(F.size(kinds) == 1, F.array_min(kinds)).when(F.size(kinds) > 1, "mixed")


def profiles(raw: DataFrame, head: DataFrame) -> DataFrame:
    """``path, profile``: the unit vector of what a name's values look like over all files.

    Only names of the headers count. A line with something after its object still tells what its values look like.
    """
    depth = head.agg(F.max(F.size(F.split("path", r"\."))).alias("d")).first().d or 0
    level = raw.where("run_id is not null and file_no is not null").select(F.lit("").alias("path"), F.col("line").alias("text"))
    cells = None
    for d in range(depth):
        # one level of nesting after the other, as deep as the headers go; a value's text is all that is needed
        inner = F.explode_outer(F.from_json("text", "map<string,string>"))
        opened = level.select(F.col("path").alias("_up"), inner).where("key is not null").select(F.concat("_up", "key").alias("path"), F.col("value").alias("text"))
        cells = opened if cells is None else cells.unionByName(opened)
        level = opened.where("text like '{%'").select(F.concat("path", F.lit(".")).alias("path"), "text")
    if cells is None:
        return written(head.select("path", F.create_map(F.lit(""), F.lit(0.0)).alias("profile")).limit(0), "profiles")
    names = head.select("path").distinct()
    # filtered after counting: a filter before would have all signs read twice
    counts = cells.select("path", signs(F.col("text")).alias("sign")).groupBy("path", "sign").count().where("sign is not null").join(names, "path", "left_semi")
    profile = counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("sign", "count"))).alias("p"))  # some hundreds of signs
    unit = F.sqrt(F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, x: a + x * x))
    return written(profile.select("path", F.transform_values("p", lambda _, x: x / unit).alias("profile")), "profiles")


def signs(text: Column) -> Column:
    """What a value looks like, as one of some hundreds of words however many values there are.

    Texts of up to 40 signs may be a number (with a unit) or a word; all others are told by how many words and marks they have.
    """
    bare = F.regexp_replace(F.lower(F.trim(text)), r"(?<=\d)\s*[a-z]{1,3}$", "")
    # most texts aren't numbers, and failing to read one is dear
    num = F.when(bare.rlike(r"^[-+.]?\d"), bare.try_cast("double"))
    small = F.concat(F.lit("n="), F.round(num, 2).cast("string"))
    size = F.concat(F.lit("e"), F.floor(F.log2(F.abs(num) + 1)).cast("string"))
    word = F.when((F.length(bare) <= 16) & ~bare.rlike(r"\s"), F.concat(F.lit("w"), F.pmod(F.xxhash64(bare), F.lit(97)).cast("string")))
    marks = F.length(text) - F.length(F.regexp_replace(text, "[:/@]+", ""))
    shape = F.concat(F.lit("s"), F.least(F.lit(6), F.size(F.split(text, r"\s+", 7))).cast("string"), F.lit(":"), F.least(F.lit(4), marks).cast("string"))
    whole = F.when(F.abs(num) < 100, small).when(num.isNotNull(), size)
    return F.when(text.isNotNull(), F.when(F.length(text) <= 40, F.coalesce(whole, word, shape)).otherwise(shape))


def agreement(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors kept as maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def alike(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """``a, b, score`` of the given pairs of names, where their contents agree."""
    one, two = profile.select(F.col("path").alias("a"), F.col("profile").alias("pa")), profile.select(F.col("path").alias("b"), F.col("profile").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", agreement(F.col("pa"), F.col("pb")).alias("score")).where(F.col("score") >= SAME_CONTENT)


def renames(cand: DataFrame) -> DataFrame:
    """Pairs ``run_id, file_no, old_field, new_field``: the best of each side first, then the best of what is left, until none is."""
    out, files = None, ["run_id", "file_no"]
    while True:
        best = lambda side: F.row_number().over(W.partitionBy(*files, side).orderBy(F.desc("score"), "old_field", "new_field"))
        named = written(cand.withColumn("i", best("old_field")).withColumn("j", best("new_field")).where("i = 1 and j = 1").select(*files, "old_field", "new_field"), "renamed")
        out = named if out is None else out.unionByName(named)
        if named.isEmpty():
            return out
        cand = written(cand.join(named.select(*files, "old_field"), [*files, "old_field"], "left_anti").join(named.select(*files, "new_field"), [*files, "new_field"], "left_anti"), "candidates")


def changes(head: DataFrame, profile: DataFrame) -> DataFrame:
    """``run_id, file_no, change_type, old_field, new_field``: the differences of all files."""
    files = head.select("run_id", "file_no").distinct()
    pairs = files.select("run_id", (F.col("file_no") + 1).alias("file_no")).join(files, ["run_id", "file_no"], "left_semi")
    old = head.select("run_id", (F.col("file_no") + 1).alias("file_no"), "path", F.col("kind").alias("was"), F.lit(True).alias("o")).join(pairs, ["run_id", "file_no"], "left_semi")
    new = head.select("run_id", "file_no", "path", F.col("kind").alias("now"), F.lit(True).alias("n")).join(pairs, ["run_id", "file_no"], "left_semi")
    both = written(old.join(new, ["run_id", "file_no", "path"], "full").where("o is null or n is null or was <> now"), "differences")
    retyped = both.where("o and n").select("run_id", "file_no", F.lit("retyped").alias("change_type"), F.col("path").alias("old_field"), F.col("path").alias("new_field"))
    gone = both.where("n is null").select("run_id", "file_no", F.col("path").alias("old_field"), "was")
    came = both.where("o is null").select("run_id", "file_no", F.col("path").alias("new_field"), "now")
    cand = gone.join(came, ["run_id", "file_no"]).where("was is null or now is null or was = now").drop("was", "now")
    scores = alike(cand.select(F.col("old_field").alias("a"), F.col("new_field").alias("b")).distinct(), profile)
    named = renames(written(cand.join(scores.select(F.col("a").alias("old_field"), F.col("b").alias("new_field"), "score"), ["old_field", "new_field"]), "candidates"))
    removed = gone.join(named, ["run_id", "file_no", "old_field"], "left_anti").select("run_id", "file_no", F.lit("removed").alias("change_type"), "old_field", F.lit("").alias("new_field"))
    added = came.join(named, ["run_id", "file_no", "new_field"], "left_anti").select("run_id", "file_no", F.lit("added").alias("change_type"), F.lit("").alias("old_field"), "new_field")
    renamed = named.select("run_id", "file_no", F.lit("renamed").alias("change_type"), "old_field", "new_field")
    return retyped.unionByName(removed).unionByName(added).unionByName(renamed)


def found(raw: DataFrame) -> DataFrame:
    head = headers(raw)
    return changes(head, profiles(raw, head))


def log(raw: DataFrame) -> DataFrame:
    """The change log in order: ``run_id, step`` and the change; steps count within a run, by file, kind of change and field."""
    order = W.partitionBy("run_id").orderBy("file_no", "change_type", "old_field", "new_field")
    return found(raw).withColumn("step", F.row_number().over(order)).select("run_id", "step", "file_no", "change_type", "old_field", "new_field")


def meanings(profile: DataFrame) -> DataFrame:
    """``path, target``: the column of results that a name stands for, where one does.

    A name that is a column of results stands for it; any other stands for the column whose name has
    the most similar content over the corpus.
    """
    targets = profile.sparkSession.createDataFrame([(t,) for t in TARGET], "b string")
    pairs = profile.select(F.col("path").alias("a")).where(~F.col("a").isin(*TARGET)).join(F.broadcast(targets))  # six rows
    other = alike(pairs, profile).groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))
    return other.unionByName(targets.select(F.col("b").alias("a"), "b")).toDF("path", "target")


def union_schema(head: DataFrame, profile: DataFrame) -> list[tuple[str, str, list[str]]]:
    """The union schema of all files: name, SQL type, and the names it goes by. Names that stand for a column of results come under it."""
    rows = head.groupBy("path").agg(folded(F.col("kind")).alias("kind")).join(meanings(profile), "path", "left").orderBy("path").limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"more than {NAMES} names of fields")
    out: dict[str, tuple[str, list[str]]] = {t: (ty, [t]) for t, ty in TARGET.items()}
    for r in rows:
        if r.target:
            out[r.target][1].extend([r.path] if r.path != r.target else [])
        else:
            out[r.path] = (SQL_TYPE.get(r.kind or "string", "string"), [r.path])
    return [(name, ty, paths) for name, (ty, paths) in out.items()]


def unified(raw: DataFrame) -> DataFrame:
    """All readable lines as one table: every field of the union schema, cast to its promoted type.

    The columns of results come first; the others are kept in ``others``, a map from name to the value as text (a
    field of several types is text). ``run_id, file_no, line_no`` tell a line's place. A value that its column's type
    can't hold is null there and stays in ``others`` under its own name.
    """
    head = headers(raw)
    schema = union_schema(head, profiles(raw, head))
    quoted = lambda k: f'["{k}"]' if "'" in k else f"['{k}']"  # noqa: E731 - a key with both kinds of quotes can't be asked for
    at = lambda keys: F.lit(None).cast("string") if any("'" in k and '"' in k for k in keys) else F.try_variant_get("v", "$" + "".join(map(quoted, keys)), "string")
    # a dot may also be part of a key
    text = lambda p: F.coalesce(at(p.split(".")), at([p])) if "." in p else at([p])
    cols, rest = [], []
    for name, ty, paths in schema:
        value = F.coalesce(*[text(p) for p in paths])
        if name in TARGET:
            cols.append((value if ty == "string" else value.try_cast(ty)).alias(name))
            if ty != "string":
                rest.append(F.when(value.isNotNull() & value.try_cast(ty).isNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
        else:
            cast = value if ty == "string" else value.try_cast(ty).cast("string")
            rest.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), F.coalesce(cast, value).alias("value"))))
    reasons = next(p for n, _, p in schema if n == "finish_reason")
    keys = lambda p: F.coalesce(F.array_contains(F.json_object_keys(text(".".join(p.split(".")[:-1])) if "." in p else F.col("line")), p.split(".")[-1]), F.lit(False))
    has = keys(reasons[0])
    for p in reasons[1:]:
        has = has | keys(p)
    others = F.map_from_entries(F.array_compact(F.array(*rest))) if rest else F.expr("cast(map() as map<string, string>)")
    return readable(raw).select("run_id", "file_no", "line_no", *cols, has.alias("has_finish_reason"), "file_name", F.col("written_at").alias("completed_at"), others.alias("others"))
