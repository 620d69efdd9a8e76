"""Edits of nested documents by path: audit, application, reversal, and rebuilding the text bottom up.

A document is taken apart into leaves: (by, path, value). A path is an array of steps, `.key` for a key of an object and `[n]` with ten
digits for a place in an array, so that paths sort as documents do; value is the JSON text of a string, number, boolean or null, or of an empty object or array.
Patches (by, path, before, after) replace the part below a path; a null `before` adds a part that isn't there, a null `after` removes one.

Cases: text that is no JSON, or null, has no leaf and no rebuilt document. Numbers come back as Spark's variant writes them (1.50 as 1.5), keys sorted and
without white space, so that equal documents have equal text and digest. Documents may be nested to any depth; each level is one pass.
Places of an array close up where one is removed. Repeated documents (same keys) are an error of the caller: their leaves are taken together.

`revised` does all of it for documents that each fit a row, one document after another in one pass, without leaves as rows: the other operators are for documents
given as leaves, and for a step of it alone. There, repeated documents are patched each by itself.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.graph import cut_lineage


def leaves(documents: DataFrame, by: Sequence[str], json: str = "json") -> DataFrame:
    """(by, path, value) of every leaf. The documents are written first, as each level is read three times."""
    spark = documents.sparkSession
    level = cut_lineage(documents.select(*by, F.array().cast("array<string>").alias("path"), F.col(json).alias("text")), "levels")
    level = level.select(*by, "path", F.try_parse_json("text").alias("v")).filter("v IS NOT NULL")
    found: DataFrame | None = None
    text = F.to_json("v")
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)") & ~text.isin("{}", "[]")
    while True:
        marked = level.withColumn("nested", nested)
        own = marked.filter("NOT nested").select(*by, "path", text.alias("value"))
        found = own if found is None else found.unionByName(own)
        deeper = marked.filter("nested")
        if deeper.isEmpty():
            return found
        each = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("__pos", "__key", "__value"))
        step = F.when(F.col("__key").isNull(), F.concat(F.lit("["), F.lpad(F.col("__pos").cast("string"), 10, "0"), F.lit("]"))).otherwise(F.concat(F.lit("."), "__key"))
        # Variants aren't written to all table formats; a level is carried as JSON text.
        text_of = cut_lineage(each.select(*by, F.array_append("path", step).alias("path"), F.coalesce(F.to_json("__value"), F.lit("null")).alias("text")), "levels")
        level = text_of.select(*by, "path", F.parse_json("text").alias("v"))


def _parent(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def _last(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def rebuilt(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, json): documents from their leaves, level by level from the deepest: the parts of one parent are joined in order of their steps."""
    rows = cut_lineage(parts.select(*by, "path", "value", F.size("path").alias("depth")), "rebuilt")
    deepest = rows.agg(F.max("depth")).first()[0]
    for depth in range(deepest or 0, 0, -1):
        here = rows.filter(F.col("depth") == depth)
        step = _last(F.col("path"))
        name = F.to_json(F.struct(F.substring(step, 2, 1 << 30).alias("k")))  # {"k":"name"}
        item = F.when(F.startswith(step, F.lit("[")), F.col("value")).otherwise(F.concat(name.substr(F.lit(6), F.length(name) - 6), F.lit(":"), "value"))
        keyed = here.select(*by, _parent(F.col("path")).alias("path"), step.alias("step"), item.alias("item"))
        inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "item"))), lambda x: x["item"]), ",")
        above = keyed.groupBy(*by, "path").agg(F.min("step").alias("step"), inner.alias("inner"))
        text = F.when(F.startswith("step", F.lit("[")), F.concat(F.lit("["), "inner", F.lit("]"))).otherwise(F.concat(F.lit("{"), "inner", F.lit("}")))
        rows = rows.filter(F.col("depth") < depth).unionByName(above.select(*by, "path", text.alias("value"), F.lit(depth - 1).alias("depth")))
        rows = cut_lineage(rows, "rebuilt")
    return rows.filter("depth = 0").select(*by, F.col("value").alias("json"))


def steps(path: Column) -> Column:
    """The steps of a path written `$.lines[0].note`; keys hold neither dots nor brackets there."""
    found = F.regexp_extract_all(path, F.lit(r"\.[^.\[\]]+|\[\d+\]"), F.lit(0))
    return F.transform(found, lambda s: F.when(F.startswith(s, F.lit("[")), F.concat(F.lit("["), F.lpad(F.regexp_replace(s, r"[\[\]]", ""), 10, "0"), F.lit("]"))).otherwise(s))


def written(path: Column) -> Column:
    """A path of steps as `$.lines[0].note`."""
    return F.concat(F.lit("$"), F.array_join(F.transform(path, lambda s: F.regexp_replace(s, r"^\[0*(\d+)\]$", "[$1]")), ""))


def _prefixes(path: Column) -> Column:
    """All prefixes of a path, the empty one and the path itself too."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.slice(path, F.lit(1), k))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without white space; null for text that is none."""
    return F.to_json(F.try_parse_json(json))


def _below(parts: DataFrame, patches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaves with the patch (its `number` and path) whose part they are in: an equality join on the prefixes of their paths, as deep as these are long."""
    spread = parts.select(*by, "path", "value", F.explode(_prefixes(F.col("path"))).alias("__at"))
    return spread.join(patches.select(*by, "number", F.col("path").alias("__at")), [*by, "__at"])


def audited(parts: DataFrame, patches: DataFrame, by: Sequence[str]) -> DataFrame:
    """patches (by, number, path, before, after) with `issue`, the first that holds: invalid_json, no_change, overlap (with another patch of the document: the same path, or one within the other), missing (no such part), exists (a part where one is to be added), stale (the part isn't `before`).

    parts are the leaves of the documents, path an array of steps, before and after JSON text. number tells the patches of a document apart.
    """
    asked = patches.select(*by, "number", "path", "before", "after")
    # A part within another: its path has the other's as a prefix.
    inner = asked.select(*by, F.col("number").alias("__inner"), F.explode(_prefixes(F.col("path"))).alias("__at"))
    pairs = inner.join(asked.select(*by, F.col("number").alias("__outer"), F.col("path").alias("__at")), [*by, "__at"]).filter("__inner <> __outer")
    overlap = pairs.select(*by, F.explode(F.array("__inner", "__outer")).alias("number")).distinct().withColumn("__overlap", F.lit(True))
    held = _below(parts, asked, by)
    inside = held.select(*by, "number", F.slice("path", F.size("__at") + 1, F.size("path")).alias("path"), "value")
    now = rebuilt(inside, [*by, "number"]).withColumnRenamed("json", "__now")
    told = asked.join(overlap, [*by, "number"], "left").join(now, [*by, "number"], "left")
    wrong = lambda c: F.col(c).isNotNull() & canonical(F.col(c)).isNull()
    issue = (
        F.when(wrong("before") | wrong("after"), "invalid_json")
        .when(canonical(F.col("before")).eqNullSafe(canonical(F.col("after"))), "no_change")
        .when(F.col("__overlap"), "overlap")
        .when(F.col("before").isNull() & F.col("__now").isNotNull(), "exists")
        .when(F.col("before").isNotNull() & F.col("__now").isNull(), "missing")
        .when(F.col("before").isNotNull() & (canonical(F.col("before")) != F.col("__now")), "stale")
    )
    return told.withColumn("issue", issue).select(*by, "number", "path", "before", "after", "issue")


def applied(parts: DataFrame, checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaves after the patches of all documents none of whose patches has an issue; documents with an issue stay as they are.

    An object or array that loses its last part is left empty; places of an array are numbered anew.
    """
    bad = checked.filter("issue IS NOT NULL").select(*by).distinct()
    sound = cut_lineage(checked.join(bad, list(by), "left_anti"), "patches")
    gone = _below(parts, sound, by).select(*by, "path").distinct()
    left = parts.join(gone, [*by, "path"], "left_anti")
    new = leaves(sound.filter("after IS NOT NULL").select(*by, "number", "after"), [*by, "number"], "after")
    placed = new.join(sound.select(*by, "number", F.col("path").alias("__at")), [*by, "number"]).select(*by, F.concat("__at", "path").alias("path"), "value")
    # Parents of removed parts that have nothing left: `{}` or `[]`, unless the document itself goes.
    parents = sound.filter("after IS NULL AND size(path) > 0").select(*by, _parent(F.col("path")).alias("path"), F.when(F.startswith(_last(F.col("path")), F.lit("[")), "[]").otherwise("{}").alias("value"))
    kept = left.unionByName(placed)
    touched = kept.join(parents.select(*by).distinct(), list(by), "left_semi")
    full = touched.select(*by, F.explode(_prefixes(F.col("path"))).alias("path")).distinct()
    both = kept.unionByName(parents.dropDuplicates([*by, "path"]).join(full, [*by, "path"], "left_anti"))
    # A part added below an empty object or array takes its place.
    inner = placed.select(*by, F.explode(_prefixes(_parent(F.col("path")))).alias("path")).distinct()
    return both.join(inner.withColumn("value", F.explode(F.array(F.lit("{}"), F.lit("[]")))), [*by, "path", "value"], "left_anti")


def closed_up(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaves whose places in arrays are 0, 1, 2, ... again: each step of a place becomes its rank among its siblings."""
    deepest = parts.agg(F.max(F.size("path"))).first()[0] or 0
    rows = parts
    for k in range(1, deepest + 1):
        step = F.get("path", F.lit(k - 1))
        rank = F.dense_rank().over(Window.partitionBy(*by, F.slice("path", F.lit(1), F.lit(k - 1))).orderBy(F.asc_nulls_last(step))) - 1
        new = F.concat(F.lit("["), F.lpad(rank.cast("string"), 10, "0"), F.lit("]"))
        rows = rows.withColumn("__step", F.when(F.startswith(step, F.lit("[")), new).otherwise(step))
        moved = F.concat(F.slice("path", F.lit(1), F.lit(k - 1)), F.array("__step"), F.slice("path", F.lit(k + 1), F.greatest(F.size("path") - k, F.lit(0))))
        rows = rows.withColumn("path", F.when(F.size("path") >= k, moved).otherwise(F.col("path"))).drop("__step")
    return rows


def reversed_patches(patches: DataFrame) -> DataFrame:
    """The patches that take the others back."""
    return patches.withColumn("__before", F.col("before")).withColumn("before", F.col("after")).withColumn("after", F.col("__before")).drop("__before")


class _Number(str):
    """A number as its JSON text."""


class _Places(dict):
    """An array that is being edited: its parts by the places that they had before."""


_MISSING = object()
_read = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number, strict=False).decode


def _quoted(text: str) -> str:
    """JSON text of a string as Spark writes it."""
    found = encode_basestring(text)
    return re.sub(r"\\(?:u[0-9a-f]{4}|.)", lambda m: m[0] if len(m[0]) == 2 else "\\u" + m[0][2:].upper(), found) if "\\u00" in found else found


def _text(value: object) -> str:
    """JSON text without white space, keys in the order of their bytes."""
    kind = type(value)
    if kind is str:
        return _quoted(value)
    if kind is _Number:
        return value
    if kind is dict:
        return "{" + ",".join([_quoted(k) + ":" + _text(value[k]) for k in sorted(value)]) + "}"
    if kind is list:
        return "[" + ",".join(map(_text, value)) + "]"
    if kind is _Places:
        return "[" + ",".join([_text(value[k]) for k in sorted(value)]) + "]"
    return "null" if value is None else "true" if value else "false"


@lru_cache(1 << 16)
def _steps(path: str) -> tuple[str | int, ...]:
    """As steps(), with keys and places as they are."""
    return tuple(int(s[1:-1][:10]) if s[0] == "[" else s[1:] for s in re.findall(r"\.[^.\[\]]+|\[[0-9]+\]", path))


def _part(value: object, path: tuple[str | int, ...]) -> object:
    for step in path:
        if type(step) is int:
            value = value[step] if type(value) is list and step < len(value) else _MISSING
        else:
            value = value.get(step, _MISSING) if type(value) is dict else _MISSING
        if value is _MISSING:
            break
    return value


def _issue(document: object, patch: tuple, others: list[tuple]) -> str | None:
    """The first issue of a patch (number, path, before, after, canonical before and after), as in audited()."""
    number, path, before, after, old, new = patch
    if (before is not None and old is None) or (after is not None and new is None):
        return "invalid_json"
    if old == new:
        return "no_change"
    if path is None:
        return None if before is None else "missing"
    if any(p is not None and n != number and p[: len(path)] == path[: len(p)] for n, p, *_ in others):
        return "overlap"
    now = _part(document, path)
    if before is None:
        return None if now is _MISSING else "exists"
    if now is _MISSING:
        return "missing"
    return None if _text(now) == _text(_read(old)) else "stale"


def _held(value: object, step: str | int) -> object:
    """The object or array that a part can be added to by this step: the value itself, another if it is empty; _MISSING if another part is in the way."""
    if type(step) is int:
        return value if type(value) is _Places else _Places(enumerate(value)) if type(value) is list else _Places() if type(value) is dict and not value else _MISSING
    return value if type(value) is dict else {} if type(value) in (list, _Places) and not value else _MISSING


def _edited(document: object, patches: list[tuple]) -> object:
    """The document after patches without an issue, removals first; _MISSING if it is removed as a whole, None in a tuple if a part is in the way of one that is added."""
    root = {} if document is _MISSING else {"": document}
    for _, path, _, _, _, new in sorted((p for p in patches if p[1] is not None), key=lambda p: p[5] is not None):
        at, last = root, ""
        for step in path:
            inside = _held(at[last] if last in at else _Places() if type(step) is int else {}, step)
            if inside is _MISSING:
                return (None,)
            at[last] = inside
            at, last = inside, step
        if new is None:
            at.pop(last, None)
        else:
            at[last] = _read(new)
    return root.get("", _MISSING)


def _revise(text: str | None, patches: list[tuple]) -> tuple[str | None, str]:
    """A document's text after its patches, None if there is none before or after, and what issues they have."""
    if not patches and (text is None or text.isascii()):
        return text, ""
    document = _MISSING if text is None else _read(text)
    issues = {_issue(document, p, patches) for p in patches} - {None}
    if not issues and patches:
        after = _edited(document, patches)
        if type(after) is not tuple:
            return None if after is _MISSING else _text(after), ""
        issues, document = {"exists"}, _read(text)
    return None if document is _MISSING else _text(document), ",".join(sorted(issues))


def revised(documents: DataFrame, patches: DataFrame, by: Sequence[str], json: str = "json") -> DataFrame:
    """(by, json, digest, issues): every document that is JSON after its patches (by, number, path as written, before, after), with its digest; issues names what its patches have, and then it is unchanged.

    A part that is to be added below one that is no object or array, or below a full one of the other kind, `exists` as well. Where there is no document, or none that is JSON,
    patches that only add make one. Patches with a key that is null belong to no document.
    """
    texts = documents.select(*by, canonical(F.col(json)).alias("json"))
    told = patches.select(*by, F.struct(F.col("number").cast("string").alias("number"), "path", "before", "after", canonical(F.col("before")).alias("old"), canonical(F.col("after")).alias("new")).alias("__patch"))
    asked = told.dropna(subset=list(by)).groupBy(*by).agg(F.collect_list("__patch").alias("__asked"))
    rows = texts.join(asked, list(by), "full")
    names = [*by, "json", "issues"]

    def revise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for b in batches:
            asked = b.column("__asked")
            fields = dict(zip((f.name for f in asked.type.value_type), (x.to_pylist() for x in asked.flatten().flatten()), strict=True))
            paths = [None if p is None else _steps(p) for p in fields["path"]]
            each = list(zip(fields["number"], paths, fields["before"], fields["after"], fields["old"], fields["new"], strict=True))
            at, kept, after, issues = 0, [], [], []
            for k, (text, n) in enumerate(zip(b.column("json").to_pylist(), asked.value_lengths().fill_null(0).to_pylist(), strict=True)):
                new, issue = _revise(text, each[at : at + n])
                if new is not None:
                    kept.append(k)
                    after.append(new)
                    issues.append(issue)
                at += n
            chosen = b.select(list(by)).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(after, pa.string()), pa.array(issues, pa.string())], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    after = rows.mapInArrow(revise, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "json string", "issues string"]))
    return after.select(*by, "json", F.sha2(F.col("json").cast("binary"), 256).alias("digest"), "issues")
