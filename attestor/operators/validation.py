"""Validators that yield findings, and what is decided from findings."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import best_per_key

# How UTF-8 text looks when decoded as Latin-1 or cp1252, and the replacement character.
MOJIBAKE = ["Ã©", "Ã¨", "â€™", "â€œ", "Â ", "�"]


_TYPES = {"string": ("string", "date", "timestamp"), "integer": ("tinyint", "smallint", "int", "bigint"), "number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "boolean": ("boolean",), "array": ("array",), "object": ("struct", "map")}


def schema_errors(schema: dict, at: str = "$", of: Column | None = None, first: int = 5, frame: T.StructType | None = None) -> Column:
    """The first errors, by path, of the row (or of struct `of`) against a JSON Schema: required, enum, const, minimum,
    maximum, minLength, maxLength, pattern, format (date, date-time), minItems, uniqueItems, nested objects, arrays' items and
    $ref to the schema's own parts. A null is an absent value. With the frame's own schema given, type and
    additionalProperties are looked at too; as these are the same for all rows, so are their errors."""
    fixed = sorted(_type_errors(schema, frame, at, schema)) if frame is not None else []
    found = F.concat(_errors(schema, at, of, schema), F.array(*map(F.lit, fixed)) if fixed else F.array().cast("array<string>"))
    return F.slice(F.array_sort(found), 1, first)


def _resolved(schema: dict, root: dict) -> dict:
    while "$ref" in schema:
        part = root
        for key in schema["$ref"].removeprefix("#/").split("/"):
            part = part[key]
        schema = part
    return schema


def _type_errors(schema: dict, kind: T.DataType, at: str, root: dict) -> list[str]:
    schema = _resolved(schema, root)
    allowed = schema.get("type", [])
    allowed = [k for k in ([allowed] if isinstance(allowed, str) else allowed) if k != "null"]
    name = kind.simpleString().split("<")[0].split("(")[0]
    if allowed and not any(name in _TYPES[k] for k in allowed):
        return [f"{at}: not of type {' or '.join(allowed)}"]
    out = []
    if isinstance(kind, T.StructType):
        known = schema.get("properties", {})
        for f in kind.fields:
            if f.name in known:
                out += _type_errors(known[f.name], f.dataType, f"{at}.{f.name}", root)
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{f.name}: not allowed")
    if isinstance(kind, T.ArrayType) and "items" in schema:
        out += _type_errors(schema["items"], kind.elementType, f"{at}[]", root)
    return out


def _errors(schema: dict, at: str, of: Column | None, root: dict) -> Column:
    parts = []
    for name in schema.get("required", []):
        c = F.col(name) if of is None else of[name]
        parts.append(_found([(c.isNull(), f"{at}.{name}: required")]))
    for name, sub in schema.get("properties", {}).items():
        parts.append(_value_errors(_resolved(sub, root), f"{at}.{name}", F.col(name) if of is None else of[name], root))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _value_errors(s: dict, at: str, c: Column, root: dict) -> Column:
    tests = []
    if "enum" in s:
        tests.append((~c.isin([v for v in s["enum"] if v is not None]), "not in enum"))
    if "const" in s:
        tests.append((c != s["const"], "not the constant"))
    if "minimum" in s:
        tests.append((c < s["minimum"], "below minimum"))
    if "maximum" in s:
        tests.append((c > s["maximum"], "above maximum"))
    if "minLength" in s:
        tests.append((F.length(c) < s["minLength"], "too short"))
    if "maxLength" in s:
        tests.append((F.length(c) > s["maxLength"], "too long"))
    if "pattern" in s:
        tests.append((~c.rlike(s["pattern"]), "does not match"))
    if s.get("format") in ("date", "date-time"):
        shape, kind = (r"^\d{4}-\d{2}-\d{2}$", "date") if s["format"] == "date" else (r"^\d{4}-\d{2}-\d{2}[T ]", "timestamp")
        tests.append((c.isNotNull() & (~c.cast("string").rlike(shape) | c.cast("string").try_cast(kind).isNull()), f"not a {s['format']}"))
    if "minItems" in s:
        tests.append((F.size(c) < s["minItems"], "too few items"))
    if s.get("uniqueItems"):
        tests.append((F.size(F.array_distinct(c)) < F.size(c), "repeated items"))
    out = [_found([(t, f"{at}: {what}") for t, what in tests])] if tests else []
    none = F.array().cast("array<string>")
    if s.get("properties") or s.get("required"):
        out.append(F.when(c.isNotNull(), _errors(s, at, c, root)).otherwise(none))
    if "items" in s:
        out.append(F.coalesce(F.flatten(F.transform(c, lambda e: _value_errors(_resolved(s["items"], root), f"{at}[]", e, root))), none))
    return F.concat(*out) if out else none


def _found(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*(F.when(test, text) for test, text in pairs)), lambda x: x.isNotNull())


_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _is_kind(value, kind: str) -> bool:
    return isinstance(value, _KINDS[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))


def document_errors(schema: dict, value, at: str = "$", root: dict | None = None) -> list[str]:
    """The errors, by path, of one document (a driver's value, not a column) against a JSON Schema: type, enum, const,
    required, properties, additionalProperties, items, minItems, uniqueItems, minimum, maximum, minLength, maxLength,
    pattern, format (date, date-time) and $ref to the schema's own parts."""
    root = schema if root is None else root
    if "$ref" in schema:
        part = root
        for key in schema["$ref"].removeprefix("#/").split("/"):
            part = part[key]
        return document_errors(part, value, at, root)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is_kind(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        out += [f"{at}: does not match"] * ("pattern" in schema and not re.search(schema["pattern"], value)) + [f"{at}: not a {schema.get('format')}"] * (not _has_format(value, schema.get("format")))
    if _is_kind(value, "number"):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, list):
        out += [f"{at}: too few items"] * (len(value) < schema.get("minItems", 0))
        out += [f"{at}: repeated items"] * (bool(schema.get("uniqueItems")) and len({json.dumps(v, sort_keys=True) for v in value}) < len(value))
        for k, v in enumerate(value):
            out += document_errors(schema.get("items", {}), v, f"{at}[{k}]", root)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += document_errors(known[k], v, f"{at}.{k}", root)
            elif more is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(more, dict):
                out += document_errors(more, v, f"{at}.{k}", root)
    return sorted(out)


def _has_format(value: str, kind: str | None) -> bool:
    try:
        if kind == "date":
            return len(value) == 10 and bool(datetime.date.fromisoformat(value))
        return kind != "date-time" or bool(datetime.datetime.fromisoformat(value))
    except ValueError:
        return False


def markers_in(text: Column, markers: list[str]) -> Column:
    """The markers that the text holds, in their order; none for null text."""
    return _found([(F.contains(text, F.lit(m)), m) for m in markers])


def cited_quotes(quotes: DataFrame, passages: DataFrame, passage_id: str, quote: str, text: str) -> DataFrame:
    """quotes with `resolves`: the quote is not blank and stands in the passage that it cites (an equi-join, not a scan)."""
    cited = passages.select(passage_id, F.col(text).alias("_text"))
    ok = F.coalesce(F.contains("_text", quote), F.lit(False)) & (F.coalesce(F.trim(quote), F.lit("")) != "")
    return quotes.join(cited, passage_id, "left").withColumn("resolves", ok).drop("_text")


def current_records(df: DataFrame, key: str, replaces: str) -> DataFrame:
    """Records that no other record replaces."""
    gone = df.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def with_disposition(findings: DataFrame, log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Findings stay as they are; the latest log record of each gives its disposition, else open."""
    last = best_per_key(log.select(key, order, state), [key], [order]).select(key, F.col(state).alias("_s"))
    return findings.join(last, key, "left").withColumn("disposition", F.coalesce("_s", F.lit("open"))).drop("_s")


def verdict(executed: Column, critical: Column, failed_gates: Column, open_reviews: Column) -> Column:
    """Layers in order, none making up for another: execution, critical findings, gates, review."""
    return (
        F.when(~F.coalesce(executed, F.lit(False)), "not_executed").when(critical > 0, "rejected_critical")
        .when(failed_gates > 0, "rejected_gate").when(open_reviews > 0, "pending_review").otherwise("accepted")
    )


def prohibited_keys(df: DataFrame, document: str, names: list[str]) -> DataFrame:
    """df with `prohibited`: the forbidden keys that its JSON text holds, sorted."""
    held = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    return df.withColumn("prohibited", F.array_sort(F.array_intersect(held, F.array(*map(F.lit, names)))))


def roadmap_only(entities: DataFrame, evidence: DataFrame, key: str, state: str, planned: list[str]) -> DataFrame:
    """Entities that have evidence, all of which speaks of plans."""
    seen = evidence.groupBy(key).agg(F.bool_and(F.coalesce(F.col(state).isin(planned), F.lit(False))).alias("_planned"))
    return entities.join(seen.where("_planned").select(key), key, "left_semi")


def changed_raw(raw: DataFrame, now: DataFrame, key: str, text: str) -> DataFrame:
    """(key, what): raw records that are gone or whose text is no longer what it was. Only hashes move."""
    old = raw.select(key, F.sha2(text, 256).alias("_old"))
    new = now.select(key, F.sha2(text, 256).alias("_new"), F.lit(True).alias("_there"))
    both = old.join(new, key, "left")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, F.when(F.col("_there").isNull(), "gone").otherwise("changed").alias("what"))


def outcomes_in(df: DataFrame, outcomes: list[str]) -> Column:
    """The outcome columns that a row of inputs has a value in; columns that the frame lacks don't count."""
    return _found([(F.col(c).isNotNull(), c) for c in outcomes if c in df.columns])
