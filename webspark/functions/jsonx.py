"""JSON: lenient reading, typed getters, and schemas (normalising at plan time, checking by row)."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of schemas that extraction does not support and drops.
DROPPED = frozenset(
    "default pattern format minItems maxItems minimum maximum minLength maxLength uniqueItems patternProperties unevaluatedProperties $comment examples".split()
)
#: Keywords whose values are data and no schemas.
OPAQUE = frozenset("required enum const type additionalProperties".split())
REF_DEPTH, SCHEMA_DEPTH = 10, 100


def valid(text: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def text_at(document: Column, path: str) -> Column:
    """A string at a path; null if it is missing, empty or no string."""
    return F.nullif(F.try_variant_get(F.try_parse_json(document), path, "string"), F.lit(""))


def int_at(document: Column, path: str) -> Column:
    """A whole number at a path, written as a number or as text; null for anything else."""
    v = F.try_parse_json(document)
    text = F.try_variant_get(v, path, "string")
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


def bool_at(document: Column, path: str) -> Column:
    """A truth value at a path; null for anything else."""
    v = F.try_parse_json(document)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def string_array(text: Column) -> Column:
    """The strings of a JSON array; other members are dropped, what is no array gives null."""
    parsed = F.from_json(text, "array<variant>", {"mode": "PERMISSIVE"})
    return F.when(
        F.ltrim(text).startswith("[") & parsed.isNotNull(),
        F.transform(F.filter(parsed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")),
    )


def resolution(text: Column) -> Column:
    """Struct (width, height) of a text with two numbers; null for others."""
    found = r"(\d+)\D+(\d+)"
    pair = F.struct(F.regexp_extract(text, found, 1).try_cast("int").alias("width"), F.regexp_extract(text, found, 2).try_cast("int").alias("height"))
    return F.when(text.rlike(found), pair)


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A number cut to whole and kept within bounds; null gives the default."""
    bounded = F.least(F.greatest(value.cast("bigint"), F.lit(low)), F.lit(high))
    return F.when(value.isNull(), F.lit(default)).otherwise(bounded).cast("bigint")


# ---- schemas -----------------------------------------------------------------------------------


def _is_object(node: dict) -> bool:
    kinds = node.get("type")
    return kinds == "object" or isinstance(node.get("properties"), dict) or (isinstance(kinds, list) and "object" in kinds)


def _is_bare_array(schema: dict) -> bool:
    kinds = schema.get("type")
    if kinds == "array" or (isinstance(kinds, list) and "array" in kinds):
        return True
    return kinds is None and "items" in schema and not _is_object(schema)


def _at_pointer(root: Any, ref: str) -> Any:
    """What a local pointer names; raises KeyError if nothing."""
    if not ref.startswith("#"):
        raise KeyError(ref)
    at = root
    for token in [t.replace("~1", "/").replace("~0", "~") for t in ref[1:].lstrip("/").split("/")] if ref[1:] not in ("", "/") else []:
        if isinstance(at, list):
            if not token.isdigit() or int(token) >= len(at):
                raise KeyError(ref)
            at = at[int(token)]
        elif isinstance(at, dict):
            at = at[token]
        else:
            raise KeyError(ref)
    return at


def normalize_schema(schema: dict) -> tuple[dict, list[str]]:
    """A schema as strict structured output takes it, and warnings.

    Local references are put in place (to a depth of REF_DEPTH, cycles left and reported), keywords
    without support dropped, every object closed with all its properties required, and a bare array
    wrapped into an object with the property ``items``. Beyond SCHEMA_DEPTH levels nodes stay.
    """
    notes: list[str] = []

    def walk(node: Any, refs: tuple[str, ...], depth: int) -> Any:
        if depth >= SCHEMA_DEPTH:
            notes.append(f"schema depth cap reached at {SCHEMA_DEPTH}")
            return node
        if isinstance(node, list):
            return [walk(n, refs, depth + 1) for n in node]
        if not isinstance(node, dict):
            return node
        ref = node.get("$ref")
        if isinstance(ref, str):
            if len(refs) >= REF_DEPTH:
                notes.append(f"$ref depth cap reached at {ref}")
                return dict(node)
            if ref in refs:
                notes.append(f"cyclic $ref: {ref}")
                return dict(node)
            try:
                return walk(_at_pointer(schema, ref), (*refs, ref), depth + 1)
            except KeyError:
                notes.append(f"unresolved $ref: {ref}")
                return dict(node)
        out = {k: v if k in OPAQUE else walk(v, refs, depth + 1) for k, v in node.items() if k not in DROPPED}
        if _is_object(out):
            out["additionalProperties"] = False
            out["required"] = list(out["properties"]) if isinstance(out.get("properties"), dict) else []
            out.setdefault("type", "object")
        return out

    root = {"type": "object", "properties": {"items": schema}, "required": ["items"], "additionalProperties": False} if _is_bare_array(schema) else schema
    return walk(root, (), 0), notes


def equal(a: Any, b: Any) -> bool:
    """Equality of JSON values; the order of keys does not count, and 1 is not true."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return type(a) is type(b) and a == b if not (isinstance(a, (int, float)) and isinstance(b, (int, float))) else a == b


def _whole(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer()


_KINDS = {
    "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": _whole,
    "boolean": lambda v: isinstance(v, bool),
}


def _kind(v: Any) -> str:
    return next(k for k in ("null", "array", "boolean", "integer", "number", "string", "object") if _KINDS[k](v))


def schema_errors(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What keeps a value from fitting a schema, with the place of each fault. Types, enums,
    alternatives, required and additional properties, and items are checked; other keywords not."""
    if not isinstance(schema, dict):
        return ["schema must be an object"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(k, str) and _KINDS.get(k, lambda _: True)(value) for k in kinds):
            return [f"{at}: expected {' | '.join(map(str, kinds))}, got {_kind(value)}"]
    choices = schema.get("enum")
    if isinstance(choices, list) and choices and not any(equal(c, value) for c in choices):
        out.append(f"{at}: value not in enum")
    for word in ("anyOf", "oneOf"):
        branches = schema.get(word)
        if isinstance(branches, list) and branches and not any(isinstance(b, dict) and not schema_errors(value, b, at) for b in branches):
            out.append(f"{at}: does not match {word}")
    properties = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
    if isinstance(value, dict):
        required = schema["required"] if isinstance(schema.get("required"), list) else []
        out += [f"{at}.{k}: required property missing" for k in required if isinstance(k, str) and k not in value]
        for k, child in properties.items():
            if k in value and isinstance(child, dict):
                out += schema_errors(value[k], child, f"{at}.{k}")
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: additional property not allowed" for k in value if k not in properties]
    items = schema.get("items")
    if isinstance(value, list) and items is not None:
        pairs = zip(value, items) if isinstance(items, list) else ((v, items) for v in value)
        for i, (v, child) in enumerate(pairs):
            if isinstance(child, dict):
                out += schema_errors(v, child, f"{at}[{i}]")
    return out


def validate(text: Column, schema: dict) -> Column:
    """The faults of a JSON text against a schema, empty if it fits; a text that is no JSON has the
    one fault that it is none. Null stays null. Arrow batches; the schema is a plan-time value."""

    @F.pandas_udf("array<string>")
    def check(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> list[str] | None:
            if v is None:
                return None
            try:
                return schema_errors(json.loads(v), schema)
            except ValueError:
                return ["response was not valid JSON"]

        return pd.Series([one(v) for v in values], index=values.index, dtype=object)

    return check(text)
