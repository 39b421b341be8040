"""Validation of JSON values against the common subset of JSON Schema."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<valid:boolean,errors:array<struct<path:string,message:string>>>"


def type_of(value) -> str:
    """The JSON type; a number without a fraction is an integer."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if isinstance(value, int) or value.is_integer() else "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def matches_type(value, kind: str) -> bool:
    found = type_of(value)
    return found == kind or kind == "number" and found == "integer"


def canonical(value) -> str:
    """The value as compact JSON; equal numbers are written alike, the order of keys counts."""

    def plain(x):
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, list):
            return [plain(y) for y in x]
        return {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else x

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


_ALLOWED: dict[int, tuple[list, frozenset]] = {}


def _allowed(values: list) -> frozenset:
    """The canonical forms of an enum, kept for the list that it was asked for last."""
    kept = _ALLOWED.get(id(values))
    if kept is None or kept[0] is not values:
        if len(_ALLOWED) > 256:
            _ALLOWED.clear()
        kept = _ALLOWED[id(values)] = (values, frozenset(map(canonical, values)))
    return kept[1]


def _errors(schema: dict, value, path: str):
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(matches_type(value, k) for k in kinds):
            yield path, f"expected type {' | '.join(kinds)}, got {type_of(value)}"
            return  # nothing below a wrong type is worth saying
    if schema.get("enum") is not None and canonical(value) not in _allowed(schema["enum"]):
        yield path, "value is not one of the allowed enum values"
    if isinstance(value, dict):
        declared = schema.get("properties") or {}
        yield from ((f"{path}/{k}", "missing required property") for k in schema.get("required") or [] if k not in value)
        for k, sub in declared.items():
            if k in value:
                yield from _errors(sub, value[k], f"{path}/{k}")
        more = schema.get("additionalProperties")
        for k in value if more is False or isinstance(more, dict) else ():
            if k not in declared:
                if more is False:
                    yield f"{path}/{k}", "additional property is not allowed"
                else:
                    yield from _errors(more, value[k], f"{path}/{k}")
    if isinstance(value, list) and schema.get("items"):
        for k, item in enumerate(value):
            yield from _errors(schema["items"], item, f"{path}/{k}")


def validate_input(schema: dict, value) -> dict:
    errors = [{"path": p, "message": m} for p, m in _errors(schema, value, "")]
    return {"valid": not errors, "errors": errors}


def _is_flat(schema: dict) -> bool:
    """Whether ``flat_checks`` says all that there is to say: an object of scalars, by type and enum."""
    subs = (schema.get("properties") or {}).values()
    return (
        schema.get("type") == "object"
        and set(schema) <= {"type", "properties", "required", "additionalProperties"}
        and not isinstance(schema.get("additionalProperties"), dict)
        and all(set(s) <= {"type", "enum"} and not any(isinstance(v, (list, dict)) for v in s.get("enum") or ()) for s in subs)
        and all(k in _FLAT_TYPES for s in subs if "type" in s for k in ([s["type"]] if isinstance(s["type"], str) else s["type"]))
    )


def validate_column(column: Column, schema: dict) -> Column:
    """``validate_input`` for a column of JSON texts; a null or broken text is invalid at the root.

    Texts that satisfy a flat schema are told by expressions; the others, whose errors have to be named, and those of a
    nested schema go through the validator in Arrow batches.
    """
    import pandas as pd

    @F.pandas_udf(RESULT)
    def checked(texts):
        rows = []
        for text in texts:
            try:
                rows.append(validate_input(schema, json.loads(text)))
            except (TypeError, ValueError):
                rows.append({"valid": False, "errors": [{"path": "", "message": "not a JSON text"}]})
        return pd.DataFrame(rows, columns=["valid", "errors"])

    if not _is_flat(schema):
        return checked(column)
    fine = flat_checks(F.try_parse_json(column), schema)
    none = F.struct(F.lit(True).alias("valid"), F.array().cast("array<struct<path:string,message:string>>").alias("errors"))
    return F.when(fine, none).otherwise(checked(F.when(~fine, column)))


_FLAT_TYPES = {"string", "boolean", "null", "number", "integer"}
_VARIANT_TYPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",)}


def flat_checks(column: Column, schema: dict) -> Column:
    """Whether a VARIANT column satisfies a schema of one level (an object of scalars), in expressions only.

    For schemas whose properties are scalars with ``type`` and ``enum``; nested ones need ``validate_column``.
    """
    declared = schema.get("properties") or {}
    kind = F.schema_of_variant(column)
    ok = F.startswith(kind, F.lit("OBJECT"))
    keys = F.map_keys(F.try_variant_get(column, "$", "map<string,variant>"))
    for k in schema.get("required") or []:
        ok = ok & F.array_contains(keys, k)
    if schema.get("additionalProperties") is False:
        ok = ok & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in declared]))) == 0)
    for k, sub in declared.items():
        item, here = F.try_variant_get(column, f"$['{k}']", "variant"), F.lit(True)
        if "properties" in sub or "items" in sub:
            raise ValueError(f"property {k} is nested")
        found = F.schema_of_variant(item)
        if "type" in sub:
            kinds = sub["type"] if isinstance(sub["type"], list) else [sub["type"]]
            tests = []
            for t in kinds:
                number = F.try_variant_get(column, f"$['{k}']", "double")
                numeric = found.isin("BIGINT", "DOUBLE") | F.startswith(found, F.lit("DECIMAL"))
                tests.append(numeric if t == "number" else numeric & (number == F.floor(number)) if t == "integer" else found.isin(*_VARIANT_TYPES.get(t, ("",))))
            here = tests[0]
            for t in tests[1:]:
                here = here | t
        if "enum" in sub:
            here = here & F.to_json(item).isin([canonical(v) for v in sub["enum"]])
        ok = ok & F.when(F.array_contains(keys, k), F.coalesce(here, F.lit(False))).otherwise(True)
    return F.coalesce(ok, F.lit(False))
