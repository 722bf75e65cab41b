"""Schemas of drafts: from a Spark type to a JSON schema and back, and a reader that names the path of every fault.

A text is parsed once into a variant and walked along the type; nothing is coerced, so a number in quotes is a fault and not a number. The
walk is one expression of the text: it has as many branches as the type has fields, and arrays are walked element by element.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of JSON types by Spark type, with the format that tells types of one name apart (fixed values of the JSON schema language).
SCALARS = {
    T.StringType(): ("string", None), T.BooleanType(): ("boolean", None), T.IntegerType(): ("integer", "int32"), T.LongType(): ("integer", "int64"), T.DoubleType(): ("number", None),
    T.TimestampType(): ("string", "date-time"), T.DateType(): ("string", "date"),
}

#: Keys that a strict schema does without (fixed values).
ANNOTATIONS = ["$defs", "default", "description", "examples", "exclusiveMaximum", "exclusiveMinimum", "format", "maxItems", "maxLength", "maximum", "minItems", "minLength", "minimum", "pattern", "title", "uniqueItems"]

FAULT = "array<struct<path:string,fault:string>>"


class SchemaError(ValueError):
    """A schema that no Spark type stands for."""


def json_schema(kind: T.DataType, nullable: bool = False) -> dict[str, Any]:
    """The JSON schema of a type: all fields required, no others; fields that may be null say so."""
    if isinstance(kind, T.StructType):
        properties = {f.name: json_schema(f.dataType, f.nullable) for f in kind}
        out = {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.MapType) and kind.keyType == T.StringType():
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType, kind.valueContainsNull)}
    elif kind in SCALARS:
        name, form = SCALARS[kind]
        out = {"type": name} | ({"format": form} if form else {})
    else:
        raise SchemaError(f"{kind.simpleString()} has no JSON schema")
    return out | ({"type": [out["type"], "null"]} if nullable else {})


def inlined(schema: Mapping[str, Any]) -> dict[str, Any]:
    """``schema`` with every ``$ref`` replaced by what it names; one that names itself can't be a type."""
    held = schema.get("$defs", {})

    def walk(node: Any, inside: frozenset[str]) -> Any:
        if isinstance(node, list):
            return [walk(x, inside) for x in node]
        if not isinstance(node, Mapping):
            return node
        if "$ref" in node:
            name = str(node["$ref"]).split("/")[-1]
            if name in inside or name not in held:
                raise SchemaError(f"{node['$ref']} can't be inlined")
            return walk(held[name], inside | {name})
        return {k: walk(v, inside) for k, v in node.items() if k != "$defs"}

    return walk(dict(schema), frozenset())


def strict(schema: Mapping[str, Any]) -> dict[str, Any]:
    """``schema`` for readers that take no annotations: inlined, every object closed, every property required."""

    def walk(node: Any, names: bool = False) -> Any:
        if isinstance(node, list):
            return [walk(x) for x in node]
        if not isinstance(node, Mapping):
            return node
        if names:  # a table of properties: its keys are names, not words of the language
            return {k: walk(v) for k, v in node.items()}
        out = {k: walk(v, k == "properties") for k, v in node.items() if k not in ANNOTATIONS and k != "required"}
        return out | ({"type": out.get("type", "object"), "additionalProperties": False, "required": list(out["properties"])} if "properties" in out else {})

    return walk(inlined(schema))


def data_type(schema: Mapping[str, Any]) -> tuple[T.DataType, bool]:
    """The type that a JSON schema describes, and whether it may be null. ``anyOf`` with null, ``enum`` of strings and ``$ref`` are understood."""
    node = inlined(schema)
    options = [x for x in node.get("anyOf", []) if x.get("type") != "null"]
    if options:
        if len(options) > 1:
            raise SchemaError("more than one type fits")
        return data_type(options[0])[0], len(node["anyOf"]) > 1 or data_type(options[0])[1]
    names = node.get("type", "string" if "enum" in node else None)
    names = names if isinstance(names, list) else [names]
    nullable, names = "null" in names, [n for n in names if n != "null"]
    if len(names) != 1:
        raise SchemaError(f"no single type in {names}")
    name, form = names[0], node.get("format")
    if name == "object" and "properties" in node:
        needed = node.get("required", [])
        fields = {k: data_type(v) for k, v in node["properties"].items()}
        return T.StructType([T.StructField(k, t, n or k not in needed) for k, (t, n) in fields.items()]), nullable
    if name == "object" and isinstance(node.get("additionalProperties"), Mapping):
        value, empty = data_type(node["additionalProperties"])
        return T.MapType(T.StringType(), value, empty), nullable
    if name == "array" and "items" in node:
        item, empty = data_type(node["items"])
        return T.ArrayType(item, empty), nullable
    by_form = {v: k for k, v in SCALARS.items()} | {("integer", None): T.LongType()}
    kind = by_form.get((name, form)) or by_form.get((name, None))
    if kind is None:
        raise SchemaError(f"{name} is no type")
    return kind, nullable


def _kind(v: Column) -> Column:
    """``object, array, string, number, boolean, null`` of a variant; null where there is none."""
    told = F.schema_of_variant(v)
    first = F.regexp_extract(told, "^([A-Z]+)", 1)
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}
    return F.when(v.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), first), first))


def _one(path: Column, fault: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (fault if isinstance(fault, Column) else F.lit(fault)).alias("fault")))


def _walk(v: Column, kind: T.DataType, nullable: bool, path: Column) -> Column:
    none = F.array().cast(FAULT)
    seen = _kind(v)
    wanted = "object" if isinstance(kind, (T.StructType, T.MapType)) else "array" if isinstance(kind, T.ArrayType) else {"integer": "number"}.get(SCALARS[kind][0], SCALARS[kind][0])
    absent = none if nullable else _one(path, "is missing")
    out = F.when(v.isNull() | (seen == "null"), absent).when(seen != wanted, _one(path, F.concat(seen, F.lit(f", not {wanted}"))))
    get = lambda where, t: F.try_variant_get(v, where, t)
    if isinstance(kind, T.StructType):
        names = F.array(*[F.lit(n) for n in kind.fieldNames()])
        strange = F.array_sort(F.array_except(F.map_keys(get("$", "map<string,variant>")), names))
        parts = [F.transform(strange, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown field").alias("fault")))]
        parts += [_walk(get(f"$.{f.name}", "variant"), f.dataType, f.nullable, F.concat(path, F.lit(f".{f.name}"))) for f in kind]
        return out.otherwise(F.concat(*parts))
    if isinstance(kind, T.ArrayType):
        inside = F.transform(get("$", "array<variant>"), lambda x, i: _walk(x, kind.elementType, kind.containsNull, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return out.otherwise(F.flatten(inside))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(get("$", "map<string,variant>"))
        return out.otherwise(F.flatten(F.transform(entries, lambda e: _walk(e["value"], kind.valueType, kind.valueContainsNull, F.concat(path, F.lit("."), e["key"])))))
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return out.when(F.try_to_timestamp(get("$", "string")).isNull(), _one(path, f"is no {SCALARS[kind][1]}")).otherwise(none)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        exact = get("$", "decimal(38,9)")
        whole = exact.isNotNull() & (exact == F.floor(exact)) & exact.between(*((-(2**31), 2**31 - 1) if isinstance(kind, T.IntegerType) else (-(2**63), 2**63 - 1)))
        return out.when(~F.coalesce(whole, F.lit(False)), _one(path, f"is no {SCALARS[kind][1]}")).otherwise(none)
    return out.otherwise(none)


def faults(text: Column, kind: T.DataType) -> Column:
    """``array<struct<path, fault>>`` of a JSON text: empty if it is what ``kind`` says. Paths start at ``$``; a null text is no JSON."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), _one(F.lit("$"), "is no JSON")).otherwise(_walk(v, kind, False, F.lit("$")))


def read_draft(text: Column, kind: T.StructType) -> Column:
    """``struct(draft, faults)``: the draft is null unless nothing is wrong with the text."""
    found = faults(text, kind)
    return F.struct(F.when(F.size(found) == 0, F.from_json(text, kind)).alias("draft"), found.alias("faults"))
