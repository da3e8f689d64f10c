"""JSON Schema documents compiled to expressions: each record's violations, found where the record is read.

A schema becomes one Catalyst expression over a VARIANT, which walks objects and arrays with built-in functions alone. Keywords
that say something about validity and aren't known here are an error when the schema is compiled, not passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_LIMITS: dict[str, tuple[str, Callable[[Column, float], Column]]] = {
    "minimum": ("must be at least", lambda x, n: x < n), "maximum": ("must be at most", lambda x, n: x > n),
    "exclusiveMinimum": ("must be above", lambda x, n: x <= n), "exclusiveMaximum": ("must be below", lambda x, n: x >= n),
}


def violations(json: Column, schema: dict) -> Column:
    """Array of texts `path: what it must be`, in the order of the schema; empty for a valid record.

    json: a text. Paths are of keys and places, $ for the record itself. A text that isn't JSON, or null, has one violation. Known: $ref to
    #/$defs, type, const, enum, limits of numbers, lengths, pattern, items, required, properties and additionalProperties.
    """
    told = lambda root: F.when(root.isNull(), F.array(F.lit("$: must be JSON"))).otherwise(_checked(root, schema, schema, F.lit("$"), ()))
    return _bound(F.try_parse_json(json), told)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is named there: expressions with lambdas share nothing by themselves."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _checked(v: Column, schema: dict | bool, root: dict, path: Column, seen: tuple[str, ...]) -> Column:
    if isinstance(schema, bool):
        return _told({} if schema else {"must not be there": F.lit(True)}, path)
    if "$ref" in schema:
        name = schema["$ref"]
        if not name.startswith("#/$defs/") or name in seen:
            raise ValueError(f"schema: $ref {name!r} isn't a definition, or is of itself")
        schema, seen = {**root["$defs"][name.removeprefix("#/$defs/")], **{k: x for k, x in schema.items() if k != "$ref"}}, (*seen, name)
    seen_kind = F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"), path.alias("path"))
    return _bound(seen_kind, lambda x: _bound(_views(x["v"], x["kind"], x["path"]), lambda y: _held(y, schema, root, seen)))


def _views(v: Column, kind: Column, path: Column) -> Column:
    """A value and what it is as a number, text, list or object; null where it isn't one."""
    return F.struct(
        v.alias("v"), kind.alias("kind"), path.alias("path"), F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double")).alias("number"),
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"), F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).alias("items"),
        F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")).alias("members"),
    )


def _held(views: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
    v, kind, path, number, text, items, members = (views[c] for c in ("v", "kind", "path", "number", "text", "items", "members"))
    rules, inner = {}, []
    for word, said in schema.items():
        if word == "type":
            names = [said] if isinstance(said, str) else said
            rules[f"must be {' or '.join(names)}"] = ~_any(_of_kind(n, kind, number) for n in names)
        elif word in ("const", "enum"):
            allowed = [said] if word == "const" else said
            rules[f"must be {' or '.join(_shown(x) for x in allowed)}"] = ~_any(_equals(x, kind, number, text, v) for x in allowed)
        elif word in _LIMITS:
            says, fails = _LIMITS[word]
            rules[f"{says} {said}"] = fails(number, said)
        elif word in ("minLength", "maxLength"):
            rules[f"must have at {'least' if word[:3] == 'min' else 'most'} {said} characters"] = F.length(text) < said if word[:3] == "min" else F.length(text) > said
        elif word in ("minItems", "maxItems"):
            rules[f"must have at {'least' if word[:3] == 'min' else 'most'} {said} items"] = F.size(items) < said if word[:3] == "min" else F.size(items) > said
        elif word == "pattern":
            rules[f"must match {said}"] = ~text.rlike(said)
        elif word == "required":
            rules |= {f"needs {k}": ~F.map_contains_key(members, k) for k in said}
        elif word == "properties":
            inner += [F.when(F.map_contains_key(members, k), _checked(_member(members, F.lit(k)), s, root, F.concat(path, F.lit(f".{k}")), seen)) for k, s in said.items()]
        elif word == "additionalProperties":
            others = F.array_sort(F.array_except(F.map_keys(members), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")))
            if said is False:
                inner.append(F.transform(others, lambda k: F.concat(path, F.lit(": must not have "), k)))
            elif said is not True:
                inner.append(F.flatten(F.transform(others, _each_key(members, said, root, path, seen))))
        elif word == "items":
            inner.append(F.flatten(F.transform(items, _each_item(said, root, path, seen))))
        elif word not in _NOTES:
            raise ValueError(f"schema: keyword {word!r} isn't known")
    none = F.array().cast("array<string>")
    return F.concat(_told(rules, path), *(F.coalesce(x, none) for x in inner))


def _each_item(schema: dict | bool, root: dict, path: Column, seen: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    return lambda x, i: _checked(_known(x), schema, root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen)


def _each_key(members: Column, schema: dict, root: dict, path: Column, seen: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda k: _checked(_member(members, k), schema, root, F.concat(path, F.lit("."), k), seen)


def _member(members: Column, key: Column) -> Column:
    return _known(F.try_element_at(members, key))


def _known(v: Column) -> Column:
    """A JSON null is one, not a missing value."""
    return F.coalesce(v, F.parse_json(F.lit("null")))


def _told(rules: dict[str, Column], path: Column) -> Column:
    """Texts of the rules that hold."""
    held = [F.when(F.coalesce(c, F.lit(False)), F.concat(path, F.lit(f": {n}"))) for n, c in rules.items()]
    return F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _of_kind(name: str, kind: Column, number: Column) -> Column:
    known = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": kind.rlike(_NUMBER), "integer": number == F.floor(number),
    }
    if name not in known:
        raise ValueError(f"schema: type {name!r} isn't known")
    return known[name]


def _shown(x: object) -> str:
    return {True: "true", False: "false", None: "null"}.get(x, str(x)) if x is None or isinstance(x, bool) else str(x)


def _equals(x: object, kind: Column, number: Column, text: Column, v: Column) -> Column:
    if x is None:
        return kind == "VOID"
    if isinstance(x, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == x)
    if isinstance(x, (int, float)):
        return number == float(x)
    if isinstance(x, str):
        return text == x
    raise ValueError("schema: const and enum are of plain values")
