"""Compiled schemas against a plain validator."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from chorale.operators import schema

RECORD = {
    "$schema": "x", "title": "t", "type": "object", "additionalProperties": False, "required": ["version", "title", "artists", "ids"],
    "properties": {
        "version": {"type": "integer", "const": 1}, "title": {"type": "string", "minLength": 1, "maxLength": 5}, "artists": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "string", "minLength": 1}},
        "year": {"type": ["integer", "null"], "minimum": 1800, "maximum": 3000}, "share": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1}, "kind": {"enum": ["a", "b", 3, None, True]}, "code": {"type": "string", "pattern": "^[A-Z]{2}"},
        "ids": {"type": "object", "required": ["isrc"], "additionalProperties": {"type": ["string", "null"]}, "properties": {"isrc": {"type": ["string", "null"]}}},
        "tags": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "never": False, "any": True,
    },
    "$defs": {"item": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 1}, "count": {"type": ["number", "null"], "minimum": 0}}}},
}
KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v),
}


def plain(v, s, path="$"):
    out, inner = [], []
    if s is False:
        return [f"{path}: must not be there"]
    if s is True:
        return []
    if "$ref" in s:
        s = RECORD["$defs"][s["$ref"].rpartition("/")[2]]
    number, text, items, members = KINDS["number"](v), isinstance(v, str), isinstance(v, list), isinstance(v, dict)
    same = lambda a, b: type(a) is type(b) and a == b or KINDS["number"](a) and KINDS["number"](b) and a == b
    for word, said in s.items():
        names = said if isinstance(said, list) else [said]
        bad = {
            "type": lambda names=names: not any(KINDS[n](v) for n in names), "const": lambda said=said: not same(v, said), "enum": lambda names=names: not any(same(v, x) for x in names),
            "minimum": lambda said=said: number and v < said, "maximum": lambda said=said: number and v > said, "exclusiveMinimum": lambda said=said: number and v <= said, "exclusiveMaximum": lambda said=said: number and v >= said,
            "minLength": lambda said=said: text and len(v) < said, "maxLength": lambda said=said: text and len(v) > said, "minItems": lambda said=said: items and len(v) < said, "maxItems": lambda said=said: items and len(v) > said,
            "pattern": lambda said=said: text and not re.search(said, v),
        }.get(word, lambda: False)()
        if bad:
            out.append(word)
        if word == "required" and members:
            out += [f"needs {k}" for k in said if k not in v]
        if word == "properties" and members:
            inner += [x for k, t in said.items() if k in v for x in plain(v[k], t, f"{path}.{k}")]
        if word == "additionalProperties" and members:
            others = sorted(set(v) - set(s.get("properties", {})))
            inner += [f"{path}: must not have {k}" for k in others] if said is False else [x for k in others for x in plain(v[k], said, f"{path}.{k}")]
        if word == "items" and items:
            inner += [x for i, y in enumerate(v) for x in plain(y, said, f"{path}[{i}]")]
    return [f"{path}: {w}" for w in out] + inner


def words(text):
    """The keyword behind a text, for those that the plain validator names by keyword."""
    path, _, said = text.partition(": ")
    if said.startswith(("needs ", "must not")):
        return text
    for start, word in (("must be at least", "minimum"), ("must be at most", "maximum"), ("must be above", "exclusiveMinimum"), ("must be below", "exclusiveMaximum"), ("must match", "pattern"), ("must be 1", "const"), ("must be a or b", "enum")):
        if said == start or said.startswith(start + " ") or word in ("const", "enum") and said.startswith(start):
            return f"{path}: {word}"
    if said.startswith("must have at"):
        return f"{path}: {'min' if 'least' in said else 'max'}{'Length' if 'characters' in said else 'Items'}"
    return f"{path}: type"


def test_against_a_plain_validator(spark):
    draw = random.Random(9)
    odd = [None, True, False, 0, 1, 1.0, 1.5, -3, 1799, 3001, 2000, "", "a", "title", "longer", "AB1", [], [""], ["x", None], ["x", "y", "z", "w"], {}, {"isrc": 5}, {"isrc": None, "x": 3, "y": "ok"}, [{"name": "n", "count": -1}, {"count": True}, {"name": "", "z": 1}, 7]]
    records = [{k: draw.choice(odd) for k in [*RECORD["properties"], "extra", "b:c"] if draw.random() < 0.6} for _ in range(300)]
    records += [{"version": 1, "title": "é😀", "artists": ["x"], "ids": {"isrc": "q"}}, [1], "text", None, 3]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    got = {r["i"]: r["v"] for r in df.select("i", schema.violations(F.col("j"), RECORD).alias("v")).collect()}
    for i, r in enumerate(records):
        assert [words(x) for x in got[i]] == plain(r, RECORD), (r, got[i])
    assert got[300] == []


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ("",), ("{}",)], "j string")
    assert [r["v"] for r in df.select(schema.violations(F.col("j"), {"type": "object"}).alias("v")).collect()] == [["$: must be JSON"]] * 3 + [[]]


@pytest.mark.parametrize("bad", [{"oneOf": []}, {"type": "text"}, {"$ref": "#/x"}, {"const": [1]}, {"items": {"$ref": "#/$defs/a"}, "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}])
def test_what_is_not_known_is_an_error(spark, bad):
    with pytest.raises(ValueError, match="schema"):
        schema.violations(F.lit("1"), bad)


def test_a_record_is_parsed_once(spark):
    """However many rules look at it: within lambdas nothing is shared by itself."""
    from chorale.plans.songs import _SCHEMA

    assert schema.violations(F.col("j"), _SCHEMA)._jc.toString().count("try_parse_json") == 1
