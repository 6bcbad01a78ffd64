"""Documents against a plain validator of the same schema."""

import copy
import json
import random
import re

from pyspark.sql import functions as F

from boutline.operators import contract as C


def kinds(x):
    if isinstance(x, bool):
        return {"boolean"}
    if isinstance(x, (int, float)):
        return {"number"} | ({"integer"} if float(x).is_integer() else set())
    return {{dict: "object", list: "array", str: "string", type(None): "null"}[type(x)]}


def plain(x, schema, path=""):
    """Violations as ``path: rule``, one rule after another."""
    out, at = [], path or "<root>"
    have = kinds(x)
    if "type" in schema and not have & set([schema["type"]] if isinstance(schema["type"], str) else schema["type"]):
        out.append(f"{at}: type")
    same = lambda a, b: kinds(a) & kinds(b) and a == b
    if "const" in schema and not same(x, schema["const"]):
        out.append(f"{at}: const")
    if "enum" in schema and not any(same(x, e) for e in schema["enum"]):
        out.append(f"{at}: enum")
    if "number" in have:
        out += [f"{at}: {k}" for k, bad in (("minimum", x < schema.get("minimum", x)), ("maximum", x > schema.get("maximum", x))) if bad]
    if "string" in have and "pattern" in schema and not re.search(schema["pattern"], x):
        out.append(f"{at}: pattern")
    into = lambda n: f"{path}/{n}" if path else str(n)
    if "object" in have:
        given = schema.get("properties", {})
        out += [f"{at}: required {n}" for n in schema.get("required", []) if n not in x]
        for n, sub in given.items():
            if n in x:
                out += plain(x[n], sub, into(n))
        more = schema.get("additionalProperties", True)
        for n in sorted(set(x) - set(given)):
            if more is False:
                out.append(f"{at}: additional {n}")
            elif isinstance(more, dict):
                out += plain(x[n], more, into(n))
    if "array" in have:
        if len(x) < schema.get("minItems", 0):
            out.append(f"{at}: minItems")
        if "items" in schema:
            for i, e in enumerate(x):
                out += plain(e, schema["items"], into(i))
    return out


GOOD = {"schema_version": "1.1", "analyzer_version": "a", "match": {"id": "bh_1", "game": "g", "fps": 60, "duration_frames": 100, "outcome": {"0": "win", "1": "loss"}, "outcome_source": None, "death_counts": {"0": 2}},
        "players": [{"slot": 0, "display_name": None, "character": {"id": 3, "name": "x"}}, {"slot": 1}],
        "observations": {"inputs": [{"slot": 0, "frame": 1, "action": "a"}, {"slot": None, "frame": 2, "action": "b"}], "kos": [{"slot": 1, "frame": 9}], "damage": [{"slot": 0, "seconds": 1.5, "estimate": 0.5}]},
        "analysis": {"moments": [{"id": "m_0af", "frame": 3, "kind": "ko", "severity": 5, "feedback": {"verdict": None}}], "metrics": {"0": {"apm": 3}}},
        "provenance": {"parser": "p", "confidence": {"kos": "high"}, "warnings": []}}
VALUES = [None, True, 0, -3, 2.5, 7.0, 10**12, "", "text", "win", "1.1", [], {}, [1, "x"], {"slot": "0", "zz": 1}]


def spots(x, path=()):
    yield path
    if isinstance(x, (dict, list)):
        for k in x if isinstance(x, dict) else range(len(x)):
            yield from spots(x[k], (*path, k))


def broken(rng):
    doc = copy.deepcopy(GOOD)
    for _ in range(rng.randint(1, 3)):
        path = rng.choice(list(spots(doc))[1:])
        at = doc
        for k in path[:-1]:
            at = at[k]
        what = rng.random()
        if what < 0.3:
            del at[path[-1]]
        elif what < 0.45 and isinstance(at, dict):
            at[rng.choice(["extra", "zz", "a b"])] = rng.choice(VALUES)
        else:
            at[path[-1]] = rng.choice(VALUES)
    return doc


def test_schema_errors_equal_a_plain_validator(spark):
    rng = random.Random(3)
    docs = [GOOD] + [broken(rng) for _ in range(400)] + VALUES
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    got = {r.i: list(r.errors) for r in C.schema_errors(spark.createDataFrame(rows, "i int, body string").repartition(4), C.MATCH_DOCUMENT).collect()}
    assert got[0] == [] and sum(bool(e) for e in got.values()) > 300
    for i, d in enumerate(docs):
        assert got[i] == plain(d, C.MATCH_DOCUMENT), json.dumps(d)


def test_no_documents_and_unknown_slots(spark):
    lost = copy.deepcopy(GOOD)
    lost["observations"]["inputs"] += [{"slot": 4, "frame": 1, "action": "a"}, {"slot": 5, "frame": 1, "action": "a"}]
    rows = [(1, None), (2, "{not json"), (3, json.dumps(GOOD)), (4, json.dumps(lost)), (5, "")]
    got = {r.i: list(r.errors) for r in C.valid(spark.createDataFrame(rows, "i int, body string"), C.MATCH_DOCUMENT).collect()}
    assert got == {1: ["<root>: not a document"], 2: ["<root>: not a document"], 3: [], 4: ["input references unknown slot 4"], 5: ["<root>: not a document"]}
    assert C.valid(spark.createDataFrame([], "i int, body string"), C.MATCH_DOCUMENT).filter(F.size("errors") > 0).count() == 0
