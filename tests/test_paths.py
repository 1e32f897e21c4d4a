"""Kinds at paths of JSON texts, against a walk through the parsed texts."""

import json
from collections import Counter

import pytest

from loomline.operators import paths

TEXTS = [
    '{"a": 1, "b": [1, 2.5, null, "x"], "c": {"d": true}}', '{"a": "1", "b": [], "c": null}', '{"a": null, "c": {"d": false, "e f": {"g.h": [[1], [[2]]]}}}',
    '{"a": 7, "b": {"0": 1}, "q\\"\\\\": 0}', "[1, 2, 3]", '"text"', "12", "null", "{}", "[]", '{"a": 1e3}', '{"a": 12345678901234567890}', '{"é": -5}',
]
BROKEN = [None, "", "{", '{"a": 1', "nul", '{"a": 1, "a": 2}']


def _kind(v):
    if isinstance(v, int) and not isinstance(v, bool):
        return "integer" if -(1 << 63) <= v < 1 << 63 else "number"
    return {type(None): "null", bool: "boolean", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def _step(key):
    return f".{key}" if key.isascii() and key.replace("_", "a").isalnum() else '."' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _walk(v, path, above, out, parents):
    out[path, _kind(v)] += 1
    parents[path] = above
    for step, x in [("[*]", x) for x in v] if isinstance(v, list) else [(_step(k), x) for k, x in v.items()] if isinstance(v, dict) else ():
        _walk(x, path + step, (path, _kind(v)), out, parents)


def _want(texts, n):
    out, parents = Counter(), {}
    for t in texts:
        _walk(json.loads(t), "$", None, out, parents)
    rows = {}
    for path, above in parents.items():
        kinds = [(k, out[path, k]) for k in paths.KINDS if out[path, k]]
        told = [k for k, _ in kinds if k != "null"]
        kind = "null" if not told else told[0] if len(told) == 1 else "number" if told == ["integer", "number"] else "mixed"
        rows[path] = (kind, ",".join(f"{k}:{c}" for k, c in kinds), sum(c for _, c in kinds), n if above is None else out[above])
    return rows


def test_json_paths(spark):
    """Every kind, mixed paths, keys to quote, deep arrays, texts without a value; a hot group, a null group, repeated rows, clashing names."""
    rows = [(g, t, 1, "x") for g, times in (("hot", 40), (None, 2), ("one", 1)) for t in TEXTS + BROKEN for _ in range(times)]
    df = spark.createDataFrame([*rows, ("broken", "{", 1, "x")], "above string, v string, n int, path string").repartition(3)
    got = {}
    for r in paths.json_paths(df, "v", ["above"]).toDF("g", "path", "kind", "kinds", "n_values", "n_parents").collect():
        assert (r["g"], r["path"]) not in got
        got[r["g"], r["path"]] = tuple(r)[2:]
    want = {}
    for g, times in (("hot", 40), (None, 2), ("one", 1)):
        want |= {(g, p): row for p, row in _want(TEXTS * times, len(TEXTS + BROKEN) * times).items()}
    assert got == want
    with pytest.raises(ValueError, match="path"):
        paths.json_paths(df, "v", ["path"])


def test_json_paths_of_no_rows_and_long_texts(spark):
    df = spark.createDataFrame([(json.dumps({"a": list(range(100_000))}),), ("[" * 12 + "]" * 12,), ("[" * 5000 + "]" * 5000,)], "t string")
    assert paths.json_paths(df.filter("false"), "t", []).count() == 0
    got = {r["path"]: (r["kind"], r["n_values"], r["n_parents"]) for r in paths.json_paths(df, "t", []).collect()}
    assert got["$"] == ("mixed", 2, 3) and got["$.a[*]"] == ("integer", 100_000, 1) and got["$" + "[*]" * 11] == ("array", 1, 1)
    assert len(got) == 14


@pytest.mark.parametrize("kinds,want", [(["null"], "null"), (["null", "string"], "string"), (["integer", "number"], "number"), (["array", "object"], "mixed")])
def test_merged(spark, kinds, want):
    assert spark.createDataFrame([(kinds,)], "k array<string>").select(paths.merged(paths.F.col("k"))).first()[0] == want
