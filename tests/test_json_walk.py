"""Leaves of JSON against a plain recursive walk, and the best text of a row."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions.text import content_score
from quillmesh.operators.json_walk import best_texts, json_leaves, nesting, scored_texts
from quillmesh.sources.reconstruct import score_text

SCHEMA = "id long, j string"
ODD = ['{"a": {"b c": [1, "x"]}, "d": "y", "e": {}, "f": null, "g": [[], [true]]}', '"top"', "[]", "7", "null", "bad{", "[[[[", "", None, '{"t": "a \\"[{\\" b\\\\"}', '{"q\\"r": 1, "": 2, "é": 3, "1a": 4}', '{"a": 1, "a": 2}']


def walk(v, path="$", key=None):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            plain = k.isascii() and k.replace("_", "a").isalnum() and not k[0].isdigit() if k else False
            name = k if plain else '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'
            yield from walk(x, f"{path}.{name}", k)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    elif isinstance(v, bool):
        yield path, key, "boolean", str(v).lower()
    elif isinstance(v, (int, float)):
        yield path, key, "number", str(v)
    else:
        yield path, key, {str: "string", type(None): "null", dict: "object", list: "array"}[type(v)], v if isinstance(v, str) or v is None else json.dumps(v)


def once(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated name")
    return out


def expected(texts):
    out = []
    for i, t in enumerate(texts):
        try:
            out += [(i, *leaf) for leaf in walk(json.loads(t or "", object_pairs_hook=once))]
        except ValueError:
            pass
    return sorted(out, key=str)


def found(spark, texts, **more):
    rows = json_leaves(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "j", **more)
    return sorted((tuple(r) for r in rows.select("id", "path", "key", "kind", "value").collect()), key=str)


def test_odd_texts(spark):
    assert found(spark, ODD) == expected(ODD)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text("ab\\\"[]{} \né", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab\\\"_1 [", max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=20, max_size=40))
def test_any_values(spark, values):
    texts = [json.dumps(v) for v in values]
    assert found(spark, texts) == expected(texts)


def test_deep_values_are_written_in_between(spark):
    deep = "[" * 19 + '"x"' + "]" * 19
    assert found(spark, [deep, '{"a": 1}']) == [(0, "$" + "[0]" * 19, None, "string", "x"), (1, "$.a", "a", "number", "1")]


def test_what_is_deeper_than_asked_comes_closed(spark):
    assert found(spark, ['{"a": {"b": [1]}, "c": 2}'], depth=1) == [(0, "$.a", "a", "object", '{"b":[1]}'), (0, "$.c", "c", "number", "2")]


def test_what_follows_the_first_value_is_passed_over(spark):
    assert found(spark, ["{} {}", "[1] " + "[" * 100]) == [(0, "$", None, "object", "{}"), (1, "$[0]", None, "number", "1")]


def test_long_texts_with_many_escapes(spark):
    text = json.dumps({"t": 'a"\n[' * 200_000})
    rows = spark.createDataFrame([(1, text)], SCHEMA)
    assert rows.select(nesting(rows.j)).first()[0] == 1
    assert json_leaves(rows, "j").first()["value"] == 'a"\n[' * 200_000


def test_repeated_rows_empty_tables_and_names(spark):
    assert len(found(spark, ['{"a": 1}'] * 3)) == 3
    assert found(spark, []) == []
    odd = spark.createDataFrame([('[1]', 2, 3)], "j string, pos int, `_v` int")
    assert json_leaves(odd, "j").columns == ["pos", "_v", "path", "key", "kind", "value"]
    assert json_leaves(odd, "j").first()["pos"] == 2
    assert [tuple(r) for r in json_leaves(odd.select("j"), "J").collect()] == [("$[0]", None, "number", "1")]
    assert json_leaves(odd.select(odd.j.alias("value")), "value").first()["value"] == "1"
    for name in ("path", "Value"):
        with pytest.raises(ValueError):
            json_leaves(spark.createDataFrame([("[1]", 1)], f"j string, {name} int"), "j")


def test_best_text(spark):
    prose = "one two three four five six seven " * 3
    rows = spark.createDataFrame([(1, json.dumps({"x": prose + "more", "body": prose})), (2, json.dumps({"b": prose, "a": prose})), (3, '{"body": "short"}'), (4, json.dumps({"l": [prose], "text": ["no", prose + "longer"]}))], SCHEMA)
    got = {r["id"]: (r["path"], r["score"]) for r in best_texts(scored_texts(json_leaves(rows, "j")), "id").collect()}
    n = len(prose)
    assert got == {1: ("$.body", n + 1000), 2: ("$.a", n), 4: ("$.text[1]", n + 6)}


def test_no_python_in_the_plan(spark, data, capsys):
    from quillmesh import catalog

    catalog.QUERIES["document_json_best"](spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Scan parquet") == 2  # once in the tree, once in the details


def test_texts_are_scored_once(spark):
    """The best text of a row scores each text in one place of the plan; rows whose texts all score 0 have none."""
    rows = spark.createDataFrame([(1, '{"a":"' + "word " * 20 + '","b":"x"}'), (2, '{"a":"x"}'), (None, '{"body":"' + "long " * 20 + '"}')], "k long, j string")
    best = best_texts(scored_texts(json_leaves(rows, "j", depth=1)), "k")
    assert sorted((r["k"] or 0, r["path"]) for r in best.collect()) == [(0, "$.body"), (1, "$.a")]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_extract_all" not in line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter"))
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1


def test_scores_without_signs_are_those_of_the_patterns(spark):
    """Texts without a pattern's signs aren't searched for it; scores are those of the parse stage's own rule."""
    pieces = ["<p>", "</p>", "<", "</", "# a", "\n", "\n## b\n", "[a](b)", "](", "**b**", "**", "- x", "word ", "é ", ">", "<1>", "#"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1_500)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", content_score(F.col("t")).alias("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains(" in plan.lower()
    for r in out.collect():
        assert (r["s"]["kind"], r["s"]["score"]) == score_text(r["t"]), r["t"]
