import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import condition, match, selection

ROWS = [(1, "GET", "/a/1", "10.0.0.5", 5.0, None), (2, "POST", "/login", "10.0.1.9", 50.0, "x"), (3, "GET", "/b*c", "192.168.0.1", None, "y")]
SCHEMA = "id long, method string, path string, ip string, value double, note string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("tests", "ids"),
    [
        ({"method": "GET"}, {1, 3}), ({"method": ["GET", "POST"]}, {1, 2, 3}), ({"path": "/a/*"}, {1}), ({"path|contains": "log"}, {2}), ({"path|re": "^/[ab]"}, {1, 3}),
        ({"value|gte": 5}, {1, 2}), ({"value|gt": 5}, {2}), ({"ip|cidr": "10.0.0.0/23"}, {1, 2}), ({"ip|cidr": "10.0.0.0/24"}, {1}), ({"note": "x", "method": "POST"}, {2}), ({}, {1, 2, 3}),
    ],
)
def test_selections(rows, tests, ids):
    assert {r["id"] for r in rows.where(selection(tests)).collect()} == ids


@pytest.mark.parametrize(
    ("text", "ids"),
    [("a", {1, 3}), ("not a", {2}), ("a and b", {1}), ("a or c and b", {1, 3}), ("(a or c) and not b", {2, 3}), ("1 of them", {1, 2, 3}), ("all of them", set()), ("any of a*", {1, 3}), ("2 of them", {1})],
)
def test_conditions(rows, text, ids):
    named = {"a": selection({"method": "GET"}), "b": selection({"path": "/a/*"}), "c": selection({"method": "POST"})}
    assert {r["id"] for r in rows.where(condition(text, named)).collect()} == ids


@pytest.mark.parametrize("text", ["", "a and", "nope", "(a", "a b"])
def test_bad_conditions_are_refused(spark, text):
    with pytest.raises(ValueError):
        condition(text, {"a": F.lit(True)})


def test_match_gives_a_row_for_each_rule(rows):
    rules = [{"id": "x", "level": "low", "selections": {"s": {"method": "GET"}}, "condition": "s"}, {"id": "y", "level": "high", "selections": {"s": {"note": "y"}}, "condition": "s"}]
    assert sorted((r["id"], r["rule_id"]) for r in match(rows, rules).collect()) == [(1, "x"), (3, "x"), (3, "y")]


def test_rule_files_are_loaded_and_bad_ones_skipped(spark, tmp_path):
    import json

    from tidemark.operators.rules import load_rule_folder, match

    good = {"id": 7, "selections": {"a": {"ip|cidr": "2001:db8::/32"}, "b": {"msg|base64": "evil"}, "c": {"actor.name": "bob"}}, "condition": "1 of them"}
    (tmp_path / "good.json").write_text(json.dumps([good]))
    (tmp_path / "no_condition.json").write_text('{"id": "x", "selections": {}}')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "unknown.json").write_text('{"id": "y", "selections": {}, "condition": "nothing"}')
    rules, skipped = load_rule_folder(spark, str(tmp_path))
    assert [r["id"] for r in rules] == ["7"] and len(skipped) == 3
    rows = [(1, "2001:db8::1", "", ("x",)), (2, "10.0.0.1", "ZXZpbCBjb2Rl", ("x",)), (3, "nonsense", "no base64!", ("bob",)), (4, "::1", "", ("x",)), (5, None, None, None)]
    df = spark.createDataFrame(rows, "i int, ip string, msg string, actor struct<name:string>")
    assert sorted(r["i"] for r in match(df, rules).collect()) == [1, 2, 3]
