"""Column functions, conditions, grains and link parsing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import links, paths, values
from graphloom.operators import checks, conditions, sets, traverse, views
from graphloom.sources import frontmatter


def values_of(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("grain", "expected"),
    [
        (views.Grain("year"), ["2026", None, None, "2026", None]),
        (views.Grain("month"), ["2026-07", None, None, None, None]),
        (views.Grain("day"), ["2026-07-24", None, None, None, None]),
        (views.Grain("initial", 1), ["2", "2", "B", "2", "Å"]),
    ],
)
def test_grain_cuts(spark, grain, expected):
    assert values_of(spark, grain.cut, ["2026-07-24T07:32:00Z", "20264", "banana", " 2026", "Ålesund"]) == expected


def test_conditions_are_two_valued(spark):
    df = spark.createDataFrame([("a", {"people": ["Ada", "Grace"]}), ("b", {"people": []}), ("c", None)], "path string, texts map<string,array<string>>")
    cases = {
        "has": ({"has": "people"}, ["a"]),
        "equals": ({"equals": {"people": "Grace"}}, ["a"]),
        "not": ({"not": {"has": "people"}}, ["b", "c"]),
        "both": ({"has": "people", "not": {"equals": {"people": "Ada"}}}, []),
    }
    for value, expected in cases.values():
        condition = conditions.parse(value)
        assert [r["path"] for r in df.where(condition.column()).collect()] == expected
        assert conditions.parse(condition.to_value()) == condition
    assert df.where(conditions.AnyOf(()).column()).count() == 0
    assert df.where(conditions.AllOf(()).column()).count() == 3
    assert conditions.parse({"what": 1}) is None
    assert conditions.literal_texts([5.0, " x ", None, {"a": 1}, True]) == ["5", "x", "true"]


def test_view_specs_round_trip():
    mapping = {"daily": {"label": "Daily", "group": ["a", "b"], "by": {"initial": 2}, "under": "id:x", "nest": "year", "where": {"has": "a"}}, "tags": {"group": "tags"}}
    assert {n: v.to_mapping() for n, v in views.views_from(mapping | {"bad": {"by": "year"}}).items()} == mapping
    assert views.ViewSpec.parse("due_date", {"group": "x"}).display_label == "Due date"


def test_path_algebra(spark):
    assert values_of(spark, paths.normalize, ["a/./b/../c", "../x/../..", "/a//b", "", ".."]) == ["a/c", "../..", "a/b", "", ".."]
    df = spark.createDataFrame([("d/e.md", "../x.md#p"), ("d/e.md", "/x.md"), ("e.md", "y.md")], "s string, t string")
    assert [r[0] for r in df.select(paths.resolve(F.col("s"), F.col("t"))).collect()] == ["x.md", "x.md", "y.md"]
    assert values_of(spark, paths.is_alias, ["My File", "a.md", ".hidden", "a/b"]) == [True, False, True, False]
    assert values_of(spark, paths.ancestors, ["a/b/c"]) == [["a", "a/b", "a/b/c"]]


def test_texts(spark):
    assert values_of(spark, values.path_to_title, ["x/my_first-file.md", "a.b.md"]) == ["My First File", "A.b"]
    assert values_of(spark, values.slug, ["Hello, World!", "Éa", "--"]) == ["hello-world", "éa", "untitled"]
    assert values_of(spark, values.humanize, ["due_DATE-x"]) == ["Due date x"]
    assert values_of(spark, values.digest, ["abc"]) == ["sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert values_of(spark, values.trimmed, ["  a b "]) == ["a b"]


def test_links_of_metadata_and_prose():
    assert links.parse("[[A|b]]") == links.Link("A", "b", True)
    assert links.parse("[x](a (1).md) and more") == links.Link("a (1).md", "x")
    assert links.parse("[x](<a b.md>)").render() == "[x](<a b.md>)"
    body = "é [[X]] `[[no]]` [a](b.md)\n~~~\n[c](d.md)\n~~~\n"
    assert [(x.target, a, b) for x, a, b in links.body_links(body)] == [("X", 3, 8), ("b.md", 18, 27)]


@given(st.text(alphabet="ab /().#é", min_size=1, max_size=12).map(str.strip).filter(lambda t: t and t.count("(") == 0 and t.count(")") == 0))
@settings(max_examples=60, deadline=None)
def test_rendered_links_parse_back(target):
    assert links.parse(links.Link(target, "l").render()) == links.Link(target, "l")


def test_metadata_types():
    d = frontmatter.parse("a.md", "---\ndate: 2026-07-24\nyes: yes\nn: 5\nf: 5.0\nb: true\n---\nbody")
    assert d["meta"] == {"date": "2026-07-24", "yes": "yes", "n": 5, "f": 5.0, "b": True} and d["body"] == "body"
    assert frontmatter.parse("a.md", "---\nopen")["meta"] is None
    assert frontmatter.parse("a.toml", "x = 1")["meta"] == {"x": 1}
    assert frontmatter.parse("a.json", "[1]")["error"]


def test_roots_of_cycles_are_null(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "path string, parent string")
    assert {r["path"]: r["root"] for r in traverse.spanning_root(df, 5).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None}


def test_check_diff_is_a_bag(spark):
    before = spark.createDataFrame([("a", None), ("a", None), ("b", "1")], "k string, d string")
    after = spark.createDataFrame([("b", "1"), ("c", None)], "k string, d string")
    assert sorted((r["k"], r["change"]) for r in sets.check_diff(before, after).collect()) == [("a", "fixed"), ("a", "fixed"), ("b", "pre_existing"), ("c", "introduced")]


def test_skip_rules_collapse_only_closed_folders(spark):
    rows = [("a/x.txt", False, False), ("a/b/y.txt", False, False), ("c/z.txt", True, False), ("c/w.txt", False, False), ("d/t.txt", False, True), ("top.txt", False, False)]
    files = spark.createDataFrame(rows, "path string, reached boolean, tracked boolean")
    assert sorted(tuple(r) for r in sets.skip_rules(files).collect()) == [("a", "under"), ("c/w.txt", "file"), ("top.txt", "file")]
    assert [r["path"] for r in sets.withheld(files).collect()] == ["d/t.txt"]


def test_manifest_status(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "path string, hash string")
    found = spark.createDataFrame([("a", "2"), ("b", "9"), ("d", "4")], "path string, hash string")
    diff = sets.manifest_diff(listed, found)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"a": "changed", "b": "same", "c": "missing", "d": "extra"}
    assert tuple(sets.manifest_status(diff, listed).first()) == (3, 1, 1, False)


def test_conflicts(spark):
    registry = spark.createDataFrame([("a", "x"), ("b", "y"), ("t", None)], "id string, path string")
    wanted = spark.createDataFrame([("a", "z"), ("c", "y"), ("a", "x"), ("t", "q")], "id string, path string")
    assert {(r["id"], r["path"]): r["conflict"] for r in checks.conflicts(wanted, registry).collect()} == {("a", "z"): "id_taken", ("c", "y"): "path_taken", ("a", "x"): None, ("t", "q"): None}
