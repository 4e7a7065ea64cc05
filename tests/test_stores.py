"""Config lint, ids, stores, remedies, change plans, streams."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import config, identity, remedies
from graphloom.plans import changes
from graphloom.plans.workspace import Workspace
from graphloom.sources import corpus, stores
from graphloom.streaming import incremental

from .test_workspace import corpus as files_of
from .test_workspace import doc


def test_lint():
    meta = {
        "identty": "lazy", "fixity": "everything", "identity": "off", "recycle_bin": "yes", "workspace_id": "a/b", "mine": 1, "spanning": "has",
        "relations": {"has": {"inverse": "of"}, "of": {"cardinality": "many"}}, "fields": {"tags": {"type": "seq", "values": "shut"}}, "metadata": {"formt": "yaml"}, "references": {"label": 1},
        "views": {"a": {"group": "tags", "nest": "year", "by": "yearr", "labl": "x", "where": {}}, "b": 1, "c": {"by": "year"}}, "exports": {"e": {"gate": {"field": "x", "valu": 1}, "view": "a"}, "f": {"gate": {"field": "x", "value": "y"}, "view": "aa"}},
    }
    got = {(i.key, i.kind) for i in config.diagnose(meta)}
    assert got == {
        ("identty", "unknown_key"), ("fixity", "invalid_value"), ("recycle_bin", "invalid_value"), ("workspace_id", "malformed_workspace_id"), ("spanning", "spanning_not_single_parent"), ("fields.tags.values", "invalid_value"),
        ("metadata.formt", "unknown_key"), ("references.label", "invalid_value"), ("views.a.nest", "nest_not_single_valued"), ("views.a.by", "bad_grain"), ("views.a.labl", "unknown_key"), ("views.a.where", "no_condition"), ("views.b", "not_a_mapping"),
        ("views.c.group", "no_grouping"), ("exports.e.gate", "no_gate"), ("exports.e.gate.valu", "gate_unknown_key"), ("exports.f.view", "undeclared_view"),
    }
    assert config.diagnose(config.DEFAULTS) == [] and config.spec_ahead({"spec": 2}) == 2 and config.spec_ahead({"spec": True}) is None
    assert config.effective({"views": {"a": 1, "b": 2}}, {"views": {"b": 3}, "fixity": "off"})["views"] == {"a": 1, "b": 3}


def test_ids_catch_slips(spark):
    good = [identity.mint((), seed=s) for s in range(40)]
    assert all(map(identity.verify, good))
    slips = [g[:i] + c + g[i + 1 :] for g in good[:5] for i in range(7) for c in identity.ALPHABET if c != g[i]]
    swaps = [g[:i] + g[i + 1] + g[i] + g[i + 2 :] for g in good for i in range(5) if g[i] != g[i + 1]]
    assert not any(map(identity.verify, slips + swaps))
    rows = good + slips[:50] + ["", "abc", "AAAAAAA", None]
    df = spark.createDataFrame([(r,) for r in rows], "id string")
    assert [r[0] for r in df.select(identity.is_valid(F.col("id"))).collect()] == [bool(r) and identity.verify(r) for r in rows]


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
@settings(max_examples=80, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = config.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_stores(spark):
    files = {
        "reg.json": json.dumps({"registry": {"k1": "a.md", "k2": None}}),
        "reg.md": doc(registry={"k": "x"}),
        "m.json": json.dumps({"root": "data", "files": [{"path": "x.bin", "hash": "1"}, {"path": "y.bin"}]}),
        "n.json": json.dumps({"root": "data", "files": [{"path": "../x"}]}),
        "terms.json": json.dumps({"vocabulary": {"field": "tags"}, "terms": {"todo": None, "idea": {"retired": True}}}),
        "bin.json": json.dumps({"deleted": [{"from": "a.md", "bin": "bin/1", "body_bin": "bin/2"}]}),
        "data/x.bin": "1",
        "data/sub/z.bin": "2",
        "bin/1": "x",
    }
    raw = files_of(spark, files)
    docs = corpus.documents(raw)
    assert {tuple(r) for r in stores.registry(docs, "reg.json").collect()} == {("k1", "a.md"), ("k2", None)}
    assert [r["path"] for r in stores.fenced_stores(docs, ["reg.md", "reg.json"]).collect()] == ["reg.md"]
    assert sorted(map(str, ((r["manifest"], r["root"], r["path"], r["hash"], r["error"]) for r in stores.manifests(docs).collect()))) == sorted(map(str, [("m.json", "data", "x.bin", "1", None), ("m.json", "data", "y.bin", None, None), ("n.json", "data", None, None, "bad row")]))
    roots = spark.createDataFrame([("data",), ("data/sub",)], "root string")
    assert {tuple(r) for r in stores.covered_files(docs, roots).collect()} == {("data", "x.bin"), ("data/sub", "z.bin")}
    assert {(r["term"], r["retired"]) for r in stores.terms(docs, "terms.json").collect()} == {("todo", False), ("idea", True)}
    assert [tuple(r) for r in stores.missing_bytes(stores.recycle_records(docs, "bin.json"), raw).collect()] == [("a.md", ["bin/2"])]
    links = spark.createDataFrame([("w", "1"), ("w", "2"), ("x", "1"), ("y", "1")], "workspace string, id string")
    known = spark.createDataFrame([("w", "/w", "w"), ("x", "/x", "z")], "workspace string, location string, says string")
    index = spark.createDataFrame([("w", "1")], "workspace string, id string")
    assert {(r["workspace"], r["id"]): r["peer"] for r in stores.peers(links, known, index).collect()} == {("w", "1"): "confirmed", ("w", "2"): "unconfirmed", ("x", "1"): "mismatched", ("y", "1"): "unknown"}


@pytest.fixture(scope="module")
def small(spark):
    files = {
        "index.md": doc(contents=["a.md", "n/b.md"], title="Home"),
        "a.md": doc("to [B](n/b.md#top) and [x](n/bb.md)", part_of="index.md", title="A"),
        "n/b.md": doc("up [A](../a.md)", part_of="../index.md", title="B"),
        "n/stray.md": doc(),
    }
    return Workspace(files_of(spark, files))


def test_offers(small):
    census = small.census.where("resolution = 'broken'")
    got = [(r["offer"], r["detail"]) for r in remedies.retargets(census, small.documents).orderBy("rank").collect()]
    assert got == [("retarget", "n/bb.md -> n/b.md"), ("remove_link", "n/bb.md")]
    orphans = small.check().where("kind = 'orphan'").selectExpr("subject AS path")
    homes = small.spanning.selectExpr("source AS path").distinct()
    assert [r["detail"] for r in remedies.adoptions(orphans, homes).orderBy("rank").collect()] == ["index.md"]
    fixed = remedies.fixed_offers(small.spark.createDataFrame([("dangling_id", "a", "d"), ("id_mismatch", "b", "e"), ("unreadable", "c", "f")], "kind string, doc string, detail string"))
    assert {(r["doc"], r["offer"]) for r in remedies.suggest(fixed).collect()} == {("b", "trust_document")} or {(r["doc"], r["offer"]) for r in remedies.suggest(fixed).collect()} == {("b", "trust_registry")}


def test_change_plans(small, spark):
    ops = {(r["op"], r["path"], r["site"], r["old"], r["new"]) for r in changes.rename(small.census, "n/b.md", "c.md").collect()}
    assert ops == {
        ("rename", "n/b.md", None, "n/b.md", "c.md"),
        ("retarget", "index.md", "contents", "n/b.md", "/c.md"),
        ("retarget", "a.md", "body", "n/b.md#top", "/c.md#top"),
        ("retarget", "c.md", "part_of", "../index.md", "/index.md"),
        ("retarget", "c.md", "body", "../a.md", "/a.md"),
    }
    assert {(r["op"], r["path"]) for r in changes.delete(small.census, "n/b.md", "bin").collect()} == {("recycle", "n/b.md"), ("remove_link", "index.md"), ("dangler", "a.md")}
    assert {(r["op"], r["path"]) for r in changes.reparent(small.census, "n/b.md", "a.md").collect()} == {("remove_link", "index.md"), ("remove_link", "n/b.md"), ("add_link", "a.md"), ("set_link", "n/b.md")}
    assert {(r["op"], r["path"]) for r in changes.retitle(small.census, "n/b.md", "New").collect()} == {("set", "n/b.md"), ("relabel", "a.md")}
    assert changes.create("index.md", "z.md", "Z", spark).count() == 3
    after = changes.next_snapshot(small.files, changes.rename(small.census, "n/b.md", "c.md"))
    assert sorted(r["path"] for r in after.collect()) == ["a.md", "c.md", "index.md", "n/stray.md"]
    states = spark.createDataFrame([("a", "drifted"), ("b", "unrecorded"), ("c", "intact")], "path string, state string")
    assert {tuple(r) for r in changes.stamps(states).collect()} == {("a", "stamp_and_time"), ("b", "stamp")}
    tree = spark.createDataFrame([("x/readme.md",), ("x/index.md",), ("y/z/a.txt",)], "path string")
    assert {tuple(r) for r in changes.mirror(tree).collect()} == {("", "index.md", True), ("x", "x/index.md", False), ("y", "y/index.md", True), ("y/z", "y/z/index.md", True)}


def test_hash_cache(spark):
    kind = "path string, mtime long, size long"
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], kind)
    cache = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "i"), ("z", 1, 1, "j")], kind + ", hash string")
    stale = incremental.stale_hashes(listing, cache)
    assert sorted(r["path"] for r in stale.collect()) == ["b", "c"]
    assert sorted(r["path"] for r in incremental.refreshed(listing, cache, stale.withColumn("hash", F.lit("n"))).collect()) == ["a", "b", "c"]


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/a.md").write_text("---\ntitle: A\n---\n[x](y.md)")
    got = []
    incremental.start(incremental.document_stream(spark, str(tmp_path / "in")), lambda df, n: got.extend(df.select("path", "title").collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [tuple(r) for r in got] == [("d/a.md", "A")]
