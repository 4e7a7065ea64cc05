"""The pipeline and its stages, and the library without this subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as p

    from graphloom.llm import decontaminate, jaccard, packing, secrets, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = out.collect()
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            classes = {r["doc_id"]: r["component_id"] for r in jaccard.linked_classes(docs, 5, 80).collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontaminate.hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in after} == before.keys() - hit
        elif name == "secrets":
            assert all(r["text"] == secrets.redact(before[r["doc_id"]], secrets.find(before[r["doc_id"]].encode())) for r in after) and len(after) == len(before)
        else:
            assert name == "packing" and {r["doc_id"] for r in after} == before.keys()
            assert sorted(map(str, after)) == sorted(map(str, packing.best_fit(docs).collect()))
        if name != "packing":
            assert out.columns == columns and out.count() <= rows
            from graphloom.llm.common import spool

            docs = spool(out, "test")
    assert p.run(spark, SF).count() == len(after)


def test_empty_documents(spark, none, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, odd, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    ids = {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()}
    assert ids == {None, 1, 2, 3, 4, 5, 7, 8}  # 9 is a near copy of 5


def test_all_ten_queries_run(spark):
    from graphloom.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, q in registry.QUERIES.items():
        rows = q(spark, SF).count()
        if name.split("_")[0] in ("op2", "op3", "op4", "op5", "op6", "op9"):
            assert rows == n["documents"], name
        elif name.split("_")[0] in ("op7", "op8"):
            assert rows == n["pages"], name


@pytest.mark.parametrize("name", ["op8_url_filter"])
def test_query_equals_sql(spark, name):
    from graphloom.llm import registry

    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cursor = db.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    at = [columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_the_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(REPO / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
