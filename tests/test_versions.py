"""Versioned index tables, refreshes and cascade deletion, with jobs that are killed between steps."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.sources import deletion, versions
from lodestone.sources.versions import RUNS, VersionedTable, index_actions, point_id, refresh

EVIDENCE = "content_hash string, table_id string, table_type string, text string, point_id string, embedding array<double>"
DOCS = "content_hash string, lines array<string>, point_id int"


def docs(spark, rows):
    return spark.createDataFrame([(h, t, 1) for h, t in rows], DOCS)


def extract(documents):
    each = documents.select("content_hash", F.posexplode("lines").alias("n", "text"))
    return each.select("content_hash", F.concat_ws("-", "content_hash", "n").alias("table_id"), F.when(F.col("n") % 2 == 0, "structured").alias("table_type"), "text")


def embed(rows):
    return rows.withColumn("embedding", F.array(F.length("text").cast("double")))


def tables(spark, path):
    return VersionedTable(spark, f"{path}/tables", EVIDENCE), VersionedTable(spark, f"{path}/runs", RUNS)


def texts(table):
    return sorted((r["content_hash"], r["text"]) for r in table.read().collect())


def test_point_ids_are_uuids_by_name(spark):
    names = ["a", "table-1", "", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(point_id(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_versions_switch_and_untouched_buckets_stay(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "content_hash string, n int")
    assert table.read().count() == 0 and table.manifest() == (0, {})
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "content_hash string, n int")
    assert table.replace(rows, rows) == 1
    first = table.manifest()[1]
    change = spark.createDataFrame([("a", 9)], "content_hash string, n int")
    version, staged = table.staged(change, change)  # killed before the switch
    assert sorted(r["n"] for r in table.read().collect()) == [1, 1, 2]
    assert table.replace(change, change) == version == 2
    assert sorted(r["n"] for r in table.read().collect()) == [2, 9]
    assert set(table.manifest()[1].values()) & set(first.values())  # b's bucket is the old folder
    with pytest.raises(Exception, match="(?i)exists"):
        table.commit(2, staged)  # another writer had that version
    table.delete(spark.createDataFrame([("b",)], "content_hash string"))
    assert [r["n"] for r in table.read().collect()] == [9] and len(table.manifest()[1]) == 1
    assert table.of(change.select("content_hash")).count() == 1


def test_refresh_reuses_cleans_and_survives(spark, tmp_path):
    table, runs = tables(spark, tmp_path)
    two = docs(spark, [("h1", ["x", "y"]), ("h2", []), (None, ["z"])])
    got = {r["content_hash"]: (r["action"], r["status"], r["evidence_count"]) for r in refresh(table, runs, two, extract, embed).collect()}
    assert got == {"h1": ("index", "indexed", 2), "h2": ("index", "no_evidence", 0)}
    assert {r["point_id"] for r in table.read().collect()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, f"h1-{n}")) for n in (0, 1)}
    assert runs.read().where("content_hash = 'h1'").first()["counts"] == {"": 1, "structured": 1}

    again = {r["content_hash"]: r["action"] for r in refresh(table, runs, two, extract, embed).collect()}
    assert again == {"h1": "reuse", "h2": "reuse"} and table.manifest()[0] == 1

    changed = docs(spark, [("h1", ["new"]), ("h3", ["w"])])

    def broken(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        refresh(table, runs, changed, extract, broken, force=True)
    assert texts(table) == [("h1", "x"), ("h1", "y")]  # the old version is readable
    assert {r["content_hash"]: r["status"] for r in runs.read().collect()} == {"h1": "indexing", "h2": "no_evidence", "h3": "indexing"}
    for _ in range(2):
        refresh(table, runs, changed, extract, embed).collect()
        assert texts(table) == [("h1", "new"), ("h3", "w")]
        assert {r["content_hash"]: r["status"] for r in runs.read().collect()} == {"h1": "indexed", "h2": "no_evidence", "h3": "indexed"}
    assert refresh(table, runs, docs(spark, []), extract, embed).count() == 0


def test_actions_of_documents(spark):
    documents = spark.createDataFrame([(h,) for h in ("new", "done", "lost", "none", "found", "half", "done", None)], "content_hash string")
    runs = spark.createDataFrame([("done", "indexed"), ("lost", "indexed"), ("none", "no_evidence"), ("found", "no_evidence"), ("half", "indexing")], "content_hash string, status string")
    evidence = spark.createDataFrame([("done",), ("found",), ("half",), ("half",), ("new",)], "content_hash string")
    got = lambda force: {r["content_hash"]: (r["action"], r["stale"]) for r in index_actions(documents, runs, evidence, force).collect()}
    assert got(False) == {"new": ("index", False), "done": ("reuse", False), "lost": ("index", False), "none": ("reuse", False), "found": ("index", True), "half": ("index", True)}
    assert got(True) == {"new": ("index", True), "done": ("index", True), "lost": ("index", False), "none": ("index", False), "found": ("index", True), "half": ("index", True)}


def test_cascade_reruns_after_a_partial_failure(spark, tmp_path):
    root = tmp_path / "artifacts"
    for h in ("h1", "h2"):
        os.makedirs(root / h / "deep")
        (root / h / "deep" / "a.json").write_text("{}")
        (root / h / "b.md").write_text("x")
    outside = tmp_path / "outside.txt"
    outside.write_text("stays")
    paths = [(h, f"{root}/{h}{p}") for h in ("h1", "h2") for p in ("", "/deep", "/deep/a.json", "/b.md", "/gone")] + [("h1", str(outside)), ("h1", f"{root}/h1/../../outside.txt"), ("h1", str(root)), ("h1", None)]
    files = spark.createDataFrame(paths, "content_hash string, path string")
    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "content_hash string, n int")
    dependent, registry = (VersionedTable(spark, f"{tmp_path}/{n}", "content_hash string, n int") for n in ("chunks", "documents"))
    for t in (dependent, registry):
        t.replace(rows, rows)
    keys = spark.createDataFrame([("h1",), ("h1",), (None,)], "content_hash string")

    def stuck(path):
        if path.endswith("b.md"):
            raise PermissionError(path)
        return deletion.remove_local(path)

    got = {r["path"]: r["result"] for r in deletion.delete_documents(keys, [dependent], registry, files, [str(root)], stuck).collect()}
    assert got[f"{root}/h1/b.md"] == got[f"{root}/h1"] == "failed" and got[f"{root}/h1/deep/a.json"] == got[f"{root}/h1/deep"] == "deleted"
    assert got[f"{root}/h1/gone"] == "missing" and got[str(outside)] == got[str(root)] == "refused"
    assert [r["n"] for r in dependent.read().collect()] == [2] and sorted(r["n"] for r in registry.read().collect()) == [1, 2]

    got = {r["path"]: r["result"] for r in deletion.delete_documents(keys, [dependent], registry, files, [str(root)]).collect()}
    assert got[f"{root}/h1/b.md"] == got[f"{root}/h1"] == "deleted" and got[f"{root}/h1/deep"] == "missing"
    assert [r["n"] for r in registry.read().collect()] == [2] and os.listdir(root) == ["h2"] and outside.exists() and (root / "h2" / "deep" / "a.json").exists()
    assert deletion.delete_documents(keys, [dependent], registry, files, [str(root)]).where("result = 'deleted'").count() == 0
    assert deletion.delete_documents(keys.where("content_hash = 'x'"), [dependent], registry, files, [str(root)]).count() == 0


def test_versions_name_their_statuses():
    assert (versions.INDEXED, versions.NO_EVIDENCE, versions.INDEXING) == ("indexed", "no_evidence", "indexing")
