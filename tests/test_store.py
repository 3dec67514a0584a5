"""From a repository through the catalog to reports, exports and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from coderill import cli, ingest, sinks
from coderill.catalog import Catalog, changed_files, insert_ignore, upsert
from coderill.reports import Reports, of_all
from coderill.schemas import seeds, validate

APP = """
import util
from flask import Flask

@app.route('/api/users')
def users(n: int) -> str:
    if n:
        return util.helper(n)
    return ""
"""


@pytest.fixture
def analysed(spark, repo, tmp_path):
    repo.commit(app_DOT_py=APP, util_DOT_py="import app\ndef helper(x):\n    return x\n", web__client_DOT_ts="fetch('/api/users');\nfunction go() { go(); }\n", requirements_DOT_txt="flask==2.3.0\n")
    repo.commit("Bob", app_DOT_py=APP + "\n", util_DOT_py="import app\ndef helper(x):\n    return x + 1\n", node_modules__dep_DOT_js="function no() {}\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    assert ingest.analyse(spark, catalog, str(repo.path)) == "sample"
    return catalog


def test_whole_way(spark, repo, analysed, tmp_path, capsys):
    r = Reports(analysed, "sample")
    assert {m.path for m in analysed.read("modules", "sample").collect()} == {"app.py", "util.py", "web/client.ts"}
    assert [tuple(x)[1:] for x in r.cycles().collect()] == [(2, "app.py -> util.py -> app.py")]
    assert tuple(r.api_boundaries()["summary"].first()) == (1, 1, 1, 0, 0)
    assert analysed.read("external_dependencies", "sample").count() == 1
    assert {x.language: x.file_count for x in r.polyglot()["languages"].collect()} == {"python": 2, "typescript": 1}
    assert r.quality()["scores"].count() == 1 and r.hotspots(1, 1).count() >= 1 and r.hidden().count() >= 0
    assert r.call_graph()["calls"].columns and r.matrices()["structural"].count() == 2
    before = analysed.read("file_changes", "sample").count()
    ingest.analyse(spark, analysed, str(repo.path))
    assert analysed.read("file_changes", "sample").count() == before
    assert analysed.repos() == ["sample"] and analysed.exists("sample") and not analysed.exists("other")
    assert of_all(analysed, lambda x: x.authors()).select("repo").distinct().count() == 1
    assert analysed.several("authors", ["sample", "missing"]).count() == 2
    base = str(tmp_path / "out.csv")
    assert cli.main(["--store", analysed.root, "show-metrics", "sample", "--export-csv", base, "--export-json", str(tmp_path / "out.json")], spark) == 0
    assert (tmp_path / "out-churn.csv").read_text().startswith("file_path,") and len(json.loads((tmp_path / "out-authors.json").read_text())) == 2
    assert cli.main(["--store", analysed.root, "list"], spark) == 0 and "sample" in capsys.readouterr().out
    assert cli.main(["--store", analysed.root, "compare-repos", "sample", "none"], spark) == 0
    assert cli.main(["--store", analysed.root, "show-metrics", "none"], spark) == 1
    with pytest.raises(FileNotFoundError):
        analysed.read("commits", "none")
    analysed.drop("sample")
    assert analysed.repos() == []


def test_partition_pruning(spark, analysed):
    plan = analysed.read("commits").where(F.col("repo") == "sample")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "sample" in plan


def test_writes(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in insert_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "b"), (2, "c")}
    twice = spark.createDataFrame([(1, "b"), (1, "x"), (1, None)], "k int, v string")
    assert [tuple(r) for r in upsert(old, twice, ["k"]).collect()] == [(1, "x")]
    scan, known = spark.createDataFrame([("c", "p", "h1"), ("c", "q", "h2")], "language string, path string, file_hash string"), spark.createDataFrame([("c", "p", "h1"), ("c", "q", "old")], "language string, path string, file_hash string")
    assert [r.path for r in changed_files(scan, known).collect()] == ["q"]


def test_rules_and_seeds(spark):
    bad = spark.createDataFrame([("b", "a", 1, 0.5), ("a", "b", 1, 1.5), ("a", "b", 1, 0.5)], "file_a string, file_b string, co_change_count bigint, jaccard_similarity double")
    assert validate(bad, "temporal_coupling").count() == 2
    assert seeds(spark, "languages").count() == 8 and seeds(spark, "package_managers").count() == 13
    assert json.loads(sinks.report_document({"x": bad.limit(1)}))["x"][0]["file_a"] == "b"


def test_streaming_refresh(spark, tmp_path):
    from coderill.streaming import refresh

    df = spark.sql("select 1L as commit_id, 'f' as file_path, 2L as lines_added, 1L as lines_deleted, 'M' as change_type, timestamp '2024-02-03' as timestamp")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        refresh.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert [tuple(r) for r in refresh.current(spark, str(tmp_path / "out")).collect()] == [("f", "2024-02", 1, 3)]
        break
    df.withColumn("commit_id", F.lit(2)).write.mode("append").parquet(str(tmp_path / "in"))
    refresh.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in refresh.current(spark, str(tmp_path / "out")).collect()] == [("f", "2024-02", 2, 6)]


def test_calls_and_bases_are_resolved(spark, repo, tmp_path):
    repo.commit(a_DOT_py="from b import Base\n\ndef helper():\n    return 1\n\ndef main():\n    return helper()\n\nclass Kid(Base):\n    pass\n", b_DOT_py="import a\n\nclass Base:\n    pass\n\ndef other():\n    return a.main()\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    ingest.analyse(spark, catalog, str(repo.path))
    r = Reports(catalog, "sample")
    calls = r.call_graph()
    assert {(x.caller, x.callee) for x in calls["calls"].collect()} == {("main", "helper"), ("other", "main")}
    assert [x.name for x in calls["entry_points"].collect()] == ["other"]
    names = {x.id: x.name for x in catalog.read("classes", "sample").collect()}
    assert [(names[x.class_id], names[x.base_class_id]) for x in catalog.read("inheritance", "sample").collect()] == [("Kid", "Base")]


def test_a_class_is_not_its_own_base(spark):
    from coderill.operators.resolve import resolve_classes

    classes = spark.createDataFrame([(1, 1, "Model"), (2, 2, "Model"), (3, 2, "Other")], "id bigint, module_id bigint, name string")
    bases = spark.createDataFrame([(1, 1, "orm.Model"), (2, 2, "Model"), (3, 3, "x.Model"), (4, 3, "Gone"), (5, 3, None)], "id bigint, class_id bigint, base_class_name string")
    assert {r.id: r.base_class_id for r in resolve_classes(bases, classes).collect()} == {1: 2, 2: 1, 3: 2, 4: None, 5: None}


def test_files_that_did_not_change_are_not_parsed_again(spark, repo, tmp_path):
    from coderill.catalog import FACTS

    repo.commit(a_DOT_py="def one():\n    pass\n", b_DOT_py="def two():\n    pass\n", c_DOT_py="def gone():\n    pass\n")
    catalog = Catalog(spark, str(tmp_path / "store"))
    ingest.analyse(spark, catalog, str(repo.path))
    # a mark in the facts of a.py shows whether they were kept
    facts = catalog.facts("sample")
    mark = F.when((F.col("path") == "a.py") & (F.col("entity") == "function"), F.map_concat(F.map_filter("fact", lambda k, v: k != "name"), F.create_map(F.lit("name"), F.lit("kept")))).otherwise(F.col("fact"))
    catalog.write("sample", FACTS, facts.withColumn("fact", mark), strict=False)
    repo.commit(b_DOT_py="def three():\n    pass\n", c_DOT_py=None)
    ingest.analyse(spark, catalog, str(repo.path))
    assert sorted(r.name for r in catalog.read("functions", "sample").collect()) == ["kept", "three"]
    assert sorted(r.path for r in catalog.read("modules", "sample").collect()) == ["a.py", "b.py"]


def test_rows_that_break_rules_leave_the_old_ones(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "store"))
    schema = "file_a string, file_b string, co_change_count bigint, jaccard_similarity double"
    catalog.write("r", "temporal_coupling", spark.createDataFrame([("a", "b", 1, 0.5)], schema))
    with pytest.raises(ValueError):
        catalog.write("r", "temporal_coupling", spark.createDataFrame([("a", "b", 1, 1.5)], schema))
    assert catalog.read("temporal_coupling", "r").first().jaccard_similarity == 0.5 and catalog.repos() == ["r"]


def test_numbers_without_one_task_for_all(spark):
    df = spark.createDataFrame([(k % 3 if k % 4 else None, k) for k in range(40)], "g bigint, v bigint").repartition(5)
    got = ingest.numbered(df, "g", "v").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 41)) and [(r.g, r.v) for r in got] == sorted(((r.g, r.v) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_json_reports_are_what_json_dumps_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", None, [1, 2]), (2, "b", 0.5, None)], "a int, b string, c double, d array<int>").coalesce(1)
    sinks.report_json(df, str(tmp_path / "x.json"))
    rows = [{"a": 1, "b": "ä", "c": None, "d": [1, 2]}, {"a": 2, "b": "b", "c": 0.5, "d": None}]
    assert (tmp_path / "x.json").read_text() == json.dumps(rows, indent=2, ensure_ascii=False)
    sinks.report_json(df.limit(0), str(tmp_path / "y.json"))
    assert json.loads((tmp_path / "y.json").read_text()) == []


def test_example_repositories(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    assert cli.main(["--store", root, "regenerate-examples", "--folder", str(tmp_path / "examples"), "--clean"], spark) == 0
    catalog = Catalog(spark, root)
    sizes = {r: (catalog.read("commits", r).count(), catalog.read("file_changes", r).select("file_path").distinct().count(), catalog.read("authors", r).count()) for r in catalog.repos()}
    assert sizes == {"simple-linear": (5, 3, 1), "multi-author": (7, 3, 3), "high-churn": (14, 3, 1)}
    # a repository without the table that a report takes is left out of all-repository reports
    catalog._fs.delete(catalog._path(catalog._at("authors", "high-churn")), True)
    assert {r.repo for r in of_all(catalog, lambda x: x.table("authors")).select("repo").distinct().collect()} == {"simple-linear", "multi-author"}
