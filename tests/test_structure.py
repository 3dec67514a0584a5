"""Structure operators on small tables: exact values."""

from coderill.operators import crosslang, ecosystem, graph, matrix, quality, resolve, structural

MODULES = "id bigint, language_id bigint, path string, name string"
IMPORTS = "id bigint, from_module_id bigint, to_module string"


def cycle(spark):
    modules = spark.createDataFrame([(1, 1, "module_a.py", "module_a"), (2, 1, "module_b.py", "module_b"), (3, 1, "module_c.py", "module_c")], MODULES)
    imports = spark.createDataFrame([(1, 1, "module_b"), (2, 2, "module_c"), (3, 3, "module_a")], IMPORTS)
    return modules, imports


def test_cycle(spark):
    modules, imports = cycle(spark)
    rows = structural.instability(modules, imports).collect()
    assert all((r.ca, r.ce, r.instability, r.stability) == (1, 1, 0.5, 0.5) for r in rows) and len(rows) == 3
    found = graph.cycle_table(graph.components(graph.edges(imports, modules))).collect()
    assert [tuple(r) for r in found] == [(1, 3, "module_a.py -> module_b.py -> module_c.py -> module_a.py")]


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(4)
    for n, m in ((8, 10), (14, 22), (10, 0)):
        edges = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)}
        edges = {(a, b) for a, b in edges if a != b}
        reach = set(edges)
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        want = {(a, min(b for b in {x for e in reach for x in e} if (a, b) in reach and (b, a) in reach)) for a, b in reach if a == b}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        assert {tuple(r) for r in graph.components(df).collect()} == want


def test_isolated_unstable_and_external(spark):
    modules = spark.createDataFrame([(1, 1, "a.py", "a"), (2, 1, "b.py", "b"), (3, 1, "c.py", "c")], MODULES)
    imports = spark.createDataFrame([(1, 2, "a"), (2, 2, "a"), (3, 2, "os"), (4, 2, None)], IMPORTS)
    by = {r.path: (r.ca, r.ce, r.instability) for r in structural.instability(modules, imports).collect()}
    assert by == {"a.py": (1, 0, 0.0), "b.py": (0, 2, 1.0), "c.py": (0, 0, 0.0)}


def test_resolution_tiers(spark):
    modules = spark.createDataFrame([(1, 1, "pkg/util.py", "util"), (2, 1, "lib/util.py", "util"), (3, 1, "pkg/core/main.py", "main")], MODULES)
    imports = spark.createDataFrame([(1, 3, "lib/util.py"), (2, 3, "util"), (3, 3, "core/main"), (4, 3, "nothing")], IMPORTS)
    got = {r.to_module: r.module_id for r in resolve.resolve_tiered(imports, modules).collect()}
    assert got == {"lib/util.py": 2, "util": 1, "core/main": 3}
    assert {r.id: r.module_id for r in resolve.resolve_first(imports, modules).collect()} == {1: 2, 2: 1}
    assert resolve.resolve_any(imports, modules).where("id = 2").count() == 2


def test_no_nested_loop(spark):
    modules, imports = cycle(spark)
    plan = resolve.resolve_any(imports, modules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_module_and_histogram(spark):
    modules, _ = cycle(spark)
    functions = spark.createDataFrame([(1, 1, 1, "f", 3), (2, 1, 1, "g", 22)], "id bigint, module_id bigint, class_id bigint, name string, cyclomatic_complexity bigint")
    by = {r.path: tuple(r)[3:] for r in structural.module_complexity(modules, functions).collect()}
    assert by["module_a.py"] == (2, 25, 12.5, 22) and by["module_b.py"] == (0, None, None, None)
    assert {r.bin: r.n for r in structural.histogram(functions).collect()} == {"1-5": 1, "6-10": 0, "11-15": 0, "16-20": 0, "21+": 1}


def test_inheritance_and_calls(spark):
    modules, _ = cycle(spark)
    classes = spark.createDataFrame([(1, 1, "A", "class"), (2, 2, "B", "class"), (3, 3, "C", "class")], "id bigint, module_id bigint, name string, kind string")
    bases = spark.createDataFrame([(1, 2, 1, "A", "inherits"), (2, 3, 2, "B", "inherits"), (3, 3, None, "X", "inherits")], "id bigint, class_id bigint, base_class_id bigint, base_class_name string, relationship_kind string")
    assert {(r.child, r.base) for r in structural.inherits(bases, classes, modules).collect()} == {("B", "A"), ("C", "B"), ("C", None)}
    assert structural.inheritance_stats(bases).first().multiple == 1
    functions = spark.createDataFrame([(1, 1, "method_a"), (2, 2, "method_b"), (3, 3, "method_c")], "id bigint, module_id bigint, name string")
    calls = spark.createDataFrame([(1, 2, 1, "x.method_a", "m"), (2, 3, 2, "method_b", "m"), (3, 3, None, "print", "f")], "id bigint, from_function_id bigint, to_function_id bigint, to_name string, call_kind string")
    assert [r.name for r in structural.entry_points(functions, calls).collect()] == ["method_c"]
    assert {(r.caller, r.callee) for r in structural.call_edges(calls, functions, modules).collect()} == {("method_b", "method_a"), ("method_c", "method_b")}
    assert {r.id: r.to_function_id for r in resolve.resolve_names(calls, functions).collect()} == {1: 1, 2: 2, 3: None}


def test_hidden_dependencies_and_hotspots(spark):
    modules, imports = cycle(spark)
    pairs = spark.createDataFrame([("module_a.py", "module_b.py", 5, 0.9), ("module_a.py", "x.py", 5, 0.9), ("module_b.py", "y.py", 1, 0.9)], "file_a string, file_b string, co_change_count bigint, jaccard_similarity double")
    assert [(r.file_a, r.file_b) for r in quality.hidden_dependencies(pairs, imports, modules).collect()] == [("module_a.py", "x.py")]
    functions = spark.createDataFrame([(1, 1, 6), (2, 2, 1)], "id bigint, module_id bigint, cyclomatic_complexity bigint")
    churned = spark.createDataFrame([("module_a.py", 4), ("module_b.py", 9)], "file_path string, total_commits bigint")
    got = quality.hotspots(modules, functions, structural.instability(modules, imports), churned).collect()
    assert [(r.path, r.hotspot_score) for r in got] == [("module_a.py", 6 * 4 * 3)]


def test_api_matching(spark):
    ends = spark.createDataFrame([(1, "flask", "GET", "/api/users"), (1, "flask", "GET", "/api/products/<int:id>"), (1, "flask", "POST", "/api/x_")], "module_id bigint, endpoint_type string, method string, path string")
    calls = spark.createDataFrame([(1, 1, "fetch", "GET", "/api/users"), (2, 1, "fetch", "POST", "/api/users"), (3, 1, "fetch", "GET", "/other"), (4, 1, "fetch", "POST", "/API/XY")], "id bigint, module_id bigint, call_type string, method string, url_pattern string")
    met = crosslang.matches(calls, ends)
    assert [r.id for r in met.collect()] == [1]
    assert {r.id for r in crosslang.unmatched_calls(calls, met).collect()} == {3, 4}
    assert tuple(crosslang.summary(calls, ends, met).first()) == (3, 4, 1, 2, 2)
    assert {r.id: r.path for r in crosslang.coupling(calls, ends).collect()} == {1: "/api/users", 2: None, 3: None, 4: "/api/x_"}


def test_conflicts(spark):
    deps = spark.createDataFrame(
        [(1, 1, "r.txt", "flask", "==2.3.0"), (2, 1, "p.txt", "flask", "==2.2.0"), (3, 1, "r.txt", "pandas", "==2.0.0"), (4, 1, "p.txt", "pandas", "==1.5.0"), (5, 1, "r.txt", "x", ""), (6, 1, "p.txt", "x", "1"), (7, 2, "q", "same", "1"), (8, 2, "s", "same", "1")],
        "id bigint, package_manager_id bigint, manifest_file string, package_name string, version_spec string",
    )
    assert {(r.package_name, r.conflict_type) for r in ecosystem.conflicts(deps).collect()} == {("flask", "version_mismatch"), ("pandas", "major_version_diff")}


def test_matrix_is_symmetric(spark):
    pairs = spark.createDataFrame([("a/x", "b/y", 3, 0.5), ("a/x", "gone", 3, 0.9)], "file_a string, file_b string, co_change_count bigint, jaccard_similarity double")
    changes = spark.createDataFrame([(1, "a/x", "A"), (1, "b/y", "A"), (1, "top", "A"), (2, "gone", "D")], "commit_id bigint, file_path string, change_type string")
    cells = {tuple(r) for r in matrix.temporal(pairs, changes).collect()}
    assert cells == {(1, 2, 0.5), (2, 1, 0.5)}
    index = matrix.index(changes.where("change_type <> 'D'").selectExpr("file_path as path"))
    assert {tuple(r) for r in matrix.ranges(index).collect()} == {(".", 0, 1, 1), ("a", 1, 2, 1), ("b", 2, 3, 1)}


def test_imports_whose_ids_repeat(spark):
    modules, _ = cycle(spark)
    rows = [(1, 1, "module_c"), (1, 1, "module_b.py"), (1, 1, "module_b"), (1, 1, "module_b"), (2, 2, "module_c"), (2, 1, "module_a"), (3, 1, None)]
    imports = spark.createDataFrame(rows, IMPORTS)
    # rows of one id and module are one import, which has one module
    assert sorted(map(tuple, resolve.resolve_first(imports, modules).collect())) == [(1, 1, 2), (2, 1, 1), (2, 2, 3)]
    assert sorted(r.module_id for r in resolve.resolve_first(imports, modules, rows=True).collect()) == [1, 2, 2, 2, 3, 3]
    assert resolve.resolve_any(imports, modules).count() == 5 and resolve.resolve_any(imports, modules, rows=True).count() == 6
    found = lambda rows: {tuple(r) for r in graph.edges(imports, modules, rows).collect()}
    assert found(False) == {("module_a.py", "module_b.py"), ("module_b.py", "module_c.py")}
    assert found(True) == found(False) | {("module_a.py", "module_c.py")}
    both = sorted(map(tuple, graph.imported(imports, modules).collect()))
    one = [("module_a.py", x) for x in ("module_a.py", "module_b.py", "module_c.py")] + [("module_b.py", "module_c.py")]
    assert both == sorted(one + [(b, a) for a, b in one])
    assert {r.path: r.ca for r in structural.afferent(modules, imports).collect()} == {"module_a.py": 1, "module_b.py": 1, "module_c.py": 2}


def test_nothing_is_broadcast_that_is_larger_than_it_looks(spark, tmp_path):
    from coderill.operators.placing import file_bytes, tasks

    # one long path a module: its endings are 400 times the rows, in files of a few kB
    modules = spark.range(200).selectExpr("id", "1L as language_id", "concat('p', id, repeat('/d', 200), '.py') as path", "concat('n', id) as name")
    modules.write.parquet(str(tmp_path / "modules"))
    modules = spark.read.parquet(str(tmp_path / "modules"))
    imports = spark.range(400).selectExpr("id", "id % 200 as from_module_id", "concat('d', repeat('/d', id % 3), '.py') as to_module")
    for found in (resolve.resolve_tiered(imports, modules), matrix.structural(imports, modules), resolve.resolve_any(imports, modules), graph.edges(imports, modules, True)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.module_id for r in resolve.resolve_tiered(imports, modules).collect()} == {0}
    assert 0 < file_bytes(modules) < 1 << 20 and tasks(modules) == 1 and tasks(spark.range(10_000_000)) == 1 + 80_000_000 // (4 << 20)
    assert tasks(spark.createDataFrame([(1,)], "x int").localCheckpoint()) == 4
