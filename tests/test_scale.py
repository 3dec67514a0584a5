"""Both sides of size checks, graphs beyond toy size, and what must not be in plans."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coderill.functions import scalars
from coderill.operators import crosslang, ecosystem, graph
from coderill.sources import git as history

ROOT = Path(__file__).resolve().parents[1]


def brute_components(edges):
    reach = {}
    for a, _ in edges:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            for s, d in edges:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[a] = seen
    nodes = {x for e in edges for x in e}
    own = {x: {y for y in nodes if y in reach.get(x, ()) and x in reach.get(y, ())} for x in nodes}
    return {x: min(own[x]) for x in nodes if len(own[x]) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_components_in_one_task_and_by_joins(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(18):02d}", f"n{rng.randrange(18):02d}") for _ in range(24)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = brute_components(edges)
    assert dict(graph.tarjan(*map(list, zip(*edges, strict=True)))) == want
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    if seed == 0:
        assert {r.node: r.component for r in graph.components(df, few_bytes=0).collect()} == want


def test_components_of_many_modules(spark):
    # 2,000 rings of 50 modules and a chain of 20,000, which recursion would not survive
    rings = spark.range(100_000).selectExpr("concat('m', lpad(id, 6, '0')) as src", "concat('m', lpad(id div 50 * 50 + (id + 1) % 50, 6, '0')) as dst")
    chain = spark.range(20_000).selectExpr("concat('c', lpad(id, 6, '0')) as src", "concat('c', lpad(id + 1, 6, '0')) as dst")
    found = graph.components(rings.unionByName(chain))
    assert found.count() == 100_000 and found.select("component").distinct().count() == 2000
    assert found.where("component <> concat('m', lpad(int(substring(node, 2)) div 50 * 50, 6, '0'))").isEmpty()


def test_endpoints_in_urls_against_all_pairs(spark):
    rng = random.Random(3)
    paths = ["/api", "/api/users", "/api/users/<id>", "/a_b", "", "%", "/x%y", "/API/Up", "\\d", None, "/ä"]
    ends = [(k, rng.choice(["route", "handler"]), rng.choice(["GET", "POST", None]), p) for k, p in enumerate(paths * 2)]
    urls = ["http://h/api/users/3", "/API/users", "/aXb", "/a_b", "/x123y", "", "none", "/api/up", "\\d", "/Ä/ä", None]
    calls = [(k, 1, "fetch", rng.choice(["GET", "POST", None]), u) for k, u in enumerate(urls * 3)]
    e = spark.createDataFrame(ends, "module_id int, endpoint_type string, method string, path string")
    c = spark.createDataFrame(calls, "id int, module_id int, call_type string, method string, url_pattern string")
    pairs = c.select("id", "url_pattern", F.col("method").alias("m"), "call_type").crossJoin(e.select("method", "path", "endpoint_type").distinct()).where("m = method")
    want = sorted((r.id, r.path, r.endpoint_type) for r in pairs.where("contains(url_pattern, path)").collect())
    found = crosslang.matches(c, e)
    assert sorted((r.id, r.path, r.endpoint_type) for r in found.collect()) == want and len(want) > 10
    like = sorted((r.id, r.path, r.endpoint_type) for r in pairs.where("url_pattern ilike concat('%', path, '%') escape '!'").collect())
    got = crosslang.coupling(c, e)
    assert sorted((r.id, r.path, r.endpoint_type) for r in got.collect() if r.path is not None) == like and len(like) > len(want) / 2
    assert got.where("path is null").count() == len(calls) - len({i for i, _, _ in like})


@pytest.mark.parametrize("block", [512, 3])
def test_pairs_of_huge_commits(spark, block):
    from itertools import combinations

    from coderill.operators import temporal

    rng = random.Random(1)
    commits = {k: sorted({f"f{rng.randrange(25)}" for _ in range(n)}) for k, n in enumerate((1, 2, 4, 20, 9, 0, 14))}
    rows = [(k, f, "M") for k, files in commits.items() for f in files] * 2 + [(3, "gone", "D")]
    got = temporal.jaccard(spark.createDataFrame(rows, "commit_id int, file_path string, change_type string"), block).collect()
    want = {}
    for a, b in combinations(sorted({f for fs in commits.values() for f in fs}), 2):
        both = sum(a in fs and b in fs for fs in commits.values())
        if both:
            want[a, b] = both, both / sum(a in fs or b in fs for fs in commits.values())
    assert {(r.file_a, r.file_b): (r.co_change_count, r.jaccard_similarity) for r in got} == want and len(got) == len(want)


def test_rounding_at_the_edge(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.125,), (2.675,)], "x double").select("x", scalars.round_half_even(F.col("x")).alias("even"), scalars.to_fixed(F.col("x"), 0).alias("fixed"), scalars.to_fixed(F.col("x"), 2).alias("two")).collect()
    assert [r.even for r in got[:4]] == [0.0, 2.0, 2.0, 0.0] and [r.fixed for r in got[:3]] == ["1", "2", "3"]
    assert [r.two for r in got[4:]] == ["0.13", "2.68"] or [r.two for r in got[4:]] == ["0.13", "2.67"]


def test_history_of_odd_changes(repo):
    """Renames, changes of kind, empty commits, merges and names that git quotes."""
    root = repo.path
    repo.commit(a_DOT_txt="one\ntwo\n", b_DOT_txt="x\ny\nz\n")
    (root / "b.txt").rename(root / 'ü "q\t.txt')
    repo.commit(a_DOT_txt="one\n++two\n--three\n:x\ndiff --git a b\n" + "a" * 40 + "\n")
    (root / "a.txt").unlink()
    os.symlink("c", root / "a.txt")
    repo.git("add", "-A")
    repo.commit()
    hashes = history.commit_hashes(str(root))
    parents = [(x.split()[0], x.split()[1:]) for x in history.git_lines(str(root), hashes)]
    got = {}
    for h, change in history.changes_of(str(root), parents):
        got.setdefault(h, []).append(change)
    last, second, first = (sorted(got[h], key=str) for h in hashes)
    assert first == [("a.txt", 3, 0, "A", None), ("b.txt", 4, 0, "A", None)]
    # a line that begins with two more of its sign looks like a header, and is not counted
    assert second == [("a.txt", 4, 1, "M", None), ('ü "q\t.txt', 0, 0, "R", "b.txt")]
    assert last == [("a.txt", 1, 5, "M", None)]
    assert [m for _, n, _, _, m, _ in history.commits_of(str(root), hashes)] == ["change 3", "change 2", "change 1"]
    with pytest.raises(subprocess.CalledProcessError):
        history.commit_hashes(str(root / "missing"))


def test_no_shared_folder_is_an_error_unless_local():
    from coderill.sinks import shared_folder

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext = type("C", (), {"master": master})()
            self.held = {"spark.checkpoint.dir": folder} if folder else {}
            self.conf = type("Conf", (), {"get": lambda _, k, d=None: self.held.get(k, d), "set": lambda _, k, v: self.held.__setitem__(k, v)})()

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(Session(master))
        assert shared_folder(Session(master, "hdfs://x/")) == "hdfs://x"
    assert shared_folder(Session("local[2]"))


def test_entry_swallows_no_other_import_error():
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    print('raised', e.name)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    if (ROOT / "coderill/llm").exists():
        assert done.stdout.startswith("raised"), done.stdout + done.stderr


def _dependencies(spark, repeated: bool):
    rng = random.Random(5)
    versions = ["==1.0", "==01.2", "==1.0", "==2", "dev", "beta", "", None, "==" + "9" * 50]
    rows = [(k // 2 if repeated and k % 7 == 0 else k, f"m{k % 3}", rng.choice(["p", "q", "r", None]), rng.choice(versions)) for k in range(240)]
    return spark.createDataFrame(rows, "id bigint, manifest_file string, package_name string, version_spec string"), rows


def _pairs(rows):
    import re

    number = lambda v: (m := re.search(r"\d+", v)) and int(m[0])
    found = []
    for i, m, p, v in rows:
        for j, o, q, u in rows:
            if p and p == q and i < j and v and u and v != u:
                major = number(v) is not None and number(u) is not None and number(v) != number(u)
                found.append((p, i, j, v, u, m, o, "major_version_diff" if major else "version_mismatch"))
    return sorted(found)


@pytest.mark.parametrize("repeated", [False, True])
def test_conflicts_in_blocks_against_all_pairs(spark, repeated):
    deps, rows = _dependencies(spark, repeated)
    want = _pairs(rows)
    found = ecosystem.conflicts(deps, block=8, task_pairs=200)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1500
    assert found.rdd.getNumPartitions() > 10  # one package does not go to one task
    ordered = [tuple(r) for r in ecosystem.conflicts(deps, ordered=True, block=8, task_pairs=200).collect()]
    assert sorted(ordered) == want
    at = [(r[7] != "version_mismatch", *r[:3]) for r in ordered]
    assert at == sorted(at)


@pytest.mark.parametrize("repeated", [False, True])
def test_conflicts_are_counted_without_pairs(spark, repeated):
    from collections import Counter

    deps, rows = _dependencies(spark, repeated)
    found = ecosystem.conflict_counts(deps)
    assert {r.conflict_type: r.n for r in found.collect()} == Counter(r[7] for r in _pairs(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    # a package of two million declarations has 1.75e12 pairs
    many = spark.range(2_000_000).selectExpr("id", "'f' as manifest_file", "'p' as package_name", "concat('==', id % 8, '.0') as version_spec")
    assert [tuple(r) for r in ecosystem.conflict_counts(many).collect()] == [("major_version_diff", 2_000_000 * 1_750_000 // 2)]
    assert ecosystem.conflict_counts(many.where("false")).count() == 0


def test_components_of_many_weak_ones_are_not_coloured(spark, monkeypatch):
    rng = random.Random(2)
    edges = {(f"g{g:02d}n{rng.randrange(9)}", f"g{g:02d}n{rng.randrange(9)}") for g in range(60) for _ in range(14)}
    edges = sorted((a, b) for a, b in edges if a != b)
    df = spark.createDataFrame(edges, "src string, dst string")
    want = sorted(graph.tarjan(*map(list, zip(*edges, strict=True))))
    monkeypatch.setattr(graph, "SHARE_BYTES", 1000)
    with monkeypatch.context() as m:
        m.setattr(graph, "coloured", None)  # called only for a weak component that one task can't hold
        found = graph.components(df, few_bytes=500)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 150
    # one ring of 40 is too large for a task of 500 bytes, the others are not
    ring = spark.createDataFrame([(f"r{k:02d}", f"r{(k + 1) % 40:02d}") for k in range(40)] + [("r00", "leaf")], "src string, dst string")
    both = graph.components(df.where("src < 'g04'").unionByName(ring), few_bytes=200)
    assert sorted(map(tuple, both.collect())) == sorted([x for x in want if x[0] < "g04"] + [(f"r{k:02d}", "r00") for k in range(40)])
    table = graph.cycle_table(both).collect()
    assert [r.cycle_id for r in sorted(table, key=lambda r: r.cycle)] == list(range(1, len(table) + 1)) and max(r.cycle_length for r in table) == 40


def test_labels_of_a_long_way(spark):
    chain = spark.range(3000).selectExpr("xxhash64(id) as a", "xxhash64(id + 1) as b").unionByName(spark.sql("select -5L as a, -6L as b"))
    got = graph.weak_labels(chain, 4).collect()
    assert len({r.node for r in got} | {r.label for r in got}) == 3003 and len(got) == 3001 and len({r.label for r in got}) == 2
