"""Cycles of imports: strongly connected components, each weak component in one task while its edges are few, else by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coderill.operators.placing import meet, tasks
from coderill.operators.resolve import first_targets, imported_pairs, known_targets, resolve_first
from coderill.sinks import application_folder
from coderill.sources.tree import workers_see_package


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that executors share: lineage ends there, and lost executors do no harm."""
    path = f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of edges that one task holds at most, and that it holds on average where there are more.
FEW_BYTES, SHARE_BYTES = 64 << 20, 4 << 20


def linked(met: DataFrame, modules: DataFrame, n: int) -> DataFrame:
    """Distinct (src, dst) paths of pairs (from_module_id, module_id)."""
    src = modules.select(F.col("id").alias("from_module_id"), F.col("path").alias("src"))
    dst = modules.select(F.col("id").alias("module_id"), F.col("path").alias("dst"))
    pairs = met.repartition(n, "from_module_id").distinct().join(src.repartition(n, "from_module_id").hint("merge"), "from_module_id")
    return meet(pairs, dst, "module_id", n).select("src", "dst").repartition(n, "src", "dst").distinct()


def edges(imports: DataFrame, modules: DataFrame, rows: bool = False) -> DataFrame:
    """Distinct (src, dst) paths of modules where one imports the other; self-imports left out. ``rows`` as in resolve_first."""
    n = tasks(imports, modules)
    met = imported_pairs(imports, first_targets(modules), n) if rows else resolve_first(imports, modules).select("from_module_id", "module_id")
    return linked(met.where("from_module_id <> module_id"), modules, n).where("src <> dst")


def imported(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (src, dst) paths of modules and of all that they import, by name or path; both ways round."""
    n = tasks(imports, modules)
    one = linked(imported_pairs(imports, known_targets(modules), n), modules, n)
    ways = F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))
    return one.select(F.explode(ways).alias("w")).select("w.x", "w.y")


def _trim(e: DataFrame) -> DataFrame:
    """Edges whose both ends have a way in and a way out; what is dropped is on no cycle."""
    while True:
        sources, targets = e.select(F.col("src").alias("n")).distinct(), e.select(F.col("dst").alias("n")).distinct()
        inner = sources.join(targets, "n", "left_semi")
        kept = written(e.join(inner.withColumnRenamed("n", "src"), "src", "left_semi").join(inner.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"), "trimmed")
        if kept.count() == e.count():
            return kept
        e = kept


def tarjan(src: list[str], dst: list[str]) -> list[tuple[str, str]]:
    """(node, least node of its component) of all nodes on a cycle, without recursion."""
    names = sorted({*src, *dst})
    number = {n: k for k, n in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for a, b in zip(src, dst, strict=True):
        out[number[a]].append(number[b])
    seen, low, held, stack, found = [-1] * len(names), [0] * len(names), [False] * len(names), [], []
    count = 0
    for root in range(len(names)):
        if seen[root] >= 0:
            continue
        way = [(root, 0)]
        while way:
            node, at = way.pop()
            if at == 0:
                seen[node] = low[node] = count
                count += 1
                stack.append(node)
                held[node] = True
            elif held[out[node][at - 1]]:
                low[node] = min(low[node], low[out[node][at - 1]])
            if at < len(out[node]):
                way.append((node, at + 1))
                if seen[out[node][at]] < 0:
                    way.append((out[node][at], 0))
            elif low[node] == seen[node]:
                own = []
                while not own or own[-1] != node:
                    own.append(stack.pop())
                    held[own[-1]] = False
                if len(own) > 1:
                    found += [(names[k], names[min(own)]) for k in own]
    return found


def weak_labels(pairs: DataFrame, n: int) -> DataFrame:
    """(node, label): nodes of one label are those that the pairs (a, b) of numbers join, whichever way.

    Large and small stars by turns (Kiveris and others, 2014): each node's neighbours are hung on its least one, so the rounds grow
    with the logarithm of the longest way, and there are never more pairs than at first.
    """
    least = F.least("u", F.min("v").over(W.partitionBy("u"))).alias("m")
    e, before = pairs.select("a", "b").where("a <> b"), None
    while True:
        ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        stars = e.select(ways.alias("w")).select("w.u", "w.v").repartition(n, "u").distinct().select("u", "v", least)
        large = stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = large.repartition(n, "u").distinct().select("u", "v", least)
        hung = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
        small = stars.select(hung.alias("w")).select("w.a", "w.b").where("a <> b")
        e = written(small.repartition(n, "a").distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("b") > F.col("a"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(e: DataFrame, few_bytes: int = FEW_BYTES) -> DataFrame:
    """(node, component) of all nodes on a cycle; the component is its least node.

    Edges of a counted size up to ``few_bytes`` go to one task, which goes through them once. More are dealt to tasks by what they
    join whichever way, since a cycle lies within that; only a weak component that is larger by itself is coloured by joins.
    """
    e = written(e.select("src", "dst").distinct(), "edges")
    length = F.octet_length("src") + F.octet_length("dst")
    size = e.agg(F.sum(length)).first()[0] or 0

    def run(batches):
        import pandas as pd

        got = list(batches)
        if got:
            both = pd.concat(got)
            yield pd.DataFrame(tarjan(both["src"].tolist(), both["dst"].tolist()), columns=["node", "component"])

    workers_see_package(e.sparkSession)
    if size <= few_bytes:
        return e.coalesce(1).mapInPandas(run, "node string, component string")
    # nodes as hashes: two nodes of one hash can only join two weak components, which does no harm
    n = 1 + size // SHARE_BYTES
    a, b = F.xxhash64("src"), F.xxhash64("dst")
    labels = weak_labels(e.select(a.alias("a"), b.alias("b")), n)
    labelled = meet(e.withColumn("node", a), labels, "node", n, "left").select("src", "dst", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled.repartition(n, "label"), "labelled")
    large = [r.label for r in labelled.groupBy("label").agg(F.sum(length).alias("size")).where(F.col("size") > few_bytes).select("label").collect()]
    own = labelled.where(~F.col("label").isin(large)) if large else labelled
    found = own.repartition(n, "label").select("src", "dst").mapInPandas(run, "node string, component string")
    return found.unionByName(coloured(labelled.where(F.col("label").isin(large)).select("src", "dst"))) if large else found


def coloured(e: DataFrame) -> DataFrame:
    """``components`` of any number of distinct edges.

    Colouring: the greatest label that reaches a node along the edges is its colour; within a colour, what also reaches the
    node of that label is one component. It is taken out, and the rest goes on. No closure is held, so memory grows with edges.
    """
    e = _trim(e)
    found: DataFrame | None = None
    while not e.isEmpty():
        label = written(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "label")
        while True:
            came = e.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("came"))
            new = written(label.join(came, "node", "left").select("node", F.greatest("label", F.coalesce("came", "label")).alias("label"), (F.col("came") > F.col("label")).alias("changed")), "label")
            label = new.select("node", "label")
            if new.where("changed").isEmpty():
                break
        ends = label.select(F.col("node").alias("src"), F.col("label").alias("a")), label.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        same = written(e.join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst", F.col("a").alias("label")), "same")
        front = written(label.where("node = label"), "front")
        members = front
        while not front.isEmpty():
            back = same.join(front.withColumnRenamed("node", "dst"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            front = written(back.join(members, ["node", "label"], "left_anti"), "front")
            members = written(members.unionByName(front), "members")
        sized = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component")).where("n > 1")
        part = written(members.join(sized, "label").select("node", "component"), "part")
        found = part if found is None else found.unionByName(part)
        gone = members.select("node")
        rest = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = _trim(written(rest.select("src", "dst"), "rest"))
    return found if found is not None else e.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def cycle_table(found: DataFrame) -> DataFrame:
    """cycle_id (from 1, in order of the least member), cycle_length and the sorted members as 'a -> b -> a'.

    Ids come from a window over the names of components alone, which are few next to the modules.
    """
    by = written(found.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("m")), "cycles")
    ids = by.select("component", F.row_number().over(W.orderBy("component")).cast("bigint").alias("cycle_id"))
    text = F.array_join(F.concat("m", F.slice("m", 1, 1)), " -> ")
    return by.join(ids, "component").select("cycle_id", F.size("m").cast("bigint").alias("cycle_length"), text.alias("cycle"))


def network(pairs: DataFrame) -> DataFrame:
    """Nodes of a coupling network with their number of links and strongest one."""
    ends = pairs.select(F.explode(F.array("file_a", "file_b")).alias("node"), "jaccard_similarity")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.max("jaccard_similarity").alias("strongest"))
