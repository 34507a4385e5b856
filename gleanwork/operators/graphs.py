"""Dependency graphs: levels by peeling, strongly connected components by reach forward and back.

Edges are (name, needs). Each round is a grouped aggregation over the edges that are left, written down before the
next one; once few are left (at most `small`, counted), one task finishes them, so that a long chain costs no rounds.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Edges that one task may finish: some tens of MB.
SMALL = 100_000


def kahn(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Levels above what needs nothing (0), of all names that are on no cycle and behind none."""
    waits, users = defaultdict(int), defaultdict(list)
    for name, needs in edges:
        waits[name] += 1
        users[needs].append(name)
    now, level, out = [n for n in users if n not in waits], 0, {}
    while now:
        out |= dict.fromkeys(now, level)
        level, after = level + 1, []
        for n in now:
            for user in users[n]:
                waits[user] -= 1
                if not waits[user]:
                    after.append(user)
        now = after
    return out


def levels(nodes: DataFrame, needs: DataFrame, small: int = SMALL) -> DataFrame:
    """(name, stage) of (name) and (name, needs): 1 more than the highest stage of what a name needs, null on a cycle or behind one.

    Repeated names and edges count once. What isn't a name is needed in vain: it doesn't count.
    """
    nodes = nodes.select("name").filter("name is not null").distinct()
    edges = needs.select("name", "needs").distinct().join(nodes, "name", "left_semi").join(nodes.withColumnRenamed("name", "needs"), "needs", "left_semi").select("name", "needs")
    left, edges = written(nodes), written(edges)
    found, stage = [], 0
    while edges.count() > small:
        stage += 1
        ready = written(left.join(edges, "name", "left_anti"))
        if ready.isEmpty():
            break
        found.append(ready.withColumn("stage", F.lit(stage)))
        left = written(left.join(ready, "name", "left_anti"))
        edges = written(edges.join(ready.withColumnRenamed("name", "needs"), "needs", "left_anti").select("name", "needs"))
    else:  # few edges are left: names without any come next, the others lie above them

        def finish(frames):
            rows = [(a, b) for f in frames for a, b in zip(f["name"], f["needs"])]
            yield pd.DataFrame([(n, i + stage + 1) for n, i in kahn(rows).items()], columns=["name", "stage"])

        rest = written(edges.coalesce(1).mapInPandas(finish, "name string, stage int"))
        ends = edges.select("name").union(edges.select("needs")).distinct()
        alone = left.join(ends, "name", "left_anti").withColumn("stage", F.lit(stage + 1))
        found += [rest, alone]
        left = left.join(rest, "name", "left_anti").join(alone, "name", "left_anti")
    out = left.withColumn("stage", F.lit(None).cast("int"))
    for part in found:
        out = out.union(part)
    return out


def tarjan(edges: list[tuple[str, str]]) -> dict[str, str]:
    """The smallest name of each name's strongly connected component; without recursion."""
    out, index, low, stack, on, found = defaultdict(list), {}, {}, [], set(), {}
    for a, b in edges:
        out[a].append(b)
        out[b]
    for start in list(out):
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, more = work[-1]
            for w in more:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = [stack.pop()]
                    while group[-1] != v:
                        group.append(stack.pop())
                    on.difference_update(group)
                    found |= dict.fromkeys(group, min(group))
    return found


def on_cycles(needs: DataFrame, small: int = SMALL) -> DataFrame:
    """(name, component) of the names that lie on a cycle: the smallest name of those that reach each other.

    Names that no cycle leads to, and then names that lead to none, are peeled off. Of the rest, each takes the largest
    name that reaches it; from those that took their own, the way back through names of the same taking is a component.
    """
    edges = needs.select("name", "needs").filter("name is not null and needs is not null").distinct()
    own = edges.filter("name = needs").select("name", F.col("name").alias("component"))
    edges = edges.filter("name <> needs")
    for _ in range(2):  # once along the edges and once against them
        ends = edges.select("name").union(edges.select("needs")).distinct()
        cut = written(levels(ends, edges, small).filter("stage is null").select("name"))
        edges = edges.join(cut, "name", "left_semi").join(cut.withColumnRenamed("name", "needs"), "needs", "left_semi")
        edges = edges.select(F.col("needs").alias("name"), F.col("name").alias("needs"))
    edges, found = written(edges), []
    while (n := edges.count()) > small:
        color = _taken(edges)
        roots = color.filter("name = color").select("name", "color")
        inside = edges.join(color, "name").join(color.select(F.col("name").alias("needs"), F.col("color").alias("_c")), "needs").filter("color = _c").select("name", "needs", "color")
        group = _back(roots, written(inside))
        found.append(written(group))
        gone = found[-1].select("name")
        edges = written(edges.join(gone, "name", "left_anti").join(gone.withColumnRenamed("name", "needs"), "needs", "left_anti").select("name", "needs"))
        assert edges.count() < n
    sizes = None
    for part in found:
        sizes = part if sizes is None else sizes.union(part)
    if n:

        def finish(frames):
            rows = [(a, b) for f in frames for a, b in zip(f["name"], f["needs"])]
            yield pd.DataFrame(list(tarjan(rows).items()), columns=["name", "color"])

        rest = edges.coalesce(1).mapInPandas(finish, "name string, color string")
        sizes = rest if sizes is None else sizes.union(rest)
    if sizes is None:
        return own
    sizes = written(sizes)
    groups = sizes.groupBy("color").agg(F.min("name").alias("component"), F.count("*").alias("n")).filter("n > 1")
    several = sizes.join(groups, "color").select("name", "component")
    return several.union(own.join(several.select("name"), "name", "left_anti"))


def _taken(edges: DataFrame) -> DataFrame:
    """(name, color): the largest name from which each one is reached along `needs`, itself included."""
    color = written(edges.select("name").union(edges.select("needs")).distinct().withColumn("color", F.col("name")))
    while True:
        sent = edges.join(color, "name").groupBy(F.col("needs").alias("name")).agg(F.max("color").alias("_sent"))
        new = written(color.join(sent, "name", "left").select("name", F.greatest("color", "_sent").alias("color"), (F.col("_sent") > F.col("color")).alias("changed")))
        color = new.select("name", "color")
        if new.filter("changed").isEmpty():
            return color


def _back(roots: DataFrame, inside: DataFrame) -> DataFrame:
    """(name, color) of the names from which their color's root is reached, through edges (name, needs, color) of one color."""
    found = front = written(roots)
    while True:
        step = inside.join(front.select(F.col("name").alias("needs"), "color"), ["needs", "color"]).select("name", "color").distinct()
        front = written(step.join(found.select("name"), "name", "left_anti"))
        if front.isEmpty():
            return found
        found = found.union(front)
