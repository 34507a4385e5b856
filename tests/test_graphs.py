"""Levels, orders and cycles of dependency graphs against plain Python."""

import random

import pytest

from gleanwork.operators import graphs
from gleanwork.plans import planner


def frames(spark, edges, more=()):
    nodes = sorted({x for e in edges for x in e} | set(more))
    return spark.createDataFrame([(n,) for n in nodes], "name string"), spark.createDataFrame(edges, "name string, needs string")


def plain_levels(edges, names):
    needs = {n: {b for a, b in edges if a == n} for n in names}
    out = dict.fromkeys(names)
    level = 1
    while ready := [n for n in names if out[n] is None and all(out[b] is not None and out[b] < level for b in needs[n])]:
        out |= dict.fromkeys(ready, level)
        level += 1
    return out


def plain_cycles(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    reach = {k: set(v) for k, v in reach.items()}
    while True:
        more = {k: v | {y for x in v for y in reach.get(x, ())} for k, v in reach.items()}
        if more == reach:
            break
        reach = more
    return {a: min(b for b in reach[a] | {a} if b == a or a in reach.get(b, ())) for a in reach if a in reach[a]}


def test_a_long_chain_and_a_ladder_of_diamonds(spark):
    chain = [(f"c{i:05}", f"c{i - 1:05}") for i in range(1, 5000)]
    ladder = [e for i in range(30) for e in ((f"a{i:02}", f"t{i:02}"), (f"b{i:02}", f"t{i:02}"), (f"t{i + 1:02}", f"a{i:02}"), (f"t{i + 1:02}", f"b{i:02}"))]
    nodes, edges = frames(spark, chain + ladder, ["alone"])
    got = {r.name: r.stage for r in graphs.levels(nodes, edges).collect()}
    want = {f"c{i:05}": i + 1 for i in range(5000)} | {f"t{i:02}": 2 * i + 1 for i in range(31)} | {f"{x}{i:02}": 2 * i + 2 for i in range(30) for x in "ab"} | {"alone": 1}
    assert got == want
    placed = [r.name for r in planner.topological(nodes, edges).orderBy("place").collect()]
    assert placed == sorted(want, key=lambda n: (want[n], n))


@pytest.mark.parametrize("small", [graphs.SMALL, 3])
def test_levels_of_random_graphs_in_rounds_and_at_once(spark, small):
    rng = random.Random(small)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(names[a], names[b]) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a > b]
    edges += [("n01", "n30"), ("n30", "n31"), ("n31", "n30"), ("n39", "n31")]  # a cycle, and names behind it
    nodes, frame = frames(spark, edges, names)
    frame = frame.union(frame.limit(5)).union(spark.createDataFrame([("n05", "gone"), (None, "n01"), ("n07", None)], frame.schema))
    assert {r.name: r.stage for r in graphs.levels(nodes, frame, small).collect()} == plain_levels(edges, names)


@pytest.mark.parametrize("small", [graphs.SMALL, 2])
def test_cycles_that_overlap(spark, small):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a"), ("e", "y"), ("p", "q"), ("q", "p"), ("y", "p"), ("s", "s"), ("a", "a"), ("u", "v")]
    got = {r.name: r.component for r in graphs.on_cycles(frames(spark, edges)[1], small).collect()}
    assert got == plain_cycles(edges) == {n: "a" for n in "abcde"} | {"p": "p", "q": "p", "s": "s"}
    assert graphs.on_cycles(frames(spark, [("u", "v")])[1], small).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_tarjan_and_kahn_alone(seed):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(rng.randrange(25))]
    groups = graphs.tarjan(edges)
    assert {n: c for n, c in groups.items() if sum(x == c for x in groups.values()) > 1 or (n, n) in edges} == plain_cycles(edges)
    names = {x for e in edges for x in e}
    assert {n: i + 1 for n, i in graphs.kahn(sorted(set(edges))).items()} == {n: s for n, s in plain_levels(edges, names).items() if s}
