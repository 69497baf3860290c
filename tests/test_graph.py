import os
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from annalist import schemas as T
from annalist.operators import contraction, graph
from annalist.operators.grouping import positions
from annalist.operators.lineage import Scratch


def parents(spark, edges, repo="r"):
    return spark.createDataFrame([(repo, c, p, o) for c, p, o in edges], T.PARENTS)


def heads(spark, *names):
    return spark.createDataFrame([("r", n) for n in names], "repo_id string, commit_id string")


def ids(df):
    return {r["commit_id"] for r in df.collect()}


def random_history(size, seed):
    rng = random.Random(seed)
    edges = []
    for i in range(size - 1):
        first = rng.randint(i + 1, min(i + 3, size - 1))
        edges.append((i, first, 0))
        if rng.random() < 0.3 and i + 4 < size:
            edges.append((i, rng.randint(i + 4, min(i + 40, size - 1)), 1))
    return edges


def walk(edges, start, ordinals):
    found, todo = set(), [start]
    while todo:
        node = todo.pop()
        if node not in found:
            found.add(node)
            todo += [p for c, p, o in edges if c == node and o in ordinals]
    return found


def test_merge_history(spark):
    edges = parents(spark, [("M", "A", 0), ("M", "B", 1), ("B", "A", 0)])
    assert ids(graph.first_parent_chain(edges, heads(spark, "M"))) == {"M", "A"}
    assert ids(graph.reachable(edges, heads(spark, "M"))) == {"M", "A", "B"}
    assert ids(graph.reachable(edges, heads(spark, "B"))) == {"A", "B"}
    assert sorted(rows(graph.merge_flags(edges))) == [("B", 1, False), ("M", 2, True)]


def test_a_single_commit(spark):
    none = parents(spark, []).limit(0)
    assert ids(graph.first_parent_chain(none, heads(spark, "A"))) == {"A"}
    assert ids(graph.reachable(none, heads(spark, "A"))) == {"A"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    edges = random_history(200, seed)
    table = parents(spark, [(str(c), str(p), o) for c, p, o in edges])
    for start in (0, 57):
        expected = {str(n) for n in walk(edges, start, {0})}
        assert ids(graph.first_parent_chain(table, heads(spark, str(start)))) == expected
    assert ids(graph.reachable(table, heads(spark, "57"))) == {str(n) for n in walk(edges, 57, {0, 1})}


def test_several_heads_and_repositories(spark):
    chain = [(str(i), str(i + 1), 0) for i in range(9)]
    both = parents(spark, chain).unionByName(parents(spark, chain, "s"))
    start = spark.createDataFrame([("r", "2"), ("r", "5"), ("s", "7")], "repo_id string, commit_id string")
    counts = graph.first_parent_chain(both, start, ["repo_id"]).groupBy("repo_id").count()
    assert sorted(rows(counts)) == [("r", 8), ("s", 3)]


@pytest.mark.parametrize("few", [0, 100])
def test_a_cycle_is_an_error(spark, monkeypatch, few):
    monkeypatch.setattr(contraction, "FEW", few)
    ring = [(str(i), str((i + 1) % 9), 0) for i in range(9)]
    with pytest.raises(RuntimeError):
        graph.first_parent_chain(parents(spark, [("x", "3", 0), *ring]), heads(spark, "x"))


@pytest.mark.parametrize("few", [6, 1000])
def test_contracted_histories(spark, monkeypatch, few, seed=3):
    """Heads in the middle, several on one chain, unknown ones; every level of contraction."""
    monkeypatch.setattr(contraction, "FEW", few)
    edges = random_history(100, seed)
    table = parents(spark, [(str(c), str(p), o) for c, p, o in edges])
    starts = (0, 31, 32, 90, 500)
    found = ids(graph.first_parent_chain(table, heads(spark, *map(str, starts))))
    assert found == {str(n) for s in starts for n in walk(edges, s, {0})}
    assert ids(graph.reachable(table, heads(spark, "31", "90"))) == {str(n) for s in (31, 90) for n in walk(edges, s, {0, 1})}


def test_contraction_writes_four_times_the_edges_at_most(spark):
    """A line of 30,000 commits and a star of as many."""
    line = spark.range(30_000).selectExpr("cast(id as string) as node", "cast(id + 1 as string) as target")
    star = spark.range(30_000).selectExpr("concat('s', id) as node", "'hub' as target")
    with Scratch(spark) as scratch:
        forest = contraction.Forest(line.unionByName(star), [], scratch, few=500)
        assert sum(forest.rows) <= 4 * 60_000 and forest.rows[-1] <= 500
        starts = spark.createDataFrame([("29000",), ("s5",)], "node string")
        found = {r.node for r in forest.above(starts).collect()}
        assert found == {str(n) for n in range(29_000, 30_001)} | {"s5", "hub"}


@pytest.mark.parametrize("few", [6, 1000])
def test_chains_of_a_tree(spark, few, monkeypatch):
    """Chains hold each edge's place, follow the heaviest neighbour and are few on every walk."""
    monkeypatch.setattr(contraction, "FEW", few)
    rng = random.Random(6)
    target = {n: rng.randint(max(0, n - 4), n - 1) for n in range(1, 150)}
    size = dict.fromkeys(range(150), 1)
    for n in range(149, 0, -1):
        size[target[n]] += size[n]
    first = spark.createDataFrame([(str(n), str(t)) for n, t in target.items()], "node string, target string")
    others = spark.createDataFrame([("140", "3"), ("0", "new")], "node string, target string")
    with Scratch(spark) as scratch:
        chains = contraction.Chains(first, others, [], scratch)
        place = {r.node: (r.chain, r.height) for r in chains.places.collect()}
        cross = sorted(rows(chains.cross))
    at = lambda n: place.get(str(n), (str(n), 0))
    kept = {n for n, t in target.items() if at(n)[0] == at(t)[0]}
    assert all(at(n)[1] == at(target[n])[1] + 1 for n in kept)
    below = {}
    for n, t in target.items():
        below.setdefault(t, []).append(n)
    for t, nodes in below.items():
        on = [n for n in nodes if n in kept]
        assert len(on) == 1 and size[on[0]] == max(size[n] for n in nodes)
    light = [(n, t) for n, t in target.items() if n not in kept] + [(140, 3), (0, "new")]
    assert cross == sorted((*at(n), *at(t)) for n, t in light)


@pytest.mark.parametrize(("few", "span"), [(6, 0), (1000, 0), (1000, 400)])
def test_topological_order_of_equal_clocks(spark, few, span, monkeypatch):
    """Times are the smallest that are later than those of all parents."""
    monkeypatch.setattr(contraction, "FEW", few)
    edges, rng = random_history(150, 8), random.Random(9)
    own = {i: 1000 + rng.randint(0, span) for i in range(150)}
    late = dict(own)
    for c, p, _ in sorted(edges, reverse=True):
        late[c] = max(late[c], late[p] + 1)
    commits = spark.createDataFrame([(str(i), t) for i, t in own.items()], "commit_id string, t long")
    table = parents(spark, [(str(c), str(p), o) for c, p, o in [*edges, (149, 777, 0)]]).drop("repo_id")
    with Scratch(spark) as scratch:
        order = dict(rows(graph.topological_order(commits, table, time="t", scratch=scratch), "commit_id", "walk_pos"))
    assert [n for n, _ in sorted(order.items(), key=lambda r: r[1])] == [str(n) for n in sorted(own, key=lambda n: (-late[n], str(n)))]


def test_rounds_hold_one_row_of_each_chain(spark):
    """A comb: 3,000 commits with 300 branches off it, merged again."""
    edges = [(str(i), str(i + 1), 0) for i in range(3000)]
    edges += [e for i in range(0, 3000, 10) for e in ((str(i), f"b{i}", 1), (f"b{i}", str(i + 5), 0))]
    with Scratch(spark) as scratch:
        found = ids(graph.reachable(parents(spark, edges), heads(spark, "1000"), scratch=scratch))
        marks = spark.read.parquet(f"{scratch.folder}/marks")
        assert found == {str(i) for i in range(1000, 3001)} | {f"b{i}" for i in range(1000, 3000, 10)}
        assert marks.count() == 201 and scratch.appended["marks"] <= 3


def test_topological_order_repairs_clocks(spark):
    edges = random_history(120, 3)
    table = parents(spark, [(str(c), str(p), o) for c, p, o in edges])
    rng = random.Random(4)
    commits = spark.createDataFrame([(str(i), 10_000 - i * 5 + rng.randint(0, 30)) for i in range(120)], "commit_id string, t long")
    order = dict(rows(graph.topological_order(commits, table, time="t"), "commit_id", "walk_pos"))
    assert sorted(order.values()) == list(range(120))
    assert all(order[str(c)] < order[str(p)] for c, p, _ in edges)


def test_topological_order_keeps_good_clocks(spark):
    commits = spark.createDataFrame([("a", 30), ("b", 10), ("c", 20)], "commit_id string, t long")
    table = parents(spark, [("a", "c", 0), ("c", "b", 0)])
    assert sorted(rows(graph.topological_order(commits, table, time="t"))) == [("a", 0), ("b", 2), ("c", 1)]


def test_topological_order_of_a_long_line_with_one_clock(spark):
    """20,000 generations, all in the same second."""
    line = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("commit_id"), F.lit(5).alias("t"))
    table = line.select("commit_id", F.lpad((F.col("commit_id").cast("long") + 1).cast("string"), 6, "0").alias("parent_id"), F.lit(0).alias("ordinal"))
    with Scratch(spark) as scratch:
        order = graph.topological_order(line, table.filter("parent_id < '020000'"), time="t", scratch=scratch)
        assert order.filter(F.col("walk_pos") != F.col("commit_id").cast("long")).count() == 0
        assert order.count() == 20_000


def test_topological_order_of_one_clock_takes_one_round_before_chains(spark):
    """A line without forks writes its commits, their edges and one round, and joins no runs."""
    line = spark.range(300).selectExpr("lpad(cast(id as string), 6, '0') as commit_id", "7L as t")
    table = spark.range(299).selectExpr("lpad(cast(id as string), 6, '0') as commit_id", "lpad(cast(id + 1 as string), 6, '0') as parent_id", "0 as ordinal")
    with Scratch(spark) as scratch:
        order = rows(graph.topological_order(line, table, time="t", scratch=scratch), "walk_pos", "commit_id")
        assert sorted(order) == [(n, f"{n:06d}") for n in range(300)]
        assert scratch.appended["times"] == 2
        assert len([n for n in scratch.appended if n.startswith("forest")]) == 1


@pytest.mark.parametrize("ordinals", [(0, 0), (0, 1), (1, 1)])
def test_topological_order_notices_cycles(spark, ordinals):
    commits = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "commit_id string, t long")
    with pytest.raises(RuntimeError):
        graph.topological_order(commits, parents(spark, [("a", "b", ordinals[0]), ("b", "a", ordinals[1])]).drop("repo_id"), time="t")


def test_owned_tables_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    edges = parents(spark, [("M", "A", 0), ("M", "B", 1), ("B", "A", 0)])
    commits = spark.createDataFrame([("M", 1), ("A", 1), ("B", 1)], "commit_id string, t long")
    with Scratch(spark) as scratch:
        jobs = [
            graph.first_parent_chain(edges, heads(spark, "M"), scratch=scratch),
            graph.reachable(edges, heads(spark, "M"), scratch=scratch),
            graph.topological_order(commits, edges, time="t", scratch=scratch),
            positions(commits, [], [F.desc("t")], scratch=scratch),
        ]
        assert [job.count() for job in jobs] == [2, 3, 3, 3]
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_positions_of_one_crowded_group(spark):
    """One group holds most rows; its positions come from several slices."""
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
        (F.col("id") * 7919 % 5000).alias("v"),
    )
    found = positions(df, ["g"], [F.desc("v")])
    assert found.count() == 5000
    hot = sorted(rows(found.filter("g = 'hot'"), "v", "rank"), reverse=True)
    assert [r for _, r in hot] == list(range(1, 4001))
    assert found.filter("g <> 'hot' and rank <> 1").count() == 0
