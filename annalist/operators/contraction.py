"""Contraction of forests: long chains become short ones by splicing out nodes.

Chains of first parents are as long as a history, so nothing may walk them generation by
generation, and doubling all edges writes each of them once for every doubling. Here each
level drops a quarter of the edges of the one before, so all levels together hold at most
four times the edges, however long the chains are.

A ``Forest`` tells what lies above a node, how many nodes lie below it and how far the end of
its chain is. ``Chains`` cuts a whole forest into numbered chains.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from annalist.operators.lineage import Scratch

#: edges of the last level, which the driver follows
FEW = 100_000


class Forest:
    """Edges ``(by..., node, target)``, at most one per ``node``, contracted level by level.

    In each level every node throws a coin, by a hash. Nodes with heads whose target has
    tails are spliced out; no two of them are neighbours. Edges into a spliced node lead on
    to its target and keep its name as ``via``; ``length`` adds up the edges that one stands
    for. With ``weighted``, ``weight`` adds up a node and all those below it that were spliced.
    Edges may bring these two columns; else they count as 1.
    The last level has at most ``few`` edges. Levels are written to ``scratch``: the plan of a
    level does not repeat those before, and their sizes are known to the planner. ``release``
    deletes them.
    """

    def __init__(self, edges: DataFrame, by, scratch: Scratch, few: int | None = None, weighted: bool = False):
        self.by, self.scratch, self.few = list(by), scratch, FEW if few is None else few
        self.keys, self.weighted = [*self.by, "node"], weighted
        self.name = f"forest-{len(scratch.paths)}"
        self.schema = edges.select(*self.keys).schema
        numbers = [c if c in edges.columns else F.lit(1).cast("long").alias(c) for c in ("length", "weight")]
        level, found = scratch.counted(edges.select(*self.keys, "target", *numbers[: 1 + weighted]))
        self.levels, self.rows = [level], [found]
        while found > self.few:
            before = found
            level, found = scratch.counted(self._contracted())
            self.levels.append(level)
            self.rows.append(found)
            # a cycle ends as an edge of a node to itself, which no level drops
            if found > 0.9 * before and level.filter("node = target").head(1):
                raise RuntimeError("chain of first parents does not end; the parents table has a cycle")

    def _coin(self, name: str, level: int):
        return F.xxhash64(*self.by, F.col(name), F.lit(level)).bitwiseAND(F.lit(1)) == 1

    def _is_spliced(self, level: int):
        return self._coin("node", level) & ~self._coin("target", level)

    def _contracted(self) -> DataFrame:
        level = len(self.levels) - 1
        edges = self.levels[level]
        jumped = F.col("_next").isNotNull()
        kept = edges.filter(~self._is_spliced(level)).join(self._onward(level, "target"), [*self.by, "target"], "left")
        weight = []
        if self.weighted:
            spliced = edges.filter(self._is_spliced(level)).groupBy(*self.by, F.col("target").alias("node"))
            kept = kept.join(spliced.agg(F.sum("weight").alias("_weight")), self.keys, "left")
            weight = [(F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight")]
        return kept.select(
            *self.keys,
            F.coalesce("_next", "target").alias("target"),
            F.when(jumped, F.col("target")).alias("via"),
            (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length"),
            *weight,
        )

    def _onward(self, level: int, name: str) -> DataFrame:
        """Where the edges of spliced nodes lead."""
        gone = self.levels[level].filter(self._is_spliced(level))
        return gone.select(*self.by, F.col("node").alias(name), F.col("target").alias("_next"), F.col("length").alias("_length"))

    def above(self, starts: DataFrame) -> DataFrame:
        """``starts (by..., node)`` and all nodes on the chains that leave them.

        Three steps: starts that were spliced out hand on to their targets until the last
        level; there the driver follows chains, at most ``few`` edges; then every level adds
        the nodes that marked edges had jumped over.
        """
        by, scratch = self.by, self.scratch
        empty = F.array().cast("array<struct<level: int, node: string>>")
        trail = starts.select(*by, F.col("node").alias("at")).distinct().withColumn("passed", empty)
        for level in range(len(self.levels) - 1):
            moved = F.col("_next").isNotNull()
            step = F.array(F.struct(F.lit(level).alias("level"), F.col("at").alias("node")))
            trail = trail.join(self._onward(level, "at"), [*by, "at"], "left").select(
                *by, F.coalesce("_next", "at").alias("at"), F.when(moved, F.concat("passed", step)).otherwise(F.col("passed")).alias("passed")
            )
        trail = scratch.keep(trail)
        spliced = trail.select(*by, F.explode("passed").alias("step")).select(*by, "step.*")
        at = trail.select(*by, F.col("at").alias("node")).distinct()
        marked = at.unionByName(self._followed(at)).distinct()
        for level in reversed(range(len(self.levels) - 1)):
            jumps = self.levels[level + 1].filter("via is not null").select(*by, "node", "via")
            both = F.explode(F.array_compact(F.array("node", "via")))
            marked = marked.join(jumps, [*by, "node"], "left").select(*by, both.alias("node"))
            marked = marked.unionByName(spliced.filter(F.col("level") == level).drop("level")).distinct()
        return marked

    def _last(self, column: str) -> tuple:
        """The last level on the driver: the target of each node, and one number of each."""
        rows = self.levels[-1].select(*self.by, "node", "target", column).toArrow().to_pydict()
        *by, node, target, numbers = rows.values()
        nodes = list(zip(*by, node))
        return dict(zip(nodes, zip(*by, target))), dict(zip(nodes, numbers))

    def _followed(self, at: DataFrame) -> DataFrame:
        """Nodes on the chains that leave ``at`` in the last level."""
        onward, _ = self._last("length")
        todo = [tuple(r) for r in at.join(self.levels[-1].select(*self.keys), self.keys, "left_semi").collect()]
        found = set()
        for node in todo:
            chain = set()
            while node in onward and node not in found:
                found.add(node)
                chain.add(node)
                node = onward[node]
            if node in chain:
                raise RuntimeError("chain of first parents does not end; the parents table has a cycle")
            found.add(node)
        return self._local(sorted(found, key=str))

    def _upwards(self, onward: dict) -> list:
        """Nodes of the last level, each after all that lead to it."""
        waiting = Counter(onward.values())
        order = [node for node in onward if node not in waiting]
        for node in order:
            target = onward[node]
            waiting[target] -= 1
            if not waiting[target] and target in onward:
                order.append(target)
        if len(order) < len(onward):
            raise RuntimeError("chain of first parents does not end; the parents table has a cycle")
        return order

    def sizes(self) -> DataFrame:
        """``(by..., node, size)`` of all nodes with an edge: the weights of the node and of all that lead to it."""
        onward, size = self._last("weight")
        for node in self._upwards(onward):
            if onward[node] in size:
                size[onward[node]] += size[node]
        found = self._add("sizes", self._local([(*node, n) for node, n in size.items()], "size long"))
        for level in reversed(range(len(self.levels) - 1)):
            jumps = self.levels[level + 1].filter("via is not null").select(*self.keys, "via").join(found, self.keys)
            below = jumps.groupBy(*self.by, F.col("via").alias("node")).agg(F.sum("size").alias("_below"))
            gone = self.levels[level].filter(self._is_spliced(level)).join(below, self.keys, "left")
            total = F.col("weight") + F.coalesce("_below", F.lit(0))
            found = self._add("sizes", gone.select(*self.keys, total.alias("size")))
        return found

    def heights(self) -> DataFrame:
        """``(by..., node, chain, height)`` of all nodes with an edge: the end of its chain, and the length up to it."""
        onward, length = self._last("length")
        place = {}
        for node in reversed(self._upwards(onward)):
            chain, height = place.get(onward[node], (onward[node][-1], 0))
            place[node] = (chain, height + length[node])
        found = self._add("heights", self._local([(*node, *p) for node, p in place.items()], "chain string, height long"))
        for level in reversed(range(len(self.levels) - 1)):
            ends = found.select(*self.by, F.col("node").alias("target"), F.col("chain"), "height")
            gone = self.levels[level].filter(self._is_spliced(level)).join(ends, [*self.by, "target"], "left")
            height = F.col("length") + F.coalesce("height", F.lit(0))
            placed = gone.select(*self.keys, F.coalesce("chain", "target").alias("chain"), height.alias("height"))
            found = self._add("heights", placed)
        return found

    def _local(self, rows: list, columns: str = "") -> DataFrame:
        """Rows of the last level, of its keys and more columns."""
        schema = StructType([*self.schema.fields, *(StructType.fromDDL(columns).fields if columns else [])])
        arrow = to_arrow_schema(schema)
        values = [[r[i] for r in rows] for i in range(len(arrow))]
        return self.levels[-1].sparkSession.createDataFrame(pa.table(values, schema=arrow), schema)

    def _add(self, name: str, rows: DataFrame) -> DataFrame:
        """What one level adds to a table of all levels; the whole table."""
        return self.scratch.append(f"{self.name}-{name}", rows)[0]

    def release(self) -> None:
        for level in self.levels:
            self.scratch.drop(level)


class Chains:
    """A commit graph as numbered chains and the edges between them.

    ``first`` and ``others`` are edges ``(by..., node, target)``; ``first`` has at most one
    per node. Where several first edges meet, the chain goes on to the neighbour below that
    most nodes lead to, so a walk along ``first`` changes its chain at most log2 N times. A
    chain is named by its end; ``height`` counts the edges from a node up to the end.

    Most nodes have one neighbour below. These runs are contracted and numbered first; only the
    tree of runs, one row for each, is weighed and joined to chains.

    ``places (by..., node, chain, height)`` holds all nodes but ends; ``cross (by..., chain,
    height, to_chain, to_height)`` all other edges. Both are written once.
    """

    def __init__(self, first: DataFrame, others: DataFrame, by, scratch: Scratch):
        self.by, self.scratch = list(by), scratch
        keys, met = [*self.by, "node"], [*self.by, "target"]
        first = scratch.keep(first.select(*keys, "target"))
        forks = first.groupBy(*met).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*met)
        forked, found = scratch.counted(first.join(forks, met, "left_semi"))
        runs = Forest(first.join(forked.select(*met).distinct(), met, "left_anti"), self.by, scratch)
        self.places = runs.heights()
        light = self._join_runs(forked) if found else forked
        cross = self.placed(light.unionByName(others.select(*keys, "target")))
        cross = self.placed(cross, "target", "to_")
        self.cross, self.crossings = scratch.counted(cross.select(*self.by, "chain", "height", "to_chain", "to_height"))
        runs.release()
        scratch.drop(first)
        scratch.drop(forked)

    def _join_runs(self, forked: DataFrame) -> DataFrame:
        """Joins runs to chains in ``places``; the forked edges that no chain goes along."""
        scratch, keys, met = self.scratch, [*self.by, "node"], [*self.by, "target"]
        # a forked edge leaves the end of a run and meets the top of another
        nodes = self.places.groupBy(*self.by, F.col("chain").alias("node")).agg((F.max("height") + 1).alias("_nodes"))
        above = self.placed(forked, "target", "to_").join(nodes, keys, "left")
        above = above.select(*keys, F.col("to_chain").alias("target"), (F.col("to_height") + 1).alias("length"), F.coalesce("_nodes", F.lit(1).cast("long")).alias("weight"))
        tree = Forest(above, self.by, scratch, weighted=True)
        sized = tree.levels[0].select(*keys, "target", "length").join(tree.sizes(), keys)
        # of the runs that meet, the one with the most below it; ties go to the larger name
        heaviest = sized.groupBy(*met).agg(F.max(F.struct("size", "node", "length")).alias("_run"))
        line = Forest(heaviest.select(*self.by, "_run.node", "target", "_run.length"), self.by, scratch)
        offsets = line.heights()
        moved = self.places.join(offsets.select(*self.by, F.col("node").alias("chain"), F.col("chain").alias("_chain"), F.col("height").alias("_offset")), [*self.by, "chain"], "left")
        height = F.col("height") + F.coalesce("_offset", F.lit(0))
        moved = moved.select(*keys, F.coalesce("_chain", "chain").alias("chain"), height.alias("height"))
        self.places = scratch.keep(moved.unionByName(offsets))
        light = scratch.keep(forked.join(line.levels[0].select(*keys), keys, "left_anti"))
        tree.release()
        line.release()
        return light

    def placed(self, rows: DataFrame, name: str = "node", prefix: str = "") -> DataFrame:
        """``rows`` with chain and height of the node in column ``name``; one without a place is an end."""
        places = self.places.select(*self.by, F.col("node").alias(name), F.col("chain").alias("_chain"), F.col("height").alias("_height"))
        found = rows.join(places, [*self.by, name], "left")
        chain, height = F.coalesce("_chain", name), F.coalesce("_height", F.lit(0))
        return found.select(*rows.columns, chain.alias(f"{prefix}chain"), height.alias(f"{prefix}height"))

    def release(self) -> None:
        self.scratch.drop(self.cross)
