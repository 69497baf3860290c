"""Commit-graph operators on the parents table ``(by..., commit_id, parent_id, ordinal)``.

Histories are deep, so nothing walks one generation per round. Chains of first parents are
contracted and numbered (``contraction.py``), so that rounds step from chain to chain. Rounds
are written to the shared folder while a plan is built.
``scratch`` is the owner of these tables: pass one to delete them after using the result,
else they stay until the folder is cleaned.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.carry import running_max
from annalist.operators.contraction import Chains, Forest
from annalist.operators.grouping import positions
from annalist.operators.lineage import Scratch


def merge_flags(parents: DataFrame, by=()) -> DataFrame:
    """Commits that have parents, with their number and whether they merge."""
    real = parents.filter(F.col("parent_id") != "")
    counted = real.groupBy(*by, "commit_id").agg(F.count(F.lit(1)).alias("parents_count"))
    return counted.withColumn("is_merge", F.col("parents_count") > 1)


def _edges(parents: DataFrame, by) -> DataFrame:
    return parents.filter(F.col("parent_id") != "").select(
        *by, F.col("commit_id").alias("node"), F.col("parent_id").alias("target"), "ordinal"
    )


def first_parent_chain(parents: DataFrame, heads: DataFrame, by=(), scratch: Scratch | None = None) -> DataFrame:
    """Commits met by going from each head to first parents only, heads included.

    Writes at most four times the first-parent edges, however long chains are.
    """
    by, scratch = list(by), scratch or Scratch(parents.sparkSession)
    forest = Forest(_edges(parents, by).filter("ordinal = 0"), by, scratch)
    chain = scratch.keep(forest.above(heads.select(*by, F.col("commit_id").alias("node"))))
    forest.release()
    return chain.select(*by, F.col("node").alias("commit_id"))


def reachable(parents: DataFrame, heads: DataFrame, by=(), scratch: Scratch | None = None) -> DataFrame:
    """Commits reachable from the heads, heads included.

    History is cut into numbered chains once. What is reached of a chain is all up to one
    height, so a round holds one row for each chain whose mark rose: it crosses the edges
    between the old and the new mark, and raises the marks of the chains they lead to. Rounds
    count how deep merges nest, times log2 N at most, not how long the history is. Every
    round raises a mark, so the loop ends by itself.
    """
    by, scratch = list(by), scratch or Scratch(parents.sparkSession)
    keys = [*by, "chain"]
    edges = _edges(parents, by)
    chains = Chains(edges.filter("ordinal = 0"), edges.filter("ordinal > 0"), by, scratch)
    start = chains.placed(heads.select(*by, F.col("commit_id").alias("node")))
    start = start.groupBy(*keys).agg(F.max("height").alias("height"))
    marks, fresh = scratch.append("marks", start.withColumn("before", F.lit(-1).cast("long")))
    while not fresh.isEmpty():
        risen = fresh.select(*keys, F.col("before").alias("_from"), F.col("height").alias("_to"))
        crossed = chains.cross.join(risen, keys).filter("height > _from and height <= _to")
        met = crossed.groupBy(*by, F.col("to_chain").alias("chain")).agg(F.max("to_height").alias("height"))
        known = marks.groupBy(*keys).agg(F.max("height").alias("before"))
        before = F.coalesce("before", F.lit(-1)).alias("before")
        # rounds share a folder, so all marks are one scan however many rounds there were
        marks, fresh = scratch.append("marks", met.join(known, keys, "left").select(*keys, "height", before).filter("height > before"))
    chains.release()
    reached = marks.groupBy(*keys).agg(F.max("height").alias("_reached"))
    inside = chains.places.join(reached, keys).filter("height <= _reached")
    ends = reached.select(*by, F.col("chain").alias("commit_id"))
    return inside.select(*by, F.col("node").alias("commit_id")).unionByName(ends)


def topological_order(
    commits: DataFrame, parents: DataFrame, by=(), time: str = "committer_timestamp", scratch: Scratch | None = None
) -> DataFrame:
    """Children-before-parents positions from 0 for exports without row numbers.

    Every commit gets the smallest time that is at least its own and later than that of
    each parent; newest first is then a valid walk. Clocks are mostly right, so commits rise
    generation by generation first, as long as each round moves at most half as many as the
    one before, and the first at most half of all: all these rounds together move at most as
    many as there are. Longer runs of late clocks are settled along chains
    (``_along_chains``). Parents that are no commits are left out.
    """
    by, scratch = list(by), scratch or Scratch(commits.sparkSession)
    keys = [*by, "commit_id"]
    times, known = scratch.append("times", commits.groupBy(*keys).agg(F.max(F.col(time).cast("long")).alias("_time")))
    # the times of both ends come along, so the first round needs no join
    own = known.select(*by, F.col("commit_id").alias("node"), F.col("_time").alias("_own"))
    due = known.select(*by, F.col("commit_id").alias("target"), (F.col("_time") + 1).alias("_due"))
    edges = scratch.keep(_edges(parents, by).join(own, [*by, "node"]).join(due, [*by, "target"]))
    late = edges.filter("_due > _own").groupBy(*by, F.col("node").alias("commit_id")).agg(F.max("_due").alias("_time"))
    before = total = known.count()
    times, moved = scratch.append("times", late)
    while (count := moved.count()) and 2 * count <= before:
        before = count
        targets = moved.select(*by, F.col("commit_id").alias("target"), (F.col("_time") + 1).alias("_late"))
        due = edges.join(targets, [*by, "target"]).groupBy(*by, F.col("node").alias("commit_id")).agg(F.max("_late").alias("_due"))
        # times never fall, so of the rows that rounds added for one commit the latest counts
        now = times.groupBy(*keys).agg(F.max("_time").alias("_time"))
        times, moved = scratch.append("times", due.join(now, keys).filter("_due > _time").select(*keys, F.col("_due").alias("_time")))
    final = times.groupBy(*keys).agg(F.max("_time").alias("_time"))
    if count:
        # what a first and only round found is found again along the chains
        final = _along_chains(known if before == total else scratch.keep(final), edges, by, scratch)
    scratch.drop(edges)
    ordered = positions(final, by, [F.desc("_time"), F.asc("commit_id")], "walk_pos", scratch)
    return ordered.select(*by, "commit_id", (F.col("walk_pos") - 1).alias("walk_pos"))


def _along_chains(own: DataFrame, edges: DataFrame, by: list, scratch: Scratch) -> DataFrame:
    """``own (by..., commit_id, _time)`` with the smallest times that are later than those of all parents.

    History is cut into numbered chains once. Along a chain, time less height never falls,
    so late clocks there are settled by one running maximum in chunks. Between chains only
    the places where edges leave or arrive are compared, round after round, and only in
    chains where one rose; rounds count how often the longest run of late clocks changes its
    chain. A time beyond the latest one by more than the number of commits proves a cycle.
    """
    keys, chain, place = [*by, "commit_id"], [*by, "chain"], [*by, "chain", "height"]
    limits = own.agg(F.max("_time").alias("latest"), F.count(F.lit(1)).alias("n")).first()
    chains = Chains(edges.filter("ordinal = 0"), edges.filter("ordinal > 0"), by, scratch)
    placed = chains.placed(own.select(*by, F.col("commit_id").alias("node"), "_time"))
    rise = placed.select(*place, F.col("node").alias("commit_id"), (F.col("_time") - F.col("height")).alias("rise"))
    base = scratch.keep(running_max(rise, chain, "height", "rise"))
    arrivals = [F.col(f"to_{c}").alias(c) for c in ("chain", "height")]
    ends = chains.cross.select(*place).unionByName(chains.cross.select(*by, *arrivals)).distinct()
    points, changed = scratch.append("points", base.join(ends, place, "left_semi").select(*place, "rise"))
    lifts = None
    while chains.crossings:
        due = (F.col("_rise") + F.col("to_height") + 1 - F.col("height")).alias("lift")
        targets = changed.select(*by, F.col("chain").alias("to_chain"), F.col("height").alias("to_height"), F.col("rise").alias("_rise"))
        dues = chains.cross.join(targets, [*by, "to_chain", "to_height"]).select(*place, due).groupBy(*place).agg(F.max("lift").alias("lift"))
        # rises never fall, so of the rows that rounds added for one place the largest counts
        now = points.groupBy(*place).agg(F.max("rise").alias("rise"))
        lifts, raised = scratch.append("lifts", dues.join(now, place).filter("lift > rise").select(*place, "lift"))
        found = raised.agg(F.max(F.col("lift") + F.col("height")).alias("latest")).first()
        if found["latest"] is None:
            break
        if found["latest"] > limits["latest"] + limits["n"]:
            raise RuntimeError("times rise without end; the parents table has a cycle")
        moved = now.join(raised.select(*chain).distinct(), chain, "left_semi").join(raised, place, "left")
        moved = moved.select(*place, F.col("rise").alias("_before"), F.greatest("rise", "lift").alias("rise"))
        points, changed = scratch.append("points", running_max(moved, chain, "height", "rise").filter("rise > _before").select(*place, "rise"))
    chains.release()
    if lifts is not None:
        highest = lifts.groupBy(*place).agg(F.max("lift").alias("lift"))
        lifted = base.join(highest, place, "left").withColumn("rise", F.greatest("rise", "lift")).drop("lift")
        base = running_max(lifted, chain, "height", "rise")
    return base.select(*keys, (F.col("rise") + F.col("height")).alias("_time"))
