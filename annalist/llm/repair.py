"""Repair of conversations by the cheapest derivation over a hypergraph of items.

An item (i, q) says that the first i rows have been edited into roles that lead the grammar
``(s?(ua)+)?`` to its state q. Deductions keep, re-role or delete the next row, or insert a
row; an agenda pops items by (cost, rows, audit), and every deduction leads to a later one,
so that an item is final when it is popped. Long conversations are cut into segments of
consecutive rows. Each is derived from every state that it may start in, and states are
carried from segment to segment on a few numbers a segment.
"""

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import record_batch
from annalist.operators.grouping import positions
from annalist.operators.lineage import Scratch

#: rows of a segment
SEGMENT = 256
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: white space that does not count as text
BLANKS = " \t\n\x0b\x0c\r"
STATES = 4
#: state -> role that may follow (a system row may only open), and the state after it
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: (state, initial of a kept row) -> state
KEPT = {(0, "s"): 1, **{(q, role[0]): then for q, (role, then) in WANTED.items()}}
#: state after the last row -> inserts that end the conversation
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
#: a row's fault, or none
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"


@lru_cache(maxsize=50_000)
def derive(rows: str, start: int) -> dict[int, tuple[int, str]]:
    """State after all rows -> its least (cost, audit), from state ``start``.

    ``rows`` has two letters for each row: the initial of its role and its fault. Inserts
    stand before the row that follows them, so none ends an audit. Of two audits of equal
    cost over the same rows neither begins the other, as it would lack paid inserts only;
    so what is least stays least, whatever is appended to both.
    """
    count = len(rows) // 2
    agenda, final, ends = [(0, 0, "", start)], set(), {}
    while agenda and len(ends) < STATES:
        cost, i, audit, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == count:
            ends[state] = (cost, audit)
            continue
        initial, fault = rows[2 * i], rows[2 * i + 1]
        heappush(agenda, (cost + DELETE, i + 1, audit + "D", state))
        _, then = WANTED[state]
        heappush(agenda, (cost + INSERT, i, audit + "I", then))
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            heappush(agenda, (cost + REROLE + more, i + 1, audit + "R", then))
            if (kept := KEPT.get((state, initial))) is not None:
                heappush(agenda, (cost + more, i + 1, audit + "K", kept))
    return ends


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


SEGMENTS = pa.schema([("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])


def _derive_segments(batches):
    """Costs, audits and their order for every start and end state; None where there is no way."""
    for batch in batches:
        made = []
        for rows, number in zip(batch.column("rows").to_pylist(), batch.column("segment").to_pylist()):
            costs, ranks, audits = [], [], []
            for start in range(STATES):
                ends = derive(rows, start) if number or not start else {}
                order = {q: n for n, q in enumerate(sorted(ends, key=lambda q: ends[q][1]))}
                for q in range(STATES):
                    cost, audit = ends.get(q, (None, None))
                    costs.append(cost)
                    audits.append(audit)
                    ranks.append(order.get(q))
            initials = rows[::2]
            made.append((costs, ranks, audits, illegal(initials), initials[0], initials[-1]))
        out = record_batch(SEGMENTS, *(list(zip(*made)) or [[]] * len(SEGMENTS)))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("segment"), batch.column("key"), *out.columns], names=["conv", "segment", "key", *SEGMENTS.names])


WAYS = pa.schema([("start", pa.int64()), ("stop", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("ending", pa.string())])


def carried(segments) -> list[tuple]:
    """The states that the least way of a conversation starts and ends each segment in.

    ``segments`` are (costs, ranks) in order. The audit up to a segment's start tells the
    state there, and no audit begins another, so audits of equal cost are ordered by their
    places at the start, and within one start by the segment's own order.
    """
    reached, back = {0: (0, 0)}, []
    for costs, ranks in segments:
        ways = {}
        for state, (cost, place) in reached.items():
            for q in range(STATES):
                step = costs[state * STATES + q]
                if step is not None:
                    way = (cost + step, place, ranks[state * STATES + q], state)
                    ways[q] = min(ways.get(q, way), way)
        places = {q: n for n, q in enumerate(sorted(ways, key=lambda q: ways[q][1:3]))}
        reached = {q: (ways[q][0], places[q]) for q in ways}
        back.append({q: ways[q][3] for q in ways})
    cost, _, state = min((cost + INSERT * len(ENDING[q]), place, q) for q, (cost, place) in reached.items())
    out = []
    for step in reversed(back):
        out.append((step[state], state))
        state = step[state]
    return cost, out[::-1]


def _carry_states(batches):
    """One row for each segment, from rows sorted by conversation and segment.

    Of a conversation 32 numbers a segment are held, and no text or audit.
    """

    def settle(conv, rows):
        cost, ways = carried([r[:2] for r in rows])
        between = [illegal(a[4] + b[3]) for a, b in zip(rows, rows[1:])]
        for n, ((_, _, wrong, _, _, number), (start, stop)) in enumerate(zip(rows, ways)):
            last = n == len(rows) - 1
            yield conv, number, start, stop, cost if last else 0, wrong + (0 if last else between[n]), ENDING[stop] if last else ""

    def made(found, kind):
        columns = list(zip(*found)) or [[]] * 7
        out = record_batch(WAYS, *columns[2:])
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *out.columns], names=["conv", "segment", *WAYS.names])

    def run(batches):
        conv, rows, kind = None, [], None
        for batch in batches:
            kind, found = batch.column("conv").type, []
            columns = [batch.column(c).to_pylist() for c in ("costs", "ranks", "illegal", "first", "last", "segment")]
            for here, *row in zip(batch.column("conv").to_pylist(), *columns):
                if here != conv:
                    if rows:
                        found += settle(conv, rows)
                    conv, rows = here, []
                rows.append(row)
            yield made(found, kind)
        if rows:
            yield made(settle(conv, rows), kind)

    return run(batches)


LINES = pa.schema([("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _edit(batches):
    """Repaired rows in order, from rows and plans of segments sorted by conversation and place.

    A plan stands before the first row of its segment, and before rows that equal this one.
    Segments without a plan lose all their rows. Held are one batch, the plan in use and those
    that wait for a segment among equal rows: two at most, as all but the first of equal rows go.
    """
    conv, waiting = None, {}
    at = state = place = 0
    plan = ""

    def inserted(letters):
        nonlocal state, place
        for _ in range(letters):
            role, state = WANTED[state]
            yield conv, place, role, ""
            place += 1

    for batch in batches:
        out, kind = [], batch.column("conv").type
        for here, ready, segment, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "plan", "segment", "role", "text"))):
            if here != conv:
                conv, waiting = here, {}
                at = state = place = 0
            if ready is not None:
                waiting[segment] = ready
                continue
            if at % SEGMENT == 0:
                plan = waiting.pop(at // SEGMENT, "D" * SEGMENT)
            at += 1
            ahead = len(plan) - len(plan.lstrip("I"))
            out += inserted(ahead)
            letter, plan = plan[ahead], plan[ahead + 1 :]
            if letter != "D":
                if letter == "R":
                    role, state = WANTED[state]
                else:
                    state = KEPT[state, role[0]]
                out.append((conv, place, role, text))
                place += 1
            if not plan.strip("I"):  # what ends the conversation
                out += inserted(len(plan))
                plan = ""
        columns = list(zip(*out)) or [[]] * 4
        made = record_batch(LINES, *columns[1:])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *made.columns], names=["conv", *LINES.names])


def _digests(batches):
    """SHA-256 of each conversation's ``role:text`` lines, from rows sorted by conversation and place."""
    conv, digest, kind = None, None, None
    for batch in batches:
        kind, out = batch.column("conv").type, []
        for here, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if here != conv or digest is None:
                if digest:
                    out.append((conv, digest.hexdigest()))
                conv, digest = here, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        columns = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], names=["conv", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "digest"])


class Repair:
    """Faults, cheapest repair and repaired rows of conversations ``(conv_id, turn, role, text)``.

    Rows of a conversation stand in the order of ``turn`` (NULLs first); those of one turn in
    that of role and the text's SHA-256, so repeated rows stand side by side. NULL roles and
    texts count as one space. Rows with a NULL ``conv_id`` are one conversation. Other columns
    are not read, whatever their names. Empty tables give empty results.

    A row's first fault counts: blank, duplicate (its role and text stood earlier), truncated
    (its last character but white space is none of ``.!?``). Keeping a row costs 0, giving it
    the role user or assistant 3, deleting it 4, inserting an empty row of these roles 3;
    blank and duplicate rows must go, and truncated ones that stay cost 3 more. The repaired
    roles' initials read ``(s?(ua)+)?``; an empty role has no initial and cannot be kept. Of
    the cheapest repairs the one with the least audit is taken: the initials of its edits.

    Conversations of any length are placed by range partitioning and derived in segments of
    ``SEGMENT`` rows, so one conversation spreads over many tasks; repeated rows are counted
    within tasks first. Only ``lines`` brings a conversation's rows into one task, where they
    stream through in order, as its digest is a running hash; one batch and one plan are held.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, key: str = "conv_id"):
        self.key = key
        text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
        # in a struct a NULL key equals another
        self.rows = rows.select(F.struct(F.col(key).alias("id")).alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
        order = ["turn", "role", F.sha2("text", 256).alias("digest")]
        bare = F.rtrim(F.col("text"), F.lit(BLANKS))
        ends_well = F.right(bare, F.lit(1)).isin(".", "!", "?")
        fault = F.when(bare == "", BLANK).when(~ends_well, TRUNCATED).otherwise(SOUND)
        narrow = self.rows.select("conv", *order, fault.alias("fault"))
        placed = scratch.keep(positions(narrow, ["conv"], [F.asc_nulls_first("turn"), "role", "digest"], "place", scratch))
        same = ["conv", "role", "digest"]
        again = placed.groupBy(*same).agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        repeated = (F.col("earliest") < F.col("place")) & (F.col("fault") != BLANK)
        fault = F.when(repeated, DUPLICATE).otherwise(F.col("fault"))
        judged = placed.join(again, same, "left").select("conv", "turn", "role", "digest", "place", fault.alias("fault"))
        self.judged = scratch.keep(judged)
        self.segments, self.ways = self._derived(scratch)

    def _derived(self, scratch: Scratch) -> tuple:
        number = F.floor((F.col("place") - 1) / SEGMENT).cast("bigint").alias("segment")
        initial = F.when(F.col("role") == "", F.lit(" ")).otherwise(F.left("role", F.lit(1)))
        row = F.struct("place", F.concat(initial, "fault").alias("code"))
        at = F.struct("place", "turn", "role", "digest")
        grouped = self.judged.select("conv", number, row.alias("row"), at.alias("at")).groupBy("conv", "segment")
        # at most SEGMENT rows of two letters each
        codes = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["code"]), "")
        cut = grouped.agg(codes.alias("rows"), F.min("at").alias("key"))
        kind, keyed = (cut.schema[c].dataType.simpleString() for c in ("conv", "key"))
        schema = f"conv {kind}, segment bigint, key {keyed}, costs array<bigint>, ranks array<bigint>, audits array<string>, illegal bigint, first string, last string"
        segments = scratch.keep(cut.mapInArrow(_derive_segments, schema))
        sorted_ = segments.drop("audits", "key").repartition("conv").sortWithinPartitions("conv", "segment")
        ways = sorted_.mapInArrow(_carry_states, f"conv {kind}, segment bigint, start bigint, stop bigint, cost bigint, illegal bigint, ending string")
        return segments, scratch.keep(ways)

    def plans(self) -> DataFrame:
        """``conv, segment, key, audit``: each segment's edits; the last one's end the conversation."""
        chosen = F.get("audits", (F.col("start") * STATES + F.col("stop")).cast("int"))
        met = self.segments.select("conv", "segment", "key", "audits").join(self.ways, ["conv", "segment"])
        return met.select("conv", "segment", "key", F.concat(chosen, "ending").alias("audit"))

    def summary(self) -> DataFrame:
        """``key, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

        ``gaps`` are turns missing between the first and the last, ``illegal`` neighbours whose
        initials are none of su, ua, au.
        """
        turns = self.judged.groupBy("conv", "turn").agg(*[F.sum((F.col("fault") == f).cast("bigint")).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
        span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        faults = turns.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
        costs = self.ways.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda p: p["audit"])
        audits = self.plans().groupBy("conv").agg(F.array_join(pieces, "").alias("audit"))
        met = faults.join(costs, "conv").join(audits, "conv")
        return met.select(F.col("conv.id").alias(self.key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _edited(self) -> DataFrame:
        none = F.lit(None).cast("string")
        rows = self.rows.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"), none.alias("plan"), F.lit(None).cast("bigint").alias("segment"), "text")
        plans = self.plans().filter(~F.col("audit").rlike("^D*$"))
        plans = plans.select("conv", "key.turn", "key.role", "key.digest", F.col("audit").alias("plan"), "segment", none.alias("text"))
        met = rows.unionByName(plans).repartition("conv")
        met = met.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest", F.col("plan").isNull())
        kind = self.rows.schema["conv"].dataType.simpleString()
        return met.drop("turn", "digest").mapInArrow(_edit, f"conv {kind}, place bigint, role string, text string")

    def lines(self) -> DataFrame:
        """``key, place, role, text``: the repaired rows; places count from 0."""
        return self._edited().select(F.col("conv.id").alias(self.key), "place", "role", "text")

    def digests(self) -> DataFrame:
        """``key, digest``: SHA-256 (hex) of the repaired ``role:text`` lines, joined by newlines.

        Conversations that nothing is left of are absent.
        """
        kind = self.rows.schema["conv"].dataType.simpleString()
        return self._edited().mapInArrow(_digests, f"conv {kind}, digest string").select(F.col("conv.id").alias(self.key), "digest")
