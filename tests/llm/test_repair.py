import hashlib
import itertools
import random
import re

import oracle_check
import pytest

from annalist.llm import repair
from annalist.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, audit string, conv string, segment bigint"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(repair.BLANKS)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, lines) over all repairs with up to two inserts before each row."""
    found = {("", ""): (0, [])}  # initials so far, audit -> cost, lines
    for (role, text), fault in [*zip(rows, faults(rows)), ((None, None), None)]:
        grown = {}
        for (initials, audit), (cost, lines) in found.items():
            for k in range(3):
                for new in itertools.product(("user", "assistant"), repeat=k):
                    begun = initials + "".join(r[0] for r in new)
                    if not re.fullmatch(r"s?(ua)*u?", begun):
                        continue
                    so_far = (begun, audit + "I" * k, cost + 3 * k, lines + [f"{r}:" for r in new])
                    ways = [("", 0, None)] if role is None else [("D", 4, None)]
                    if role is not None and fault in "t-":
                        more = 3 * (fault == "t")
                        ways += [("K", more, role)] * (role != "") + [("R", 3 + more, r) for r in ("user", "assistant")]
                    for letter, price, kept in ways:
                        key = (so_far[0] + (kept[0] if kept else ""), so_far[1] + letter)
                        if re.fullmatch(r"s?(ua)*u?", key[0]) and so_far[2] + price <= 4 * len(rows) + 9:
                            value = (so_far[2] + price, so_far[3] + ([f"{kept}:{text}"] if kept else []))
                            if key not in grown or value < grown[key]:
                                grown[key] = value
        best = {}
        for (initials, audit), (cost, lines) in grown.items():  # what follows depends on the last two initials only
            tail = initials[-1:] if initials != "s" else "S"
            if tail not in best or (cost, audit) < best[tail][:2]:
                best[tail] = (cost, audit, initials, lines)
        found = {(i, a): (c, x) for c, a, i, x in best.values()} if role is not None else grown
    return min((cost, audit, lines) for (initials, audit), (cost, lines) in found.items() if LEGAL.fullmatch(initials))


def brute(rows):
    """Results by conversation of (conv_id, turn, role, text)."""
    out = {}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " " if r[2] is None else r[2], hashlib.sha256((" " if r[3] is None else r[3]).encode()).hexdigest()))
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in ordered if r[0] == conv]
        turns = {t for t, _, _ in own if t is not None}
        kinds = faults([r[1:] for r in own])
        initials = [r[1][:1] or " " for r in own]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest([r[1:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), wrong, cost, audit, lines)
    return out


def conversations(seed, count, longest):
    chance = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(chance.randint(1, longest)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = chance.choice(["Fine.", "Fine.", "cut", "Why? \n", "", " \t", None, f"Text {chance.randint(0, 9)}!", "so\x0b."])
            rows.append((conv or None, chance.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def check(spark, scratch, rows):
    table = spark.createDataFrame([(*r, "x", "x", "x", 0) for r in rows], SCHEMA).repartition(5)
    fixed = repair.Repair(table, scratch)
    expected = brute(rows)
    found = {r.conv_id: tuple(r)[1:] for r in fixed.summary().collect()}
    assert found == {k: v[:-1] for k, v in expected.items()}
    lines = {}
    for r in sorted(fixed.lines().collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {k: v[-1] for k, v in expected.items() if v[-1]}
    digests = {r.conv_id: r.digest for r in fixed.digests().collect()}
    assert digests == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()}


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_against_brute_force(spark, scratch, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    check(spark, scratch, conversations(segment, 40, 9))


def test_one_conversation_holds_most_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rows = [r for r in conversations(1, 6, 5) if r[0] is not None]
    chance = random.Random(2)
    rows += [(99, t, chance.choice(["user", "assistant", "system"]), chance.choice([f"Word {t}.", "cut", ""])) for t in range(300)]
    rows += [(98, 5, "user", "Again.")] * 100 + [(98, 6, "assistant", "Yes.")] + [(98, 9, "user", "")] * 40
    check(spark, scratch, rows)


def test_a_large_conversation_has_many_segments(spark, scratch):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Text ', id, '.') as text")
    fixed = repair.Repair(rows, scratch)
    row = fixed.summary().first()
    assert (row.gaps, row.duplicate, row.illegal, row.cost, row.audit) == (0, 0, 0, 0, "K" * 20_000)
    assert fixed.segments.count() == -(-20_000 // repair.SEGMENT)


def test_empty_tables(spark, scratch):
    fixed = repair.Repair(spark.createDataFrame([], SCHEMA), scratch)
    assert fixed.summary().count() == fixed.lines().count() == fixed.digests().count() == 0


def test_query_against_sql(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("0.001", "0.01")):
        duck = oracle_check.connect(folder)
        assert oracle_check.difference(QUERIES["op12_repair"](spark, folder), duck, ORACLE["op12_repair"]) is None


def test_query_on_odd_rows(spark, tmp_path):
    rows = conversations(5, 30, 6) + [(500 + i, None, None, None) for i in range(30)]
    spark.createDataFrame([(*r, "x", "x", "x", 0) for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = oracle_check.duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    # an empty role has no initial here, so SQL would let it go along; no such rows in this part
    found = QUERIES["op12_repair"](spark, str(tmp_path))
    assert found.count() == len({r[0] for r in rows})
    assert oracle_check.difference(found, duck, ORACLE["op12_repair"]) is None
