import random

import numpy as np
import oracle_check
import pytest
from pyspark.sql import functions as F

from annalist.llm import minhash
from annalist.llm.components import components
from annalist.llm.queries import ORACLE, QUERIES


def shingles(text, width):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [k for (k, _), g in zip(rows, group) if g == group[i] and k is not None]
        least = min(keys) if keys else None
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=str)


def found(docs, scratch, width, percent=80):
    rows = minhash.near_duplicates(docs, scratch, width=width, percent=percent).collect()
    return sorted((tuple(r) for r in rows), key=str)


def edited(chance, words, share):
    return " ".join(chance.choice("uvwxyz") * 3 if chance.random() < share else w for w in words)


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, scratch, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # groups span many cells
    chance = random.Random(width)
    rows = []
    for g in range(3):  # groups of copies whose similarity lies around the limit
        words = [str(chance.randint(0, 10**6)) for _ in range(120)]
        rows += [(100 * g + i, edited(chance, words, chance.choice([0, 0.01, 0.03, 0.05]))) for i in range(40)]
    rows += [(1000 + i, " ".join(chance.choice("ab") for _ in range(chance.randint(1, 8)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs, scratch, width) == brute(rows, width, 80)


def test_nulls_repeats_and_extra_columns(documents, nothing, scratch):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, scratch, 5) == brute(rows, 5, 80)
    assert found(nothing, scratch, 5) == []


def test_links_are_of_80_percent_or_more(documents, scratch):
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents, scratch, percent=70)


def test_query_against_sql(spark, sf_dir):
    duck = oracle_check.connect(sf_dir)
    assert oracle_check.difference(QUERIES["op3_minhash"](spark, sf_dir), duck, ORACLE["op3_minhash"]) is None


def test_estimate_is_unbiased():
    random_, order = np.random.default_rng(1), minhash._fill_order()
    for n, common in ((5, 4), (30, 24), (500, 400), (5000, 4000)):
        errors = []
        for _ in range(60):
            h = np.sort(random_.integers(0, 2**64, n, np.uint64))
            part = np.sort(random_.choice(h, common, replace=False))
            equal = (minhash.registers(h, order) == minhash.registers(part, order)).mean()
            errors.append(minhash.estimated_similarity(equal, n, common) - common / n)
        assert abs(np.mean(errors)) < 0.03, n


def test_components(spark, scratch):
    chance = random.Random(3)
    edges = [(chance.randint(0, 400), chance.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(100)]
    edges += [(5000, 5000 + i) for i in range(1, 50)]
    root = {}

    def of(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    table = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in components(table, scratch).collect()}
    assert got == {a: of(a) for a, b in edges for a in (a, b) if any(x != y and a in (x, y) for x, y in edges)}
    assert components(table.filter(F.lit(False)), scratch).count() == 0
