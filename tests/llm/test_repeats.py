import os
import random
from collections import Counter

import duckdb
import numpy as np
import oracle_check
import pytest

from annalist.llm import repeats
from annalist.llm.queries import ORACLE, QUERIES


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for key, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            stop = gone.find(0, at)
            stop = len(b) if stop < 0 else stop
            spans.append((at, stop))
            at = stop
        out.append((key, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def found(docs, scratch, length):
    rows = repeats.remove_repeats(docs, scratch, length=length).collect()
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=str)


@pytest.mark.parametrize("together", [1024, 1, 3])
def test_against_brute_force(spark, scratch, together, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "GATHERED", 500)
    chance = random.Random(1)
    text = lambda n: "".join(chance.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (255, 256, 257, 300, 500, 900)]
    rows = [(i, "".join(chance.choice([text(chance.randint(0, 400)), chance.choice(passages)]) for _ in range(4))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, passages[4]), (103, "x" * 2000), (104, "x" * 300 + "y"), (105, "ab" * 600)]
    near = rows[7][1]
    rows += [(110 + i, near[:i] + "Z" + near[i + 1 :]) for i in range(3, 400, 37)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(docs, scratch, 256) == brute(rows, 256)
    assert found(docs, scratch, 64) == brute(rows, 64)


def test_edge_cases(documents, nothing, scratch):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, scratch, 400) == brute(rows, 400)
    assert found(nothing, scratch, 400) == []


def test_carried_columns_and_characters(documents, scratch):
    others = [c for c in documents.columns if c != "text"]
    rows = repeats.remove_repeats(documents, scratch, characters=True, carry=others).collect()
    assert sorted(str(r.row.asDict()) for r in rows) == sorted(str(r.asDict()) for r in documents.select(others).collect())
    assert all(bytes(r.kept).decode() is not None for r in rows)
    assert repeats.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)] and repeats.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_orders_combine_into_classes_of_windows(seed):
    chance = random.Random(seed)
    core = chance.randbytes(12)
    words = []
    for _ in range(chance.randint(2, 7)):
        left, right = (bytes(chance.choice(b"ab") for _ in range(8)) for _ in range(2))
        low, high = sorted(chance.sample(range(9), 2))  # windows of 16 bytes start low to high bytes before the trigger
        words.append((left[8 - high :] + core + right[: 4 - low if low < 4 else 0], high, high - low + 1, low))
    words = [(w[: at - low + 16], at, n) for w, at, n, low in words if len(w) >= at - low + 16]
    cut = [[w[i : i + 16] for i in range(n)] for w, _, n in words]
    seen = Counter(x for c in cut for x in c)
    expected = {(i, k) for i, c in enumerate(cut) for k, x in enumerate(c) if seen[x] > 1}
    if len(words) > 1:
        found = {(i, k) for i, a, b in repeats.repeated_windows(words, 16) for k in range(a, b + 1)}
        assert found == expected


def test_short_passages_may_stay(spark, scratch):
    passage = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, "x " + passage), (2, "y " + passage)], "doc_id bigint, text string")
    few, many = (repeats.remove_repeats(docs, scratch, length=64, least_words=n).collect() for n in (101, 100))
    assert [r.spans for r in few] == [[], []]
    # the blank before the passage goes too
    assert sorted(bytes(r.kept) for r in many) == [b"x", b"y"]


def test_triggers_stand_for_every_window():
    data = np.frombuffer(random.Random(4).randbytes(3000), np.uint8)
    place, low, high = repeats.triggers(data, 400)
    assert low[0] == 0 and high[-1] == 2600 and (low[1:] == high[:-1] + 1).all()
    assert ((place >= high) & (place - low < repeats.spread(400))).all()
    assert not len(repeats.triggers(data[:399], 400)[0])


@pytest.mark.parametrize("part", [1, 7, 500, 2601])
def test_parts_have_the_same_triggers(part, monkeypatch):
    data = np.frombuffer(random.Random(5).randbytes(1500) + b"aaaa" * 200 + random.Random(6).randbytes(700), np.uint8)
    whole = repeats.triggers(data, 400)
    monkeypatch.setattr(repeats, "PART", part)
    assert all((a == b).all() for a, b in zip(whole, repeats.triggers(data, 400)))


def test_query_against_sql(spark, sf_dir):
    duck = oracle_check.connect(sf_dir)
    assert oracle_check.difference(QUERIES["op10_repeats"](spark, sf_dir), duck, ORACLE["op10_repeats"]) is None


def test_length_has_a_lower_bound(documents, scratch):
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents, scratch, length=50)


def longest_repeats(rows, words, size):
    """Bytes covered by the longest repeated string from every byte, if it has enough words or bytes."""
    data = [(k, t.encode()) for k, t in rows]
    suffixes = sorted((b[i : i + 3000], n, i) for n, (_, b) in enumerate(data) for i in range(len(b)))
    common = [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(suffixes, suffixes[1:])]
    gone = [bytearray(len(b)) for _, b in data]
    for (string, n, i), a, b in zip(suffixes, [0, *common], [*common, 0]):
        string = string[: max(a, b)]
        if len(string) >= size or len(string.split()) >= words:
            gone[n][i : i + len(string)] = b"\1" * len(string)
    return sorted((k, bytes(x for x, g in zip(b, cut) if not g)) for (k, b), cut in zip(data, gone))


@pytest.mark.parametrize("together, part", [(1024, 1 << 20), (1, 1 << 20), (3, 70), (1024, 70)])
def test_passages_against_brute_force(spark, scratch, together, part, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "GATHERED", 500)
    monkeypatch.setattr(repeats, "PART", part)
    chance = random.Random(2)
    word = lambda most: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(1, most)))
    text = lambda n, most: "".join(word(most) + chance.choice([" ", " ", " ", "  ", "\n", "\u00a0"]) for _ in range(n))
    passages = [text(n, most) for n in (34, 35, 36, 40, 60) for most in (1, 2, 4, 12)]
    passages += ["".join(chance.choice("日本語文字列中国") for _ in range(n)) for n in (39, 40, 41, 200)]
    passages += [text(20, 1) + word(1) * n for n in (70, 90, 300)]
    rows = [(i, "".join(chance.choice([text(chance.randint(0, 40), 3), chance.choice(passages), chance.choice(passages)[chance.randint(0, 9) :]]) for _ in range(4))) for i in range(70)]
    rows += [(100, rows[5][1]), (101, "x" * 700), (102, "a b " * 200), (103, "a  b" + " " * 300 + "a")]
    near = rows[7][1]
    rows += [(110 + i, near[:i] + "Z" + near[i + 1 :]) for i in range(3, 300, 37)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = repeats.remove_repeats(docs, scratch, length=64, least_words=35, least_bytes=120).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in found) == longest_repeats(rows, 35, 120)


def test_passages_need_a_length_that_none_undercuts(documents, scratch):
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents, scratch, length=100, least_words=50)


def test_query_returns_the_kept_text(spark, tmp_path):
    passage = "passage " * 52  # more than 50 words and 400 bytes
    texts = {1: "é" + passage + "first", 2: "ç" + passage + "second", 3: "clean", 4: None, 5: "short " * 3 + "end", 6: "short " * 3 + "other"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op10_repeats"](spark, str(tmp_path)).collect()}
    # of é and ç only the first byte differs
    assert {k: r.text for k, r in rows.items()} == {1: "éfirst", 2: "çsecond", 3: "clean", 4: "", 5: texts[5], 6: texts[6]}
    docs = spark.createDataFrame([(1, "é" + passage), (2, "ĩ" + passage)], "doc_id bigint, text string")  # the second bytes are equal
    docs.write.parquet(str(tmp_path / "more" / "documents.parquet"))
    rows = QUERIES["op10_repeats"](spark, str(tmp_path / "more"))
    assert {r.text for r in rows.collect()} == {"�"}
    for folder in (tmp_path, tmp_path / "more"):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        assert oracle_check.difference(QUERIES["op10_repeats"](spark, str(folder)), duck, ORACLE["op10_repeats"]) is None
