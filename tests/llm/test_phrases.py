import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.llm import phrases


@settings(deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_common_part_is_parsed_once(text, following):
    own, edited = phrases.both_signatures(text, following)
    assert (own == phrases.text_signature(text)).all()
    assert (edited == phrases.text_signature(phrases.edited_text(text, following))).all()


def test_parse():
    known = set()
    assert phrases.parse("abababab", known) == (["a", "b", "ab", "aba"], "b") and known == {"a", "b", "ab", "aba"}


def brute(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = phrases.edited_text(text, following)
        own, other, after = map(phrases.text_signature, (text, edited, following))
        out.append(
            (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.fingerprint(own), phrases.fingerprint(other),
             phrases.likeness(own, other), phrases.likeness(own, after))
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", ["1", "3", "40"])
def test_against_brute_force(spark, ranges):
    rows = [(k, None if k % 7 == 0 else "" if k % 11 == 0 else f"text {k * k} " * (k % 9) + "ü" * (k % 5)) for k in range(-20, 60, 2)]
    rows.sort()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        docs = spark.createDataFrame([(k, t, "x", 1) for k, t in reversed(rows)], "doc_id bigint, text string, fingerprint string, n_chars int")
        assert sorted((tuple(r) for r in phrases.compare_with_edits(docs).collect()), key=str) == brute(rows)
        one = phrases.compare_with_edits(docs.filter("doc_id = 2")).collect()
        assert [tuple(r) for r in one] == brute([r for r in rows if r[0] == 2])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def in_order(spark, rows):
    """Rows as the operator orders them: by key, NULL first, then by the hash of the text."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(
        F.asc_nulls_first("doc_id"), F.xxhash64("text")
    )
    return docs, [tuple(r) for r in hashed.collect()]


def test_rows_of_one_key_spread_over_tasks(spark):
    """Most rows have one key, many have none, and some are equal."""
    rows = [(7, f"text {i} {i * i}") for i in range(4000)] + [(None, f"none {i % 300}") for i in range(600)]
    rows += [(8, "same")] * 40 + [(9, None)]
    docs, ordered = in_order(spark, rows)
    dealt = phrases._with_following(docs, "doc_id", "text").filter("not _guest").groupBy("_range").count().collect()
    assert sum(r["count"] for r in dealt) == len(rows)
    assert len(dealt) >= 8 and max(r["count"] for r in dealt) < len(rows) // 4
    guests = phrases._with_following(docs, "doc_id", "text").filter("_guest")
    assert guests.count() <= len(dealt) * docs.rdd.getNumPartitions()
    assert sorted((tuple(r) for r in phrases.compare_with_edits(docs).collect()), key=str) == brute(ordered)


def test_the_plan_does_not_grow_with_the_partitions(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sizes = []
    try:
        for ranges in ("2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            sizes.append(len(phrases._with_following(docs, "doc_id", "text")._jdf.queryExecution().logical().toString()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(sizes[1] - sizes[0]) < 50


def test_repeats_nulls_and_empty(documents, nothing):
    rows = phrases.compare_with_edits(documents).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in documents.select("doc_id").collect())
    texts = {r.fingerprint for r in rows if r.n_chars == len("One short text.")}
    assert len(texts) == 1
    assert phrases.compare_with_edits(nothing).count() == 0
    assert phrases.fingerprints(documents).count() == documents.count()


def test_similar_texts_are_nearer():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(500))
    other = " ".join(f"{i * 104729 % 1000}term" for i in range(500))
    own, edited = phrases.both_signatures(text, other)
    assert phrases.likeness(own, edited) > 0.5 > phrases.likeness(own, phrases.text_signature(other))
