import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline


def words(chance, n):
    vocabulary = ["time", "people", "water", "house", "light", "story", "garden", "letter", "window", "river"]
    chosen = [chance.choice(vocabulary) + chance.choice("abcdefghij") * chance.randint(0, 3) + chance.choice(vocabulary) for _ in range(n)]
    return " ".join(" ".join(chosen[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture()
def folder(spark, tmp_path):
    """Documents with planted cases, and labels."""
    chance = random.Random(6)
    clean = [(i, words(chance, 120)) for i in range(60)]
    passage = words(chance, 52)
    junk = [(100 + i, ("SPAM!! " * 100)) for i in range(12)] + [(130 + i, "### $$$ " * 80) for i in range(12)]
    copies = [(200, clean[3][1]), (201, clean[3][1] + " More."), (3, clean[3][1])]
    shared = [(300, words(chance, 60) + " " + passage + " " + words(chance, 60)), (301, words(chance, 70) + " " + passage + " " + words(chance, 50))]
    odd = [(400, "12 34 56"), (401, None), (None, words(chance, 100))]
    rows = clean + junk + copies + shared + odd
    table = [(k, t, "en" if k is None or k % 2 else "fr", "s", len(t or ""), 1, "x") for k, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, _n string"
    spark.createDataFrame(table, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1) for k, _ in clean] + [(k, 0) for k, _ in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return tmp_path, dict(rows), passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(path)).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == columns
    clean = set(range(60)) | {300, 301, None}
    assert clean <= kept[0] and not kept[0] & set(range(100, 150))
    assert clean <= kept[1] and not kept[1] & {400, 401}
    assert clean <= kept[2] and not kept[2] & {200, 201}
    third = spark.read.parquet(f"{path}/2")
    assert third.count() == len(kept[2])
    cut = {r.doc_id: r for r in spark.read.parquet(f"{path}/3").collect()}
    assert all(passage[:200] not in cut[k].text and len(cut[k].text) == cut[k].n_chars > 300 for k in (300, 301))
    assert cut[10].text == texts[10]
    assert kept[4] == kept[3] == kept[2]


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and "pipeline" in contract.queries()
    tokens = {}
    for r in rows:
        tokens.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(a == b for a, b in tokens.values())


def test_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeats_without_blanks_and_of_short_words(spark):
    chance = random.Random(8)
    unbroken = "".join(chance.choice("日本語文字列中国今年") for _ in range(400))
    address = "https://" + "".join(chance.choice("abcdefgh/") for _ in range(450))
    short = " ".join(chance.choice("abcdefgh") for _ in range(50))
    fewer = " ".join("".join(chance.choice("abcdefgh") for _ in range(10)) for _ in range(36))  # 395 bytes
    rows = [(2 * i + k, f"{words(chance, 9)}{10 * k + i}{x}{5 - k} {words(chance, 9)}") for i, x in enumerate((unbroken, address, short, fewer)) for k in (0, 1)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    cut = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    for k in (0, 1):
        assert unbroken[:100] not in cut[k] and address[:100] not in cut[2 + k] and short[:60] not in cut[4 + k]
        assert cut[6 + k] == dict(rows)[6 + k]


def test_repeats_side_by_side_count_alone(spark):
    chance = random.Random(9)
    # 35 words of 245 bytes each; two of them stand side by side, and each stands elsewhere alone
    first, second = (" ".join("".join(chance.choice("abcdefgh") for _ in range(6)) for _ in range(35)) for _ in range(2))
    texts = [f"1 {first} {second} 2", f"3 {first} 4", f"5 {second} 6"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()} == dict(enumerate(texts))
