"""Pipeline over the documents table: each stage works on all that the one before kept.

A stage takes and returns the columns of documents (the last returns packed pieces). Other
columns that documents have are carried along, whatever their names.
"""

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.llm import language, minhash, packing, quality, repeats
from annalist.llm.common import crc_bucket, table
from annalist.operators.lineage import Scratch

#: the language stage rejects documents without a letter, and those whose positions agree on no language
LEAST_LANGUAGE_SCORE = 0.35
#: the repeats stage removes passages of at least so many words or so many bytes wherever they
#: occur more than once; the shortest are 50 words of one letter and the blanks between them
REPEAT_WORDS, REPEAT = 50, 400
LEAST_REPEAT = 2 * REPEAT_WORDS - 1
#: the near-duplicate stage's words in a shingle, and the similarity of a link in percent
SHINGLE, SIMILAR = 5, 80


def _rows(docs):
    """Whole rows as one column, beside the text."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_value"))


def good_quality(spark, docs, sf_dir):
    """Drops documents whose neighbours vote for label 0; learns from labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 3) != 1)
    scored = quality.score(_rows(docs), quality.fit(docs, labels), keys=("_row",), text="_value")
    return scored.filter("predicted = 1").select("_row.*")


def known_language(spark, docs, sf_dir):
    """Drops documents without a letter or a recognisable language."""
    model = language.fit(docs, crc_bucket("doc_id", 5) != 0)
    found = language.predict(_rows(docs), model, keys=("_row",), text="_value")
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select("_row.*")


def distinct_documents(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id.

    Rows that share doc_id and text count as one document.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    found = minhash.near_duplicates(docs.select(key.alias("_key"), "text"), Scratch(spark), width=SHINGLE, percent=SIMILAR, key="_key")
    kept = found.filter("kept").select("_key").distinct()
    rows = _rows(docs).select("_row", F.struct("_row.doc_id", F.xxhash64("_value").alias("text_hash")).alias("_key"))
    first = Window.partitionBy("_key").orderBy(*[F.col(f"_row.{c}") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    single = rows.join(kept, "_key", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return single.select("_row.*")


def without_repeats(spark, docs, sf_dir):
    """Cuts passages that stand elsewhere in the corpus too; documents stay, n_chars follows the text, NULL becomes empty."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = repeats.remove_repeats(docs, Scratch(spark), length=LEAST_REPEAT, characters=True, least_words=REPEAT_WORDS, least_bytes=REPEAT, carry=others)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark, docs, sf_dir):
    """Packs the remaining documents into training sequences."""
    return packing.pack_documents(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=1)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("repeats", without_repeats),
    ("packing", packed),
]
#: fitted models, tokenizer ranks and recursion over whole texts are not SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's rows are written to the shared folder and read again.

    A stage's rows are deleted when those of the next are written; the last stage reads its input.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for number, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.keep(docs)
            scratch.drop(before)
    return docs
