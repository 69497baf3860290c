"""Queries of the operators in this folder on the driver's tables, and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from annalist.llm import bpe, forest, language, minhash, packing, phrases, quality, repair, repeats, rollups, toxicity, urls, whitening
from annalist.llm.common import crc_bucket, table
from annalist.operators.lineage import Scratch


def op1_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), path)


def op2_forest(spark, sf_dir):
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark), k=10)


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), width=4, percent=80)


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = language.fit(docs, ~held_out)
    return language.predict(docs.withColumn("held_out", held_out), model, keys=("doc_id", "held_out"))


def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket("doc_id", 3) == 1
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.score(docs.withColumn("held_out", held_out), model, keys=("doc_id", "held_out"))


MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s
    FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""


#: tokens of the query's tokenizer versions, as patterns
WORDS, LONGER_WORDS, PIECES = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]{2,}", r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def op6_rollups(spark, sf_dir):
    """Loads all documents under two versions, takes those labelled 0 out, revises one version, replays a batch."""
    scratch = Scratch(spark)
    count = {name: F.regexp_count("text", F.lit(p)).alias(name) for name, p in (("words", WORDS), ("longer", LONGER_WORDS), ("pieces", PIECES))}
    counts = scratch.keep(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *count.values()))
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    gone, left = counts.join(poor, "doc_id", "left_semi"), counts.join(poor, "doc_id", "left_anti")

    def version(rows, name, **columns):
        return rows.select("source", "lang", F.lit(name).alias("tokenizer_version"), *[F.col(c).alias(a) for a, c in columns.items()])

    rollup = rollups.Rollup(spark, f"{scratch.folder}/rollup")
    rollup.commit("words", rollups.inserts(version(counts, "words-1", tokens="words")))
    rollup.commit("pieces", rollups.inserts(version(counts, "pieces-1", tokens="pieces")))
    taken_out = version(gone, "words-1", tokens="words").unionByName(version(gone, "pieces-1", tokens="pieces"))
    rollup.commit("taken-out", rollups.deletes(taken_out))
    rollup.commit("recounted", rollups.revisions(version(left, "words-1", old_tokens="words", new_tokens="longer")))
    rollup.commit("taken-out", rollups.deletes(taken_out))
    return rollup.totals()


ROLLUPS_SQL = r"""
WITH kept AS (
  SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]{2,}')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces
  FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) USING (doc_id)
)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, sum(words)::BIGINT AS n_tokens FROM kept GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*), sum(pieces)::BIGINT FROM kept GROUP BY ALL
"""

#: rules of the query: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA))


URLS_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), places AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), best AS (
  SELECT n, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(best.verdict, 'allow') AS verdict FROM places LEFT JOIN best USING (n)
"""

def op8_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), Scratch(spark), path, size=2048, end=1)


def op9_phrases(spark, sf_dir):
    return phrases.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_repeats(spark, sf_dir):
    """Besides the digests, ``text``: the kept bytes as text. A character of which a cut leaves
    a part becomes U+FFFD. Repeated passages of fewer than 400 bytes stay, as the contract says."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


#: bytes of one character in hex, of a broken one as far as it goes, or any other byte
CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|(?:E0[AB].|E[1-9A-CEF][89AB].|ED[89].)[89AB].|(?:F0[9AB].|F[1-3][89AB].|F48.)[89AB].[89AB]."
BROKEN = "E0[AB].|E[1-9A-CEF][89AB].|ED[89].|(?:F0[9AB].|F[1-3][89AB].|F48.)(?:[89AB].)?|.."
REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT n, p, md5(array_slice(b, p + 1, p + 400)) AS k
  FROM (SELECT n, b, unnest(range(octet_length(b) - 399)) AS p FROM d WHERE octet_length(b) >= 400)
), repeated AS (
  SELECT n, p FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)
), runs AS (
  SELECT n, min(p) AS a, max(p) + 400 AS z
  FROM (SELECT n, p, sum(fresh) OVER (PARTITION BY n ORDER BY p) AS run
        FROM (SELECT n, p, CASE WHEN p - lag(p) OVER (PARTITION BY n ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh
              FROM repeated))
  GROUP BY n, run
), pieces AS (
  SELECT n, a, z, hex(array_slice(b, coalesce(lag(z) OVER (PARTITION BY n ORDER BY a), 0) + 1, a)) AS piece FROM runs JOIN d USING (n)
), fronts AS (
  SELECT n, string_agg(piece, '' ORDER BY a) AS front, max(z) AS z, sum(z - a) AS removed, count(*) AS spans FROM pieces GROUP BY n
), kept AS (
  SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    b, coalesce(front, '') || hex(array_slice(b, coalesce(z, 0) + 1, octet_length(b))) AS h
  FROM d LEFT JOIN fronts USING (n)
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(h)) AS kept_sha256,
  CASE WHEN n_spans = 0 THEN decode(b) ELSE decode(unhex(array_to_string(list_transform(
    regexp_extract_all(h, '{CHARACTER}|{BROKEN}'),
    lambda c: CASE WHEN regexp_full_match(c, '{CHARACTER}') THEN c ELSE 'EFBFBD' END), ''))) END AS text
FROM kept
""".replace("{CHARACTER}", CHARACTER).replace("{BROKEN}", BROKEN)


def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.withColumn("held_out", held_out), model, keys=("doc_id", "held_out"))


def damaged(conversations):
    """The rows after the query's damage, chosen by crc32 of ``conv_id:turn``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(one("role"))
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    rows = conversations.withColumn("code", code).filter("code <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def op12_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    fixed = repair.Repair(damaged(rows), Scratch(spark))
    key = F.struct("conv_id").alias("conv")  # in a struct NULL equals NULL
    every = rows.select(key).distinct()
    found = fixed.summary().select(key, *NUMBERS, "audit")
    digests = fixed.digests().select(key, "digest")
    met = every.join(found, "conv", "left").join(digests, "conv", "left")
    return met.select(
        "conv.conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: crc32 of an ASCII string, bit by bit
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""
REPAIR_SQL = r"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS code FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserts(q, mid, letters, lines) AS (
  VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', E'
user:'), (0, 3, 'II', E'
user:
assistant:'),
    (1, 2, 'I', E'
user:'), (1, 3, 'II', E'
user:
assistant:'), (2, 3, 'I', E'
assistant:'), (3, 2, 'I', E'
user:')
), edits(mid, edit, initial, role, q) AS (
  VALUES (0, 'K', 's', NULL, 1), (0, 'K', 'u', NULL, 2), (1, 'K', 'u', NULL, 2), (2, 'K', 'a', NULL, 3), (3, 'K', 'u', NULL, 2),
    (0, 'R', NULL, 'user', 2), (1, 'R', NULL, 'user', 2), (2, 'R', NULL, 'assistant', 3), (3, 'R', NULL, 'user', 2),
    (0, 'D', NULL, NULL, 0), (1, 'D', NULL, NULL, 1), (2, 'D', NULL, NULL, 2), (3, 'D', NULL, NULL, 3)
), moves AS (
  SELECT inserts.q, letters || edit AS letters, lines, edit, initial, role, edits.q AS then_q,
    3 * length(letters) + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END AS price
  FROM inserts JOIN edits USING (mid)
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.then_q, min({
    'cost': (s.best.cost + m.price + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END)::BIGINT, 'audit': s.best.audit || m.letters,
    'lines': s.best.lines || m.lines || CASE m.edit WHEN 'D' THEN '' ELSE E'
' || coalesce(m.role, r.role) || ':' || r.text END})
  FROM steps s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
  JOIN moves m ON m.q = s.q AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.initial = r.initial)
  GROUP BY s.conv_id, s.i, m.then_q
), numbers AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ends(q, letters, lines) AS (
  VALUES (0, '', ''), (1, 'II', E'
user:
assistant:'), (2, 'I', E'
assistant:'), (3, '', '')
), repaired AS (
  SELECT s.conv_id, any_value(n) AS n,
    min({'cost': s.best.cost + 3 * length(e.letters), 'audit': s.best.audit || e.letters, 'lines': s.best.lines || e.lines}) AS best
  FROM steps s JOIN ends e USING (q) LEFT JOIN numbers x ON x.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.i = coalesce(x.n, 0) GROUP BY s.conv_id
)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM repaired r LEFT JOIN numbers x ON x.conv_id IS NOT DISTINCT FROM r.conv_id
""".replace("{CRC}", CRC_SQL.replace("{s}", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), Scratch(spark), components=4)

QUERIES = {"op1_bpe": op1_bpe, "op2_forest": op2_forest, "op3_minhash": op3_minhash, "op4_language": op4_language, "op5_quality": op5_quality, "op6_rollups": op6_rollups, "op7_urls": op7_urls, "op8_packing": op8_packing, "op9_phrases": op9_phrases, "op10_repeats": op10_repeats, "op11_toxicity": op11_toxicity, "op12_repair": op12_repair, "op13_whitening": op13_whitening}
ORACLE = {"op3_minhash": MINHASH_SQL, "op6_rollups": ROLLUPS_SQL, "op7_urls": URLS_SQL, "op10_repeats": REPEATS_SQL, "op12_repair": REPAIR_SQL}
