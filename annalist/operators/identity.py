"""Mailmap resolution: many spellings of a person become one name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.scalars import EMPTY_EMAIL, EMPTY_NAME


def _rules(mailmap: DataFrame, by, with_name: bool) -> DataFrame:
    """One rule per match key, the latest, so the join cannot multiply rows."""
    rules = mailmap.filter(F.col("match_name").isNotNull() if with_name else F.col("match_name").isNull())
    keys = [F.lower("match_email").alias("_email")]
    if with_name:
        keys.append(F.lower("match_name").alias("_name"))
    rule = F.struct("canonical_name", "canonical_email")
    return rules.groupBy(*by, *keys).agg(
        F.max_by(rule, "rule_order").alias("_named_rule" if with_name else "_email_rule")
    )


#: shares that the rows of one name and e-mail are dealt to
SALTS = 16


def _given(value):
    return F.coalesce(F.trim(value) != "", F.lit(False))


def renamed_pairs(df: DataFrame, mailmap: DataFrame, name: str = "author_name", email: str = "author_email", by=()) -> DataFrame:
    """Different pairs ``_written``, ``_address`` of a name and an e-mail that the mailmap gives
    a name (``_renamed``); pairs that end up without name or e-mail are left out.

    Rows of one pair become one in the task that reads them, so rules meet pairs only. A rule
    that gives a name and an e-mail to match wins over an e-mail-only rule.
    """
    by = list(by)
    pairs = df.select(*by, F.col(name).alias("_written"), F.col(email).alias("_address")).distinct()
    keyed = pairs.withColumn("_email", F.lower("_address")).withColumn("_name", F.lower("_written"))
    joined = keyed.join(_rules(mailmap, by, True), [*by, "_email", "_name"], "left").join(
        _rules(mailmap, by, False), [*by, "_email"], "left"
    )
    rule = F.coalesce("_named_rule", "_email_rule")
    mapped_email = F.coalesce(rule["canonical_email"], F.col("_address"))
    found = joined.filter(rule.isNotNull() & _given(mapped_email))
    found = found.select(*by, "_written", "_address", F.coalesce(rule["canonical_name"], F.col("_written")).alias("_renamed"))
    return found.filter(_given(F.col("_renamed")))


def resolve_identities(
    df: DataFrame, mailmap: DataFrame, name: str = "author_name", email: str = "author_email", by=(), salts: int = SALTS
) -> DataFrame:
    """Replace ``name`` by the mailmap's name; ``email`` stays as written.

    Identities that end up without name or e-mail keep what they have, and placeholders
    stand for what is empty. Rows meet the renamed pairs in one left join on unique keys.
    A pair that holds most rows is dealt to ``salts`` shares by ``commit_id`` (or, without it,
    by all columns), and each renamed pair is sent to every share. Spark broadcasts the
    pairs when they are small. ``df`` is read twice, the first time for two columns.
    """
    by = list(by)
    pairs = renamed_pairs(df, mailmap, name, email, by)
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    # new names, as both sides of the join come from the same columns
    pairs = pairs.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_written", "_address", "_renamed", share.alias("_of_share"))
    spread = ["commit_id"] if "commit_id" in df.columns else df.columns
    rows = df.withColumn("_share", F.pmod(F.xxhash64(*spread), F.lit(salts).cast("long")))
    same = F.col(name).eqNullSafe(F.col("_written")) & (F.col(email) == F.col("_address"))
    same = same & (F.col("_share") == F.col("_of_share"))
    for key in by:
        same = same & (F.col(key) == F.col(f"_of_{key}"))
    joined = rows.join(pairs, same, "left")
    renamed = F.col("_renamed").isNotNull()
    new_name = F.when(renamed, F.col("_renamed")).otherwise(F.when(_given(F.col(name)), F.col(name)).otherwise(F.lit(EMPTY_NAME)))
    new_email = F.when(renamed | _given(F.col(email)), F.col(email)).otherwise(F.lit(EMPTY_EMAIL))
    return joined.select(
        *[new_name.alias(c) if c == name else new_email.alias(c) if c == email else F.col(c) for c in df.columns]
    )
