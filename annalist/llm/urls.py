"""URL filter by host-suffix and path-prefix expressions, with DataFrame functions only.

A rule is a host and a path. Every URL is expanded into the expressions that a rule could
have: each suffix of its host with each prefix of its path. Rules and expressions meet in
an equi-join on a short hash; the full digest then confirms the match.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import LOWER, UPPER

#: bits of the hash that the join uses; SHA-256 of the expression decides
PREFIX_BITS = 32
RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url):
    """Host (A-Z lower-cased) and path columns; both empty for NULL or without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(expression):
    return F.xxhash64(expression).bitwiseAND((1 << PREFIX_BITS) - 1)


def _expression(host, path):
    # a host holds no "/", so the two parts cannot be mixed up
    return F.concat(host, F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/ ")), path)


def _labels(host):
    """Number of labels of a host: one more than it has dots."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): hash prefix, digest, length; of contradicting rules ``block`` holds.

    Hosts are lower-cased. Rules with a NULL in any column are left out.
    """
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    clean = rules.filter("host is not null and path is not null and verdict is not null")
    single = clean.groupBy(host.alias("_host"), path.alias("_rule_path")).agg(F.max("verdict").alias("_verdict"))
    expression = _expression(F.col("_host"), F.col("_rule_path"))
    return single.select(
        _short(expression).alias("_short"),
        F.sha2(expression, 256).alias("_digest"),
        F.concat("_host", "_rule_path").alias("_rule"),
        F.length("_rule_path").alias("_path_length"),
        F.length("_host").alias("_host_length"),
        _labels("_host").alias("_labels"),
        "_verdict",
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's path. The
    longest rule (host and path together) wins; of equally long ones the longer host; a rule
    listed with both verdicts blocks. Without a fitting rule ``rule`` is NULL and the verdict
    ``default``. NULL URLs and those without ``://`` have an empty host and path. Repeated
    rows are judged alike, and other columns of ``pages`` are not read.

    Hosts are cut to the numbers of labels, and paths to the lengths, that rules have, which
    the longest rule bounds; so a row grows with the rules' hosts, however long its own is.
    Each different (host, path) is expanded once. Few rules are broadcast by the planner's size
    check, and expressions are not shuffled; many rules meet them in a sort-merge join, where
    an expression that most hosts have is split like any skewed key.
    """
    ready = prepared_rules(rules)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path"))
    lengths, labels = (F.array_sort(F.collect_set(c)) for c in ("_path_length", "_labels"))
    cuts = ready.agg(lengths.alias("lengths"), labels.alias("labels")).first()
    counts = F.array(*[F.lit(c) for c in cuts["labels"]]).cast("array<int>")
    suffixes = F.transform(F.filter(counts, lambda n: n <= _labels("_host")), lambda n: F.call_function("substring_index", F.col("_host"), F.lit("."), -n))
    cuts = F.array(*[F.lit(c) for c in cuts["lengths"]]).cast("array<int>")
    fitting = F.filter(cuts, lambda n: n <= F.length("_path"))
    places = rows.select("_host", "_path").filter("_host <> ''").distinct()
    spread = places.select("_host", "_path", F.explode(suffixes).alias("_suffix"))
    spread = spread.select("_host", "_path", "_suffix", F.explode(fitting).alias("_cut"))
    prefix = F.substring(F.col("_path"), F.lit(1), F.col("_cut"))
    spread = spread.select("_host", "_path", _expression(F.col("_suffix"), prefix).alias("_expression"))
    found = spread.withColumn("_short", _short(F.col("_expression"))).join(ready, "_short").filter(F.sha2("_expression", 256) == F.col("_digest"))
    weight = F.struct(F.length("_rule").alias("a"), F.col("_host_length").alias("b"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    best = found.groupBy("_host", "_path").agg(F.max(weight).alias("_best"))
    return rows.join(best, ["_host", "_path"], "left").select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
