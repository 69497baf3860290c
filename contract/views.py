"""History tables derived from the driver's tables, so that operators run on their rows.

Each view is written once here and once in DuckDB's SQL (``oracle.py``), with integer
arithmetic only. All read whole tables.
"""

from pyspark.sql import functions as F

# Review durations on and beside every bin edge, by key modulo 14.
DURATIONS = (0, 1, 2, 3600, 3601, 86400, 86401, 604800, 604801, 1209601, 2592001, 94608000, 94608001, -5)

# Untidy paths, by key modulo 6.
PATHS = ("src/doc1.en", "src/.en", "src/README", "src/a.b.en", "src/.x.en", "src/f.")

#: reference time of the blame statistics: 2001-11-04 12:00 UTC
BLAME_AS_OF = 1004875200
#: Wednesday 2024-01-31 12:34:56 and Sunday 2024-01-28 09:00:00 UTC
EVENTS_AS_OF = 1706704496
EVENTS_AS_OF_SUNDAY = 1706432400


#: repositories of the keyed queries; the first holds more than half of all rows
REPOSITORIES = (0, 6, 7, 8, 9)


def repository(key):
    """The repository of a row by an integer key, in both SQL dialects."""
    return f"CASE WHEN ({key}) % 10 < 6 THEN 0 ELSE ({key}) % 10 END"


#: keyed queries: the view that is split into repositories, and the key
KEYED = {
    "commit_totals": ("commits", "walk_pos"),
    "review_bins": ("commits", "walk_pos"),
    "timezones": ("commits", "walk_pos"),
    "domains_others": ("commits", "walk_pos"),
    "recent_weeks": ("event_commits", "walk_pos"),
    "current_year_months": ("commits", "walk_pos"),
    "weekday_hour": ("event_commits", "walk_pos"),
    "weekday_hour_margins": ("commits", "walk_pos"),
    "commit_cells": ("commits", "walk_pos"),
    "history_2w": ("commits", "walk_pos"),
    "linear_history_w": ("linear", "CAST(commit_id AS BIGINT)"),
    "author_summary": ("commits", "walk_pos"),
    "top_authors": ("commits", "walk_pos"),
    "rank_month": ("commits", "walk_pos"),
    "rank_month_top3": ("commits", "walk_pos"),
    "author_of_year": ("commits", "walk_pos"),
    "contribution_others": ("blame", "CAST(filepath AS BIGINT)"),
    "top_files": ("blame", "CAST(filepath AS BIGINT)"),
    "lost_knowledge": ("blame", "CAST(filepath AS BIGINT)"),
}


def keyed(df, name):
    """A view with the repositories that the keyed form of a query gives it."""
    return df.selectExpr("*", f"{repository(KEYED[name][1])} as repo_id")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ntz):
    """Epoch seconds of a timestamp without zone, read as UTC."""
    return (
        f"(unix_date(cast({ntz} as date)) * 86400L"
        f" + (hour({ntz}) * 3600 + minute({ntz}) * 60 + cast(second({ntz}) as int)))"
    )


def commit_id(key):
    return f"lpad(cast({key} as string), 9, '0')"


def pick(key, values):
    """``values[key % len(values)]``"""
    listed = ", ".join(repr(v) for v in values)
    return f"element_at(array({listed}), cast({key} % {len(values)} as int) + 1)"


def newlines(text):
    return f"cast(length({text}) - length(replace({text}, '\\n', '')) as bigint)"


EMAIL = (
    "case when c_custkey % 17 = 0 then concat(c_name, '.', lower(c_mktsegment))"
    " else concat(c_name, '@', lower(c_mktsegment), '.example') end"
)
AUTHORED = f"{epoch('o_orderdate')} + (o_orderkey * 7919) % 86400"


def commit_files(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        f"{commit_id('l_orderkey')} as commit_id",
        "concat('src/p', l_partkey, '.py') as path",
        "cast(l_quantity as bigint) as l_quantity",
        "l_linenumber",
    )
    return lines.groupBy("commit_id", "path").agg(
        F.sum("l_quantity").alias("insertions"), F.sum("l_linenumber").alias("deletions")
    )


def file_changes(spark, sf_dir):
    """The first four lines of an order create a file, later ones remove one."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{commit_id('l_orderkey')} as commit_id",
        "concat('src/p', l_partkey, '.py') as path",
        "if(l_linenumber <= 4, 1, -1) as change",
    )


def _orders_and_customers(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"])


def raw_commits(spark, sf_dir):
    return _orders_and_customers(spark, sf_dir).selectExpr(
        f"{commit_id('o_orderkey')} as commit_id",
        "o_orderkey as walk_pos",
        "c_name as author_name",
        f"{EMAIL} as author_email",
        f"{AUTHORED} as author_timestamp",
        "cast((o_orderkey % 9 - 4) * 90 as int) as author_tz_offset",
        f"{AUTHORED} + {pick('o_orderkey', DURATIONS)} as committer_timestamp",
        "if(o_orderkey % 11 = 0, '', concat('Committer ', c_mktsegment)) as committer_name",
        "if(o_orderkey % 11 = 1, null, 'committer@team.example') as committer_email",
    )


def commits(spark, sf_dir, lines=False):
    """Commits; with ``lines`` also the lines of their files, 0 for merges."""
    history = _orders_and_customers(spark, sf_dir).selectExpr(
        "o_orderkey",
        f"{commit_id('o_orderkey')} as commit_id",
        "o_orderkey as walk_pos",
        "o_orderpriority = '1-URGENT' as is_merge_commit",
        "c_name as author_name",
        f"{EMAIL} as author_email",
        "cast((o_orderkey % 9 - 4) * 90 as int) as author_tz_offset",
        f"{AUTHORED} as author_timestamp",
        f"cast({pick('o_orderkey', DURATIONS)} as bigint) as review_duration",
    )
    if not lines:
        return history.selectExpr("* except (o_orderkey)", "0L as insertions", "0L as deletions")
    return history.join(_order_lines(spark, sf_dir), "o_orderkey", "left").selectExpr(
        "* except (o_orderkey, _insertions, _deletions)",
        "if(is_merge_commit, 0, coalesce(_insertions, 0)) as insertions",
        "if(is_merge_commit, 0, coalesce(_deletions, 0)) as deletions",
    )


def _order_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as o_orderkey", "cast(l_quantity as bigint) as l_quantity", "l_linenumber"
    )
    return lines.groupBy("o_orderkey").agg(
        F.sum("l_quantity").alias("_insertions"), F.sum("l_linenumber").alias("_deletions")
    )


def event_commits(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) as commit_id",
        "event_id as walk_pos",
        "false as is_merge_commit",
        "concat('user', user_id) as author_name",
        "cast((event_id % 9 - 4) * 90 as int) as author_tz_offset",
        f"{epoch('ts')} as author_timestamp",
        "event_id % 7 as insertions",
        "event_id % 3 as deletions",
    )


def linear(spark, sf_dir):
    """A cheap stand-in for the first-parent history."""
    orders = table(spark, sf_dir, "orders")
    return orders.join(_order_lines(spark, sf_dir), "o_orderkey", "left").selectExpr(
        f"{commit_id('o_orderkey')} as commit_id",
        f"{AUTHORED} as committer_timestamp",
        "100 + o_orderkey % 50 as files_count",
        "coalesce(_insertions, 0) as insertions",
        "coalesce(_deletions, 0) as deletions",
    )


def parents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.selectExpr(
        f"{commit_id('o_orderkey')} as commit_id",
        "posexplode(if(o_orderpriority = '1-URGENT',"
        " array(o_orderkey + 1 + o_orderkey % 3, o_orderkey + 4 + o_orderkey % 7),"
        " array(o_orderkey + 1 + o_orderkey % 3))) as (ordinal, o_orderkey)",
    )
    # a parent must be a commit; keys are dense
    return edges.join(orders.select("o_orderkey"), "o_orderkey", "left_semi").selectExpr(
        "commit_id", f"{commit_id('o_orderkey')} as parent_id", "ordinal"
    )


def head(spark, sf_dir, share=0):
    """Head commit: key 0, or the key a third of the way in."""
    orders = table(spark, sf_dir, "orders")
    if not share:
        return orders.filter("o_orderkey = 0").selectExpr(f"{commit_id('o_orderkey')} as commit_id")
    return orders.selectExpr(f"{commit_id(f'count(*) div {share}')} as commit_id")


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        f"{pick('doc_id', PATHS)} as file",
        "source = 'src3' as is_binary",
        "n_chars as size_bytes",
        f"{newlines('text')} as lines_count",
    )


def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "url as file",
        "page_id % 5 = 0 as is_binary",
        "cast(length(html) as bigint) as size_bytes",
        f"{newlines('html')} as lines_count",
    )


def blame(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as string) as committer_name",
        "cast(l_quantity as bigint) as lines_count",
        f"{epoch('l_shipdate')} as timestamp",
        "cast(l_orderkey as string) as filepath",
    )


def blame_lines(spark, sf_dir):
    """Lines of part files by the commit that last changed them, two revisions."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_linenumber <= 4, 'HEAD', 'old') as revision",
        "concat('p', l_partkey) as filepath",
        f"{commit_id('l_orderkey')} as commit_id",
        "cast(l_quantity as bigint) as lines_count",
    )


def part_files(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "concat('p', p_partkey) as file",
        "p_type = 'ECONOMY' as is_binary",
        "0L as size_bytes",
        "0L as lines_count",
    )


def submodules(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_brand = 'Brand#17'").selectExpr("concat('p', p_partkey) as path")


SEPARATOR = "\x1f"


def _lines(df, *parts):
    """Rows written as lines of an export."""
    text = ", ".join(f"cast({p} as string)" for p in parts)
    return df.selectExpr("'repo' as repo_id", f"array_join(array({text}), '{SEPARATOR}') as value")


def log_lines(spark, sf_dir):
    """The commit log as the export script writes it: empty signatures and roots included,
    quoted paths with a quote, a control character and a backslash, binary files."""
    ordered = parents(spark, sf_dir).groupBy("commit_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(ordinal, parent_id))), x -> x.parent_id), ' ') as _parents")
    )
    minutes = "abs(author_tz_offset)"
    zone = (
        "concat(if(author_tz_offset < 0, '-', '+'),"
        f" lpad(cast({minutes} div 60 as string), 2, '0'), lpad(cast({minutes} % 60 as string), 2, '0'))"
    )
    commits = _lines(
        raw_commits(spark, sf_dir).join(ordered, "commit_id", "left"),
        "'C'", "walk_pos", "commit_id", "coalesce(_parents, '')", "author_name", "author_email", "author_timestamp", zone,
        "committer_name", "coalesce(committer_email, '')", "committer_timestamp",
    )
    quoted = r"""concat('"src/', '\\"', '\\001', '\\\\', l_partkey, '"')"""
    path = f"if(l_partkey % 5 = 0, {quoted}, concat('src/p', l_partkey))"
    lines = table(spark, sf_dir, "lineitem")
    number = "if(l_partkey % 9 = 0, '-', cast(cast({} as bigint) as string))"
    files = _lines(lines, "'F'", commit_id("l_orderkey"), number.format("l_quantity"), number.format("l_linenumber"), path)
    return commits.unionByName(files)


def tree_lines(spark, sf_dir):
    """File listing with submodules, quoted paths, files without a size, binary files."""
    part = table(spark, sf_dir, "part")
    quoted = r"""concat('"d', '\\"', '\\t', p_partkey, '"')"""
    path = f"if(p_partkey % 5 = 0, {quoted}, concat('d/p', p_partkey))"
    kind = "if(p_brand = 'Brand#17', 'commit', 'blob')"
    entries = _lines(part, "'T'", "'HEAD'", kind, "if(p_partkey % 4 = 1, '-', cast(p_partkey * 3 as string))", path)
    counts = _lines(part, "'N'", "'HEAD'", "if(p_partkey % 9 = 0, '-', cast(p_partkey % 50 as string))", path)
    return entries.unionByName(counts)


def ref_lines(spark, sf_dir):
    """References: branches, lightweight and annotated tags, two tags on every third commit."""
    tagged = table(spark, sf_dir, "orders").filter("o_totalprice > 250000")
    key = commit_id("o_orderkey")
    nothing = ["''"] * 4
    branch = _lines(tagged, "o_orderkey * 2", "concat('refs/heads/b', o_orderkey)", "'commit'", key, *nothing, "''")
    annotated = _lines(
        tagged.filter("o_orderkey % 3 = 1"),
        "o_orderkey * 2", "concat('refs/tags/x', o_orderkey)", "'tag'", "concat('t', o_orderkey)", key,
        "concat('v', o_orderkey)", "'Release Master'", "'<release@team.example>'", epoch("o_orderdate"),
    )
    light = _lines(
        tagged.filter("o_orderkey % 3 <> 1"), "o_orderkey * 2", "concat('refs/tags/r/', o_orderkey)", "'commit'", key, *nothing, "''"
    )
    late = _lines(
        tagged.filter("o_orderkey % 3 = 0"), "o_orderkey * 2 + 1", "concat('refs/tags/late', o_orderkey)", "'commit'", key, *nothing, "''"
    )
    return branch.unionByName(annotated).unionByName(light).unionByName(late)


def mailmap_lines(spark, sf_dir):
    """Rules by e-mail and by name and e-mail, both for some people, later rules over earlier ones, comments."""
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", f"{EMAIL} as email")

    def rules(which, order, text):
        return people.filter(f"c_custkey % 6 = {which}").selectExpr(
            "'repo' as repo_id", f"{text} as value", f"c_custkey * 4 + {order} as rule_order"
        )

    by_mail = "concat('Mail ', c_custkey, ' <', upper(email), '>')"
    early = "concat('Early ', c_custkey, ' <', email, '> # old')"
    by_name = "concat('{} ', c_custkey, ' <new@team.example> ', upper(c_name), ' <', email, '>')"
    parts = [
        rules(0, 0, by_mail),
        rules(0, 1, by_name.format("Both")),
        rules(1, 0, early),
        rules(1, 1, by_mail),
        rules(2, 0, by_name.format("Name")),
        rules(3, 0, "concat('# Comment <', email, '>')"),
        rules(4, 0, "concat('<other@team.example> <', email, '>')"),
        rules(5, 0, "'no rule'"),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def tag_refs(spark, sf_dir):
    """The most expensive orders are tagged; finished ones by a lightweight tag."""
    annotated = "o_orderstatus <> 'F'"
    return table(spark, sf_dir, "orders").filter("o_totalprice > 498500").selectExpr(
        f"{commit_id('o_orderkey')} as commit_id",
        "concat('v', o_orderkey) as tag_name",
        f"if({annotated}, 'Release Master', null) as tagger_name",
        f"if({annotated}, {epoch('o_orderdate')} + 86400, null) as tagger_time",
        "o_orderkey as ref_order",
    )


def mailmap(spark, sf_dir):
    """Customers of one segment are other spellings of their neighbours."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").selectExpr(
        "concat('Customer#', lpad(cast(c_custkey - 1 as string), 9, '0')) as canonical_name",
        "cast(null as string) as canonical_email",
        "if(c_nationkey < 12, upper(c_name), null) as match_name",
        f"upper({EMAIL}) as match_email",
        "c_custkey as rule_order",
    )


def crowded_commits(spark, sf_dir):
    """Half of the commits are of one person."""
    return raw_commits(spark, sf_dir).selectExpr(
        "* except (author_name, author_email)",
        "if(walk_pos % 2 = 0, 'Build Robot', author_name) as author_name",
        "if(walk_pos % 2 = 0, 'robot@team.example', author_email) as author_email",
    )


def crowded_mailmap(spark, sf_dir):
    """The rules, and one for that person."""
    robot = table(spark, sf_dir, "region").filter("r_regionkey = 0").selectExpr(
        "'Builder' as canonical_name", "cast(null as string) as canonical_email", "'build robot' as match_name",
        "'ROBOT@team.example' as match_email", "0L as rule_order",
    )
    return mailmap(spark, sf_dir).unionByName(robot)
