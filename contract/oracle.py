"""SQL equivalents of the queries, for DuckDB on the driver's tables.

``{{name}}`` in a statement is replaced by the history view of that name, written here as
a common table expression; views may use other views.
"""

import re

from contract.views import BLAME_AS_OF, DURATIONS, EVENTS_AS_OF, EVENTS_AS_OF_SUNDAY, KEYED, PATHS, REPOSITORIES, repository


def _case(key, values):
    arms = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


VIEWS = {
    "raw_commits": f"""
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS commit_id, o_orderkey AS walk_pos,
               c_name AS author_name,
               c_name || CASE WHEN c_custkey % 17 = 0 THEN '.' || lower(c_mktsegment)
                              ELSE '@' || lower(c_mktsegment) || '.example' END AS author_email,
               CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 7919) % 86400 AS author_timestamp,
               (o_orderkey % 9 - 4) * 90 AS author_tz_offset,
               o_orderpriority = '1-URGENT' AS is_merge_commit,
               {_case('o_orderkey', DURATIONS)} AS review_duration,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Committer ' || c_mktsegment END AS committer_name,
               CASE WHEN o_orderkey % 11 = 1 THEN NULL ELSE 'committer@team.example' END AS committer_email
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "commit_files": """
        SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS commit_id, 'src/p' || l_partkey || '.py' AS path,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS insertions,
               CAST(sum(l_linenumber) AS BIGINT) AS deletions
        FROM lineitem GROUP BY ALL""",
    "commit_lines": """
        SELECT commit_id, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions
        FROM {{commit_files}} GROUP BY commit_id""",
    "file_changes": """
        SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS commit_id, CASE WHEN l_linenumber <= 4 THEN 1 ELSE -1 END AS change
        FROM lineitem""",
    "commits": """
        SELECT c.commit_id, walk_pos, is_merge_commit, author_name, author_email, author_tz_offset, author_timestamp,
               review_duration,
               CASE WHEN is_merge_commit THEN 0 ELSE coalesce(insertions, 0) END AS insertions,
               CASE WHEN is_merge_commit THEN 0 ELSE coalesce(deletions, 0) END AS deletions,
               make_timestamp(author_timestamp * 1000000) AS ts
        FROM {{raw_commits}} c LEFT JOIN {{commit_lines}} l ON c.commit_id = l.commit_id""",
    "event_commits": """
        SELECT event_id AS walk_pos, 'user' || user_id AS author_name, (event_id % 9 - 4) * 90 AS author_tz_offset,
               CAST(floor(epoch(ts)) AS BIGINT) AS author_timestamp, date_trunc('second', ts) AS ts,
               event_id % 7 AS insertions, event_id % 3 AS deletions
        FROM events""",
    "linear": """
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS commit_id,
               make_timestamp((CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 7919) % 86400) * 1000000) AS ts,
               100 + o_orderkey % 50 AS files_count,
               coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions
        FROM orders LEFT JOIN {{commit_lines}} ON commit_id = lpad(CAST(o_orderkey AS VARCHAR), 9, '0')""",
    "parents": """
        SELECT o_orderkey AS child, unnest(CASE WHEN o_orderpriority = '1-URGENT'
                 THEN [o_orderkey + 1 + o_orderkey % 3, o_orderkey + 4 + o_orderkey % 7]
                 ELSE [o_orderkey + 1 + o_orderkey % 3] END) AS parent,
               unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN [0, 1] ELSE [0] END) AS ordinal
        FROM orders""",
    "edges": """
        SELECT child, parent, ordinal FROM {{parents}} WHERE parent IN (SELECT o_orderkey FROM orders)""",
    "files": f"""
        SELECT {_case('doc_id', PATHS)} AS file, source = 'src3' AS is_binary, n_chars AS size_bytes,
               length(text) - length(replace(text, chr(10), '')) AS lines_count
        FROM documents""",
    "page_files": """
        SELECT url AS file, page_id % 5 = 0 AS is_binary, length(html) AS size_bytes,
               length(html) - length(replace(html, chr(10), '')) AS lines_count
        FROM pages""",
    "blame": """
        SELECT CAST(l_suppkey AS VARCHAR) AS committer_name, CAST(l_quantity AS BIGINT) AS lines_count,
               CAST(epoch(l_shipdate) AS BIGINT) AS ts, CAST(l_orderkey AS VARCHAR) AS filepath
        FROM lineitem""",
    "tag_refs": """
        SELECT o_orderkey AS walk_pos, 'v' || o_orderkey AS tag_name,
               CASE WHEN o_orderstatus <> 'F' THEN 'Release Master' END AS tagger_name,
               CASE WHEN o_orderstatus <> 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) + 86400 END AS tagger_time
        FROM orders WHERE o_totalprice > 498500""",
    "assigned": """
        SELECT p.commit_id, p.walk_pos, t.tag_name, t.tagger_name, t.tagger_time, commit_author, commit_time, is_merge
        FROM (SELECT c.commit_id, c.walk_pos, c.author_name AS commit_author, c.author_timestamp AS commit_time,
                     c.is_merge_commit AS is_merge,
                     max(t.walk_pos) OVER (ORDER BY c.walk_pos ROWS UNBOUNDED PRECEDING) AS at
              FROM {{raw_commits}} c LEFT JOIN {{tag_refs}} t ON c.walk_pos = t.walk_pos) p
        LEFT JOIN {{tag_refs}} t ON p.at = t.walk_pos""",
    "mailmap": """
        SELECT c_nationkey < 12 AS by_name, 'Customer#' || lpad(CAST(c_custkey - 1 AS VARCHAR), 9, '0') AS canonical_name, c_name,
               c_name || CASE WHEN c_custkey % 17 = 0 THEN '.' || lower(c_mktsegment)
                              ELSE '@' || lower(c_mktsegment) || '.example' END AS match_email
        FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "mapped": """
        SELECT r.* REPLACE (coalesce(m.canonical_name, r.author_name) AS author_name)
        FROM {{raw_commits}} r LEFT JOIN {{mailmap}} m
          ON lower(m.match_email) = lower(r.author_email) AND (NOT m.by_name OR lower(m.c_name) = lower(r.author_name))""",
    "summary": """
        SELECT author_name, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
               count(*) FILTER (is_merge_commit) AS merge_commits_count,
               min(author_timestamp) AS first_commit_date, max(author_timestamp) AS latest_commit_date,
               count(DISTINCT author_timestamp // 86400) AS active_days_count,
               greatest(1, (max(author_timestamp) - min(author_timestamp)) // 86400) AS contributed_days_count,
               count(*) AS commits_count
        FROM {{commits}} GROUP BY author_name""",
    "monthly": """
        SELECT strftime(ts, '%Y-%m') AS month, author_name, count(*) AS commits_count FROM {{commits}} GROUP BY ALL""",
    "yearly": """
        SELECT year(ts) AS year, author_name, count(*) AS commits_count FROM {{commits}} GROUP BY ALL""",
    "chain": """
        SELECT x FROM (WITH RECURSIVE walk(x) AS (
            SELECT CAST(0 AS BIGINT) UNION
            SELECT parent FROM walk JOIN {{edges}} ON child = x AND ordinal = 0) SELECT x FROM walk)""",
    "by_extension": """
        SELECT is_binary, {ext} AS extension, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
               CAST(sum(lines_count) AS BIGINT) AS lines_count, count(*) AS files_count
        FROM {files} GROUP BY ALL""",
}

def _extension(path):
    base = f"split_part({path}, '/', -1)"
    return (
        f"CASE WHEN NOT contains({base}, '.') OR ({base}[1] = '.' AND NOT contains({base}[2:], '.')) THEN {base} "
        f"ELSE split_part({base}, '.', -1) END"
    )


def _domain(email):
    return (
        f"CASE WHEN length({email}) - length(replace({email}, '@', '')) = 1 "
        f"THEN split_part({email}, '@', 2) ELSE 'unknown' END"
    )


def _expand(text, wrapped=None):
    """Views written out; ``wrapped`` may hold a view's name and text around its rows."""

    def view(match):
        name = match.group(1)
        inner = f"({_expand(VIEWS[name], wrapped)})"
        return f"({wrapped[name].replace('{rows}', inner)})" if wrapped and name in wrapped else inner

    return re.sub(r"\{\{(\w+)\}\}", view, text)


ORACLE, TEXTS = {}, {}


def sql(name, text):
    TEXTS[name], ORACLE[name] = text, _expand(text)


def keyed_sql(name, view, key):
    """The statement run for each repository, a repository being the rows of ``view`` with one key."""
    each = [
        f"SELECT CAST({r} AS BIGINT) AS repo_id, q.* FROM ("
        + _expand(TEXTS[name], {view: f"SELECT * FROM {{rows}} v WHERE {repository(key)} = {r}"})
        + ") q"
        for r in REPOSITORIES
    ]
    ORACLE[f"{name}_keyed"] = " UNION ALL ".join(each)


# --- totals and distributions -------------------------------------------------------

TOTALS = """
    SELECT count(*) AS commits_count, count(*) FILTER (is_merge_commit) AS merge_commits_count,
           min(author_timestamp) AS first_commit_date, max(author_timestamp) AS last_commit_date,
           count(DISTINCT author_timestamp // 86400) AS active_days_count,
           (max(author_timestamp) - min(author_timestamp)) // 86400 AS age_days
    FROM {{commits}}"""
sql("commit_totals", TOTALS)
sql("commits_count", "SELECT count(*) AS commits_count FROM {{commits}}")
LINES = """
    SELECT CAST(sum(insertions) AS BIGINT) AS added_lines_count, CAST(sum(deletions) AS BIGINT) AS removed_lines_count,
           CAST(sum(insertions) - sum(deletions) AS BIGINT) AS total_lines_count FROM {{linear}}"""
sql("line_totals", LINES)
sql("active_days", "SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) AS active_days_count FROM {{commits}}")
# The review-duration bins.
BINS = """(VALUES
        (0, '= 0s', -1, 1), (1, '< 1hour', 1, 3600), (2, '< 1day', 3600, 86400), (3, '< 2days', 86400, 172800),
        (4, '< 1week', 172800, 604800), (5, '< 2weeks', 604800, 1209600), (6, '< 1month', 1209600, 2592000),
        (7, '< 6 months', 2592000, 15811200), (8, '< 3 years', 15811200, 94608000)) bins(bin_order, bin, low, high)"""
BIN = f"(SELECT bin FROM {BINS} WHERE review_duration > low AND review_duration <= high) AS bin"
sql(
    "review_bins",
    f"""
    SELECT CAST(bin_order AS BIGINT) AS bin_order, bin, count(commit_id) AS commits_count
    FROM {BINS} LEFT JOIN {{{{commits}}}} ON review_duration > low AND review_duration <= high
    GROUP BY ALL""",
)
sql(
    "timezones",
    """
    SELECT CAST(author_tz_offset AS BIGINT) AS author_tz_offset,
           CASE WHEN author_tz_offset < 0 THEN '-' ELSE '+' END
             || lpad(CAST(abs(author_tz_offset) // 60 AS VARCHAR), 2, '0')
             || lpad(CAST(abs(author_tz_offset) % 60 AS VARCHAR), 2, '0') AS timezone,
           count(*) AS commits_count
    FROM {{commits}} GROUP BY ALL""",
)
DOMAINS = f"SELECT {_domain('author_email')} AS domain, count(*) AS commits_count FROM {{{{commits}}}} GROUP BY ALL"
sql("domains", DOMAINS)
sql(
    "domains_others",
    f"""
    WITH d AS (SELECT *, row_number() OVER (ORDER BY commits_count DESC, domain) AS r FROM ({DOMAINS}))
    SELECT CASE WHEN r <= 3 THEN r END AS rank, CASE WHEN r <= 3 THEN domain ELSE 'Others' END AS domain,
           r > 3 AS is_others, CAST(sum(commits_count) AS BIGINT) AS commits_count
    FROM d GROUP BY ALL""",
)


def _recent(as_of, weeks):
    # last edge: the coming Sunday, never the day itself; `low` keeps the time of day
    return f"""
    WITH t AS (SELECT make_timestamp({as_of}::BIGINT * 1000000) AS today),
    e AS (SELECT today, CAST(today AS DATE) + CAST(7 - isodow(today) % 7 AS INTEGER) AS last_edge,
                 today + to_days(CAST(CASE WHEN isodow(today) = 7 THEN 7 ELSE 8 - isodow(today) END - 7 * {weeks}
                     AS INTEGER)) AS low FROM t),
    w AS (SELECT CAST(i AS BIGINT) AS weeks_ago, last_edge - CAST(7 * (i + 1) AS INTEGER) AS s,
                 last_edge - CAST(7 * i AS INTEGER) AS f, low
          FROM e, range({weeks}) r(i))
    SELECT weeks_ago, strftime(s, '%Y-%m-%d') AS week_start, strftime(f, '%Y-%m-%d') AS week_end,
           count(author_name) AS commits_count
    FROM w LEFT JOIN {{{{event_commits}}}} c ON c.ts > s AND c.ts <= f AND c.ts >= low GROUP BY ALL"""


sql("recent_weeks", _recent(EVENTS_AS_OF, 4))
sql("recent_weeks_on_sunday", _recent(EVENTS_AS_OF_SUNDAY, 32))
sql(
    "month_of_year",
    "SELECT month(ts) AS month, strftime(ts, '%b') AS month_name, count(*) AS commits_count FROM {{commits}} GROUP BY ALL",
)
LOCAL = """
    SELECT isodow(ts + to_minutes(author_tz_offset)) - 1 AS weekday, hour(ts + to_minutes(author_tz_offset)) AS hour
    FROM {view}"""
CELLS = f"""
    SELECT weekday, strftime(DATE '2024-01-01' + CAST(weekday AS INTEGER), '%A') AS weekday_name, hour,
           count(l.weekday) AS commits_count
    FROM (SELECT i // 24 AS weekday, i % 24 AS hour FROM range(168) r(i)) LEFT JOIN ({LOCAL}) l USING (weekday, hour)
    GROUP BY ALL"""
sql("weekday_hour", CELLS.format(view="{{event_commits}}"))
sql(
    "weekday_hour_matrix",
    "SELECT weekday, "
    + ", ".join(f"count(*) FILTER (hour = {h}) AS h{h}" for h in range(24))
    + f" FROM ({LOCAL.format(view='{{commits}}')}) GROUP BY weekday",
)
sql(
    "weekday_hour_margins",
    f"""
    WITH c AS (SELECT weekday, hour, count(*) AS n FROM ({LOCAL.format(view="{{commits}}")}) GROUP BY ALL)
    SELECT weekday, NULL AS hour, CAST(sum(n) AS BIGINT) AS commits_count, max(n) AS cell_max FROM c GROUP BY weekday
    UNION ALL SELECT NULL, hour, CAST(sum(n) AS BIGINT), max(n) FROM c GROUP BY hour
    UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT), max(n) FROM c""",
)
sql(
    "heat_levels",
    f"""
    WITH c AS ({CELLS.format(view="{{commits}}")})
    SELECT *, CAST(floor(CAST(commits_count AS DOUBLE) / (SELECT max(commits_count) FROM c) * 9) AS BIGINT) AS heat
    FROM c""",
)

# --- series -------------------------------------------------------------------------


def _series(bucket, step, label, view="{{commits}}"):
    return f"""
    WITH b AS (SELECT {bucket} AS p, count(*) AS n FROM {view} GROUP BY ALL),
    s AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL {step})) AS p FROM b)
    SELECT {label} AS period, CAST(coalesce(n, 0) AS BIGINT) AS commits_count FROM s LEFT JOIN b ON s.p = b.p"""


DAY_LABEL = "strftime(s.p, '%Y-%m-%d')"
SUNDAY = "date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAY"
QUARTER_END = "strftime(last_day(CAST(s.p + INTERVAL 2 MONTH AS DATE)), '%Y-%m-%d')"
sql("history_d", _series("date_trunc('day', ts)::TIMESTAMP", "1 DAY", DAY_LABEL))
sql("history_w", _series(SUNDAY, "7 DAY", DAY_LABEL))
sql(
    "history_w_wed",
    _series("date_trunc('week', ts - INTERVAL 3 DAY)::TIMESTAMP + INTERVAL 9 DAY", "7 DAY", DAY_LABEL),
)
sql("history_m", _series("date_trunc('month', ts)::TIMESTAMP", "1 MONTH", "strftime(last_day(s.p::DATE), '%Y-%m-%d')"))
sql("history_ms", _series("date_trunc('month', ts)::TIMESTAMP", "1 MONTH", DAY_LABEL))
sql("history_q", _series("date_trunc('quarter', ts)::TIMESTAMP", "3 MONTH", QUARTER_END))
sql("history_qs", _series("date_trunc('quarter', ts)::TIMESTAMP", "3 MONTH", DAY_LABEL))
sql("history_y", _series("date_trunc('year', ts)::TIMESTAMP", "12 MONTH", "strftime(s.p, '%Y') || '-12-31'"))
sql(
    "history_2w",
    f"""
    WITH w AS (SELECT CAST({SUNDAY} AS DATE) AS e FROM {{{{commits}}}}),
    a AS (SELECT min(e) AS e0, max(e) AS e1 FROM w),
    b AS (SELECT e0 + CAST(((e - e0) + 13) // 14 * 14 AS INTEGER) AS p FROM w, a),
    s AS (SELECT e0 + CAST(14 * i AS INTEGER) AS p FROM a, range(10000) r(i) WHERE 14 * i < (e1 - e0) + 14)
    SELECT strftime(s.p, '%Y-%m-%d') AS period, count(b.p) AS commits_count FROM s LEFT JOIN b ON s.p = b.p GROUP BY ALL""",
)
sql(
    "history_2y",
    """
    WITH y AS (SELECT year(ts) AS y FROM {{commits}}), a AS (SELECT min(y) AS y0, max(y) AS y1 FROM y),
    s AS (SELECT y0 + 2 * i AS p FROM a, range(100) r(i) WHERE y0 + 2 * i <= y1)
    SELECT s.p || '-01-01' AS period, count(y.y) AS commits_count FROM s LEFT JOIN y ON y.y IN (s.p, s.p + 1) GROUP BY ALL""",
)
sql(
    "history_b",
    """
    WITH d AS (SELECT CAST(ts AS DATE) - CAST(greatest(isodow(ts) - 5, 0) AS INTEGER) AS p FROM {{commits}}),
    s AS (SELECT CAST(unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS p FROM d)
    SELECT strftime(s.p, '%Y-%m-%d') AS period, count(d.p) AS commits_count
    FROM s LEFT JOIN d ON s.p = d.p WHERE isodow(s.p) <= 5 GROUP BY ALL""",
)
sql(
    "history_bm",
    """
    WITH m AS (SELECT unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m),
    f AS (SELECT last_day(m::DATE) - CAST(greatest(isodow(last_day(m::DATE)) - 5, 0) AS INTEGER) AS f FROM m),
    p AS (SELECT f, lag(f) OVER (ORDER BY f) AS before FROM f),
    c AS (SELECT CAST(ts AS DATE) AS d FROM {{commits}}),
    n AS (SELECT f, count(d) AS n FROM p LEFT JOIN c ON d > before AND d <= f GROUP BY ALL)
    SELECT strftime(f, '%Y-%m-%d') AS period, n AS commits_count FROM n
    WHERE f BETWEEN (SELECT min(f) FROM n WHERE n > 0) AND (SELECT max(f) FROM n WHERE n > 0)""",
)


def _clock_series(seconds):
    return f"""
    WITH o AS (SELECT min(author_timestamp) // 86400 * 86400 AS o FROM {{{{event_commits}}}}),
    b AS (SELECT (author_timestamp - o) // {seconds} AS i, any_value(o) AS o, count(*) AS n FROM {{{{event_commits}}}}, o
          GROUP BY 1),
    s AS (SELECT unnest(range(min(i), max(i) + 1)) AS i, min(o) AS o FROM b)
    SELECT s.o + s.i * {seconds} AS period, coalesce(n, 0) AS commits_count FROM s LEFT JOIN b ON s.i = b.i"""


sql("history_h", _clock_series(3600))
sql("history_1d12h", _clock_series(129600))
sql(
    "history_sm",
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS d FROM {{commits}}),
    b AS (SELECT CASE WHEN d = last_day(d) THEN d WHEN day(d) >= 15 THEN make_date(year(d), month(d), 15)
                      ELSE CAST(date_trunc('month', d) AS DATE) - 1 END AS p FROM d),
    m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(p)), max(p)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m FROM b),
    s AS (SELECT m + 14 AS p FROM m UNION ALL SELECT last_day(m) FROM m)
    SELECT strftime(s.p, '%Y-%m-%d') AS period, count(b.p) AS commits_count FROM s LEFT JOIN b ON s.p = b.p
    WHERE s.p BETWEEN (SELECT min(p) FROM b) AND (SELECT max(p) FROM b) GROUP BY ALL""",
)
sql("history_5h", _clock_series(18000))
sql("history_90min", _clock_series(5400))
sql(
    "year_month",
    f"""SELECT CAST(period[:4] AS BIGINT) AS year, CAST(period[6:7] AS BIGINT) AS month, commits_count
    FROM ({ORACLE["history_m"]})""",
)
sql(
    "current_year_months",
    f"""
    WITH y AS (SELECT year(make_timestamp({BLAME_AS_OF}::BIGINT * 1000000)) AS y)
    SELECT y AS year, i AS month, strftime(make_date(y, i, 1), '%b') AS month_name, count(c.ts) AS commits_count
    FROM y, range(1, 13) r(i) LEFT JOIN {{{{commits}}}} c ON year(c.ts) = y AND month(c.ts) = i GROUP BY ALL""",
)


def _line_series(bucket, step, label, view="{{linear}}"):
    return f"""
    WITH b AS (SELECT {bucket} AS p, CAST(sum(insertions) AS BIGINT) AS ins, CAST(sum(deletions) AS BIGINT) AS del,
                      CAST(sum(files_count) AS DOUBLE) / count(*) AS files FROM {view} GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL {step})) AS p FROM b),
    j AS (SELECT s.p, CAST(sum(coalesce(ins, 0)) OVER w AS BIGINT) AS insertions,
                 CAST(sum(coalesce(del, 0)) OVER w AS BIGINT) AS deletions,
                 last_value(files IGNORE NULLS) OVER w AS files_count
          FROM s LEFT JOIN b ON s.p = b.p WINDOW w AS (ORDER BY s.p ROWS UNBOUNDED PRECEDING))
    SELECT {label} AS period, insertions, deletions, files_count, insertions - deletions AS lines_count FROM j s"""


sql("linear_history_w", _line_series(SUNDAY, "7 DAY", DAY_LABEL))
MONTH_SERIES = _line_series(
    "date_trunc('month', ts)::TIMESTAMP", "1 MONTH", "strftime(last_day(s.p::DATE), '%Y-%m-%d')"
)
sql("linear_history_m", MONTH_SERIES)
sql(
    "linear_history_6h",
    _line_series(
        "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')",
        "6 HOUR",
        "CAST(epoch(s.p) AS BIGINT)",
        "(SELECT *, 100 + walk_pos % 50 AS files_count FROM {{event_commits}})",
    ),
)

# --- authors ------------------------------------------------------------------------

sql("author_summary", "SELECT * FROM {{summary}}")
sql("author_summary_of_rollup", "SELECT * FROM {{summary}}")
sql("author_get", "SELECT * FROM {{summary}} WHERE author_name = 'Customer#000000010'")
sql(
    "author_days",
    """
    SELECT author_name, author_timestamp // 86400 AS day, count(*) AS commits_count,
           count(*) FILTER (is_merge_commit) AS merge_commits_count, CAST(sum(insertions) AS BIGINT) AS insertions,
           CAST(sum(deletions) AS BIGINT) AS deletions, min(author_timestamp) AS first_timestamp,
           max(author_timestamp) AS last_timestamp
    FROM {{commits}} GROUP BY 1, 2""",
)
sql(
    "authors_sorted",
    """SELECT author_name, insertions, row_number() OVER (ORDER BY insertions DESC, author_name) AS rank
    FROM {{summary}}""",
)
sql("author_names", "SELECT DISTINCT author_name FROM {{commits}}")
sql("authors_count", "SELECT count(DISTINCT author_name) AS authors_count FROM {{commits}}")
RANKED = "SELECT *, row_number() OVER (ORDER BY commits_count DESC, author_name) AS rank FROM {{summary}}"
sql(
    "top_authors",
    f"""
    SELECT *, CAST(commits_count AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM {{{{commits}}}}) AS commits_percent,
           CAST(merge_commits_count AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM {{{{commits}}}}) AS merge_commits_percent
    FROM ({RANKED}) WHERE rank <= 20""",
)
sql("remaining_authors", f"SELECT author_name, commits_count FROM ({RANKED}) WHERE rank > 20")
sql(
    "contributors_by_recency",
    "SELECT author_name, max(author_timestamp) AS latest_timestamp FROM {{commits}} GROUP BY author_name",
)


def _ranking(period, view):
    return f"""SELECT {period}, author_name, commits_count,
    row_number() OVER (PARTITION BY {period} ORDER BY commits_count DESC, author_name) AS rank FROM {view}"""


sql("rank_year", _ranking("year", "{{yearly}}"))
sql("rank_month", _ranking("month", "{{monthly}}"))
sql("rank_month_top3", f"SELECT * FROM ({_ranking('month', '{{monthly}}')}) WHERE rank <= 3")
sql(
    "period_totals",
    """SELECT month, CAST(sum(commits_count) AS BIGINT) AS all_commits_count, count(*) AS total_authors_count
    FROM {{monthly}} GROUP BY month""",
)


def _author_of(period, view, next_count):
    return f"""
    SELECT {period}, max(author_name) FILTER (rank = 1) AS top_author,
           max(commits_count) FILTER (rank = 1) AS top_author_commits_count,
           coalesce(string_agg(author_name, ', ' ORDER BY rank) FILTER (rank BETWEEN 2 AND {next_count + 1}), '')
               AS next_top_authors,
           CAST(sum(commits_count) AS BIGINT) AS all_commits_count, count(*) AS total_authors_count
    FROM ({_ranking(period, view)}) GROUP BY {period}"""


sql("author_of_year", _author_of("year", "{{yearly}}", 5))
sql("author_of_month", _author_of("month", "{{monthly}}", 4) + " ORDER BY month DESC LIMIT 6")


def _author_series(bucket, label):
    return f"""
    SELECT {label} AS period, author_name, CAST(sum(insertions) AS BIGINT) AS insertions,
           CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS commits_count
    FROM (SELECT *, {bucket} AS p FROM {{{{commits}}}}) s GROUP BY s.p, author_name"""


sql("author_history_w", _author_series(SUNDAY, DAY_LABEL))
sql("author_history_q", _author_series("date_trunc('quarter', ts)::TIMESTAMP", QUARTER_END))


def _top_series(bucket, step, label, top, repo="0"):
    return f"""
    WITH c AS (SELECT *, {bucket} AS p, {repo} AS repo FROM {{{{commits}}}}),
    k AS (SELECT repo, author_name, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, author_name) AS r
          FROM c GROUP BY repo, author_name),
    f AS (SELECT c.repo, c.p, CASE WHEN r <= {top} THEN r ELSE 0 END AS r,
                 CASE WHEN r <= {top} THEN c.author_name ELSE 'Others' END AS name,
                 CAST(sum(insertions) AS BIGINT) AS ins, count(*) AS n
          FROM c JOIN k ON c.repo = k.repo AND c.author_name = k.author_name GROUP BY ALL),
    e AS (SELECT repo, min(p) AS p0, max(p) AS p1 FROM c GROUP BY repo),
    t AS (SELECT repo, unnest(generate_series(p0, p1, INTERVAL {step})) AS p, p0 FROM e),
    g AS (SELECT t.repo, t.p, t.p0, l.r, l.name, coalesce(ins, 0) AS ins, coalesce(n, 0) AS n
          FROM t JOIN (SELECT DISTINCT repo, r, name FROM f) l ON t.repo = l.repo
          LEFT JOIN f ON f.repo = t.repo AND f.p = t.p AND f.r = l.r)
    SELECT repo AS repo_id, nullif(r, 0) AS rank, name AS author_name, r = 0 AS is_others, {label} AS period,
           CAST(epoch(CAST({label} AS TIMESTAMP)) AS BIGINT) * 1000 AS epoch_millis,
           CAST(sum(ins) OVER w AS BIGINT) AS insertions, CAST(sum(n) OVER w AS BIGINT) AS commits_count,
           CASE WHEN s.p = p0 THEN 0 ELSE n END AS commits_delta, n AS period_commits_count
    FROM g s WINDOW w AS (PARTITION BY repo, r ORDER BY s.p ROWS UNBOUNDED PRECEDING)"""


sql("author_top_others_w", f"SELECT * EXCLUDE (repo_id) FROM ({_top_series(SUNDAY, '7 DAY', DAY_LABEL, 10)})")
sql(
    "author_top_others_by_kind",
    _top_series(
        "date_trunc('month', ts)::TIMESTAMP",
        "1 MONTH",
        "strftime(last_day(s.p::DATE), '%Y-%m-%d')",
        5,
        "CASE WHEN is_merge_commit THEN 'merges' ELSE 'plain' END",
    ),
)

# --- revision -----------------------------------------------------------------------

OWNED = "SELECT committer_name, CAST(sum(lines_count) AS BIGINT) AS lines_count FROM {{blame}} GROUP BY ALL"
sql("contribution", OWNED)
sql(
    "contribution_others",
    f"""
    WITH o AS (SELECT *, row_number() OVER (ORDER BY lines_count DESC, committer_name) AS r, count(*) OVER () AS n
               FROM ({OWNED})),
    k AS (SELECT *, r <= 10 OR n <= 11 AS kept FROM o)
    SELECT CASE WHEN kept THEN r END AS rank, CASE WHEN kept THEN committer_name ELSE 'Others' END AS committer_name,
           NOT kept AS is_others, CAST(sum(lines_count) AS BIGINT) AS lines_count
    FROM k GROUP BY ALL""",
)
PER_FILE = "SELECT filepath, count(DISTINCT committer_name) AS committers_count FROM {{blame}} GROUP BY filepath"
sql("committers_per_file", PER_FILE)
sql(
    "top_files",
    f"""SELECT *, row_number() OVER (ORDER BY committers_count DESC, filepath) AS rank FROM ({PER_FILE})
    ORDER BY rank LIMIT 10""",
)
sql(
    "monoauthor",
    """SELECT filepath, count(DISTINCT committer_name) AS committers_count FROM {{blame}}
    GROUP BY filepath HAVING count(DISTINCT committer_name) = 1""",
)
LIMIT_TS = f"CAST(epoch(make_timestamp({BLAME_AS_OF}::BIGINT * 1000000) - INTERVAL 6 MONTH) AS BIGINT)"
LOST = f"""
    SELECT CAST(coalesce(sum(lines_count) FILTER (ts < {LIMIT_TS}), 0) AS BIGINT) AS forgotten_lines_count,
           CAST(sum(lines_count) AS BIGINT) AS total_lines_count FROM {{{{blame}}}}"""
sql(
    "lost_knowledge",
    f"""SELECT *, CAST(forgotten_lines_count AS DOUBLE) / total_lines_count AS lost_knowledge_ratio FROM ({LOST})""",
)
CARRIERS = f"""
    SELECT committer_name, CAST(sum(lines_count) AS BIGINT) AS lines_count FROM {{{{blame}}}}
    WHERE ts >= {LIMIT_TS} GROUP BY committer_name"""
sql("carriers", CARRIERS)
sql("carriers_top", CARRIERS + " ORDER BY lines_count DESC, committer_name LIMIT 5")
FILE_TOTALS = """
    SELECT count(DISTINCT file) AS files_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
           CAST(sum(size_bytes) AS DOUBLE) / count(DISTINCT file) AS average_file_size FROM {view}"""
sql("files_totals", FILE_TOTALS.format(view="{{page_files}}"))


def _extensions(view):
    return VIEWS["by_extension"].format(ext=_extension("file"), files=view)


sql("extensions", _extensions("{{files}}"))
sql("extensions_of_urls", _extensions("{{page_files}}"))
sql(
    "extensions_folded",
    f"""
    SELECT files_count <= 2 AS is_others, is_binary AND files_count > 2 AS is_binary,
           CASE WHEN files_count <= 2 THEN '~others~' ELSE extension END AS extension,
           CAST(sum(e.size_bytes) AS BIGINT) AS size_bytes, CAST(sum(e.lines_count) AS BIGINT) AS lines_count,
           CAST(sum(e.files_count) AS BIGINT) AS files_count, count(*) AS extensions_count
    FROM ({_extensions("{{page_files}}")}) e GROUP BY 1, 2, 3""",
)
sql(
    "extension_shares",
    f"""
    SELECT e.*, CAST(files_count AS DOUBLE) * 100.0::DOUBLE / (SELECT count(DISTINCT file) FROM {{{{page_files}}}})
               AS files_percent,
           CAST(size_bytes AS DOUBLE) * 100.0::DOUBLE / (SELECT sum(size_bytes) FROM {{{{page_files}}}}) AS size_percent,
           CASE WHEN NOT is_binary THEN CAST(lines_count AS DOUBLE) * 100.0::DOUBLE
               / (SELECT sum(insertions) - sum(deletions) FROM {{{{linear}}}}) END AS lines_percent,
           CASE WHEN NOT is_binary THEN CAST(lines_count AS DOUBLE) / files_count END AS lines_per_file
    FROM ({_extensions("{{page_files}}")}) e""",
)
sql(
    "files_without_submodules",
    """SELECT 'p' || p_partkey AS file, p_type = 'ECONOMY' AS is_binary, CAST(0 AS BIGINT) AS size_bytes,
    CAST(0 AS BIGINT) AS lines_count FROM part WHERE p_brand <> 'Brand#17'""",
)
sql(
    "blame_hunks",
    """
    WITH people AS (
        SELECT commit_id, author_name, author_email, review_duration, author_timestamp,
               coalesce(committer_name <> '' AND committer_email <> '', FALSE) AS ok, committer_name
        FROM {{raw_commits}}),
    named AS (
        SELECT commit_id, CASE WHEN ok THEN committer_name ELSE coalesce(canonical_name, author_name) END AS name,
               CASE WHEN ok THEN author_timestamp + review_duration ELSE author_timestamp END AS timestamp
        FROM people LEFT JOIN {{mailmap}} m ON lower(m.match_email) = lower(author_email)
            AND (NOT m.by_name OR lower(m.c_name) = lower(author_name)))
    SELECT 'p' || l_partkey AS filepath, name AS committer_name, timestamp,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_count
    FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN named ON commit_id = lpad(CAST(l_orderkey AS VARCHAR), 9, '0')
    WHERE l_linenumber <= 4 AND p_type <> 'ECONOMY' AND p_brand <> 'Brand#17'
    GROUP BY ALL""",
)
PARTIAL = """
    WITH people AS (
        SELECT commit_id, author_name, author_timestamp, review_duration,
               coalesce(committer_name <> '' AND committer_email <> '', FALSE) AS ok, committer_name
        FROM {{raw_commits}} WHERE walk_pos % 5 <> 0)
    SELECT 'p' || l_partkey AS filepath,
           CASE WHEN commit_id IS NULL THEN 'Empty Empty' WHEN ok THEN committer_name ELSE author_name END AS committer_name,
           CASE WHEN ok THEN author_timestamp + review_duration ELSE author_timestamp END AS timestamp,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_count
    FROM lineitem LEFT JOIN people ON commit_id = lpad(CAST(l_orderkey AS VARCHAR), 9, '0')
    GROUP BY ALL"""
sql("blame_of_partial_log", PARTIAL)
sql(
    "unknown_lines",
    f"SELECT CAST(coalesce(sum(lines_count) FILTER (timestamp IS NULL), 0) AS BIGINT) AS unknown_lines_count FROM ({PARTIAL})",
)

# --- tags ---------------------------------------------------------------------------

sql("tag_assign", "SELECT * FROM {{assigned}}")
TAGS = """
    SELECT min(walk_pos) AS walk_start, coalesce(tag_name, 'unreleased') AS tag, tag_name, max(tagger_time) AS created,
           min(commit_time) AS initiated, max(tagger_name) AS tagger_name, count(*) AS commits_count,
           count(DISTINCT coalesce(tagger_name, '')) = 1 AND count(DISTINCT coalesce(tagger_time, -1)) = 1 AS is_consistent
    FROM {{assigned}} GROUP BY tag_name"""
sql("tag_summary", TAGS)
sql("tags_recent", TAGS + " ORDER BY walk_start LIMIT 4")
sql("tags_regex", f"SELECT * FROM ({TAGS}) WHERE regexp_matches(tag_name, '^v[0-9]*2')")
sql(
    "tag_contributors",
    """SELECT tag_name, coalesce(tag_name, 'unreleased') AS tag, commit_author, count(*) AS commits_count
    FROM {{assigned}} GROUP BY ALL""",
)
sql("commits_of_tag", "SELECT * FROM {{assigned}} WHERE tag_name = (SELECT 'v' || min(walk_pos) FROM {{tag_refs}})")
sql("commits_unreleased", "SELECT * FROM {{assigned}} WHERE tag_name IS NULL")
sql("tag_names", "SELECT DISTINCT tag_name FROM {{assigned}}")
sql("tags_count", "SELECT count(*) AS tags_count FROM (SELECT DISTINCT tag_name FROM {{assigned}})")

# --- identities, extraction, graph --------------------------------------------------

sql("identities", "SELECT commit_id, author_name, author_email FROM {{mapped}}")
sql(
    "identities_crowded",
    """
    SELECT commit_id, CASE WHEN walk_pos % 2 = 0 THEN 'Builder' ELSE author_name END AS author_name,
           CASE WHEN walk_pos % 2 = 0 THEN 'robot@team.example' ELSE author_email END AS author_email FROM {{mapped}}""",
)
sql(
    "merge_flags",
    """SELECT lpad(CAST(child AS VARCHAR), 9, '0') AS commit_id, count(*) AS parents_count, count(*) > 1 AS is_merge
    FROM {{edges}} GROUP BY child""",
)
sql("commit_line_stats", "SELECT * FROM {{commit_lines}}")
sql(
    "whole_history",
    """
    WITH m AS (SELECT child FROM {{edges}} GROUP BY child HAVING count(*) > 1)
    SELECT c.commit_id, walk_pos, m.child IS NOT NULL AS is_merge_commit, author_name, author_email,
           author_tz_offset, author_timestamp, CAST(review_duration AS BIGINT) AS review_duration,
           CASE WHEN m.child IS NULL THEN coalesce(insertions, 0) ELSE 0 END AS insertions,
           CASE WHEN m.child IS NULL THEN coalesce(deletions, 0) ELSE 0 END AS deletions
    FROM {{mapped}} c LEFT JOIN m ON m.child = walk_pos LEFT JOIN {{commit_lines}} l ON l.commit_id = c.commit_id""",
)
sql("first_parent", "SELECT lpad(CAST(x AS VARCHAR), 9, '0') AS commit_id FROM {{chain}}")
sql(
    "reachable",
    """
    WITH RECURSIVE walk(x) AS (
        SELECT count(*) // 3 FROM orders UNION SELECT parent FROM walk JOIN {{edges}} ON child = x)
    SELECT lpad(CAST(x AS VARCHAR), 9, '0') AS commit_id FROM walk""",
)
sql(
    "topological_order",
    """
    WITH RECURSIVE clock AS (SELECT o_orderkey AS x, 1000000000 - o_orderkey * 60 + o_orderkey * 7919 % 600 AS t FROM orders),
    raised(x, t) AS (
        SELECT x, t FROM clock UNION
        SELECT e.child, r.t + 1 FROM raised r JOIN {{edges}} e ON e.parent = r.x JOIN clock c ON c.x = e.child
        WHERE r.t + 1 > c.t),
    top AS (SELECT x, max(t) AS t FROM raised GROUP BY x)
    SELECT lpad(CAST(x AS VARCHAR), 9, '0') AS commit_id, row_number() OVER (ORDER BY t DESC, x) - 1 AS walk_pos FROM top""",
)
sql(
    "topological_order_equal_clocks",
    """
    -- longest paths from the last key down; parents of a key are at most ten keys later
    WITH RECURSIVE keys AS (SELECT list(o_orderpriority = '1-URGENT' ORDER BY o_orderkey) AS two, count(*) AS n FROM orders),
    top(x, t, later) AS (
        SELECT n - 1, CAST(7 AS BIGINT), [CAST(7 AS BIGINT)] FROM keys UNION ALL
        SELECT x, t, list_prepend(t, later)[1:10]
        FROM (SELECT x, later, greatest(7, coalesce(later[1 + x % 3], 6) + 1,
                     CASE WHEN two[x + 1] THEN coalesce(later[4 + x % 7], 6) + 1 ELSE 7 END) AS t
              FROM (SELECT x - 1 AS x, later FROM top WHERE x > 0), keys))
    SELECT lpad(CAST(x AS VARCHAR), 9, '0') AS commit_id, row_number() OVER (ORDER BY t DESC, x) - 1 AS walk_pos FROM top""",
)
FILE_COUNTS = """
    SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS commit_id,
           CAST(sum(n) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS files_count
    FROM (SELECT k, CAST(coalesce(sum(change), 0) AS BIGINT) AS n
          FROM ({chain}) LEFT JOIN {{{{file_changes}}}} ON commit_id = lpad(CAST(k AS VARCHAR), 9, '0') GROUP BY k)"""
sql("chain_file_counts", FILE_COUNTS.format(chain="SELECT o_orderkey AS k FROM orders"))
sql("tree_file_counts", "SELECT commit_id, count(*) AS files_count FROM {{commit_files}} GROUP BY commit_id")
sql(
    "linear_history_from_parents",
    f"""
    SELECT f.commit_id, author_timestamp + review_duration AS committer_timestamp, files_count,
           coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions
    FROM ({FILE_COUNTS.format(chain="SELECT x AS k FROM {{chain}}")}) f JOIN {{{{raw_commits}}}} c ON c.commit_id = f.commit_id
    LEFT JOIN {{{{commit_lines}}}} l ON l.commit_id = f.commit_id""",
)

# --- scalars ------------------------------------------------------------------------

sql(
    "commit_scalars",
    f"""
    SELECT commit_id, commit_id[:7] AS short_id, {_domain("author_email")} AS domain, strftime(ts, '%Y-%m-%d') AS date,
           CASE WHEN author_tz_offset < 0 THEN '-' ELSE '+' END
             || lpad(CAST(abs(author_tz_offset) // 60 AS VARCHAR), 2, '0')
             || lpad(CAST(abs(author_tz_offset) % 60 AS VARCHAR), 2, '0') AS timezone,
           isodow(l) - 1 AS weekday, strftime(l, '%A') AS weekday_name, hour(l) AS hour,
           strftime(ts, '%Y-%m') AS month, strftime(ts, '%b') AS month_name,
           {BIN},
           author_timestamp * 1000 AS epoch_millis,
           CASE WHEN walk_pos % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(walk_pos AS DOUBLE) / (walk_pos % 3) END AS ratio
    FROM (SELECT *, ts + to_minutes(author_tz_offset) AS l FROM {{{{commits}}}})""",
)
sql(
    "url_scalars",
    f"""
    SELECT page_id, {_extension("url")} AS extension, {_domain("replace(url, '://', '@')")} AS domain FROM pages""",
)

# --- report tables ------------------------------------------------------------------

sql(
    "general",
    f"""
    SELECT *, CAST(active_days_count AS DOUBLE) * 100.0::DOUBLE / age_days AS active_days_percent,
           CAST(merge_commits_count AS DOUBLE) * 100.0::DOUBLE / commits_count AS merge_commits_percent,
           CAST(commits_count AS DOUBLE) / age_days AS commits_per_day,
           CAST(commits_count AS DOUBLE) / active_days_count AS commits_per_active_day,
           CAST(commits_count AS DOUBLE) / authors_count AS commits_per_author
    FROM ({TOTALS}) CROSS JOIN ({ORACLE["authors_count"]}) CROSS JOIN ({LINES})
    CROSS JOIN (SELECT count(DISTINCT file) AS files_count FROM {{{{page_files}}}})""",
)
sql(
    "files_page",
    f"""
    SELECT *, CAST(monoauthor_files_count AS DOUBLE) * 100.0::DOUBLE / files_count AS monoauthor_files_percent
    FROM ({FILE_TOTALS.format(view="{{page_files}}")})
    CROSS JOIN (SELECT count(*) AS monoauthor_files_count FROM ({ORACLE["monoauthor"]}))
    CROSS JOIN (SELECT lost_knowledge_ratio FROM ({ORACLE["lost_knowledge"]}))""",
)
sql(
    "file_series",
    f"""
    SELECT *, CAST(floor(max(files_count) OVER ()) AS BIGINT) AS max_files, max(lines_count) OVER () AS max_lines,
           CAST(epoch(CAST(period AS TIMESTAMP)) AS BIGINT) * 1000 AS epoch_millis FROM ({MONTH_SERIES})""",
)

HEAT = "CAST(floor(CAST(commits_count AS DOUBLE) / max(commits_count) OVER () * 9) AS BIGINT) AS heat"
sql(
    "report_months_of_year",
    f"""
    SELECT *, {HEAT}
    FROM (SELECT m AS month, strftime(make_date(2024, m, 1), '%b') AS month_name, count(ts) AS commits_count
          FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m) LEFT JOIN {{{{commits}}}} ON month(ts) = m GROUP BY m)""",
)
sql("report_timezones", f"SELECT *, {HEAT} FROM ({TEXTS['timezones']})")
sql("report_weekday_hours", TEXTS["heat_levels"])
sql("report_author_series", TEXTS["author_top_others_w"])
sql("report_extensions", TEXTS["extension_shares"].replace(_extensions("{{page_files}}"), TEXTS["extensions_folded"]))
sql("report_tags", TEXTS["tags_recent"])
sql(
    "commit_cells",
    f"""
    SELECT CAST(author_tz_offset AS BIGINT) AS author_tz_offset, isodow(l) - 1 AS weekday, hour(l) AS hour, bin, domain,
           count(*) AS commits_count
    FROM (SELECT *, {BIN}, {_domain("author_email")} AS domain, ts + to_minutes(author_tz_offset) AS l FROM {{{{commits}}}})
    GROUP BY ALL""",
)
#: tables of a written report, and the query whose rows they have
REPORT = {
    "author_days": "author_days", "general": "general", "months_of_current_year": "current_year_months", "years": "history_y",
    "years_and_months": "year_month", "review_durations": "review_bins", "weekday_hours": "heat_levels",
    "weekday_hour_margins": "weekday_hour_margins", "timezones": "timezones", "months_of_year": "report_months_of_year",
    "top_authors": "top_authors", "remaining_authors": "remaining_authors", "authors_of_months": "author_of_month",
    "authors_of_years": "author_of_year", "author_series": "author_top_others_w", "domains": "domains_others",
    "files_overview": "files_page", "file_series": "linear_history_w", "extensions": "report_extensions",
    "contribution": "contribution_others", "knowledge_carriers": "carriers_top", "top_files": "top_files",
    "tags": "tags_recent", "tag_contributors": "tag_contributors", "tags_count": "tags_count",
    "commit_cells": "commit_cells",
}
sql(
    "report_written",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS rows_count FROM ({text})"
        for table, text in {**{t: TEXTS[q] for t, q in REPORT.items()}, "recent_weeks": "SELECT * FROM range(32)"}.items()
    ),
)

TEXTS["authors_by_lines"], ORACLE["authors_by_lines"] = TEXTS["authors_sorted"], ORACLE["authors_sorted"]

# --- parsed exports -----------------------------------------------------------------

_TREE_PATH = "CASE WHEN p_partkey % 5 = 0 THEN 'd\"' || chr(9) || p_partkey ELSE 'd/p' || p_partkey END"
sql(
    "parsed_commits",
    """
    SELECT commit_id, walk_pos, author_name, author_email, author_timestamp, author_tz_offset, committer_name,
           coalesce(committer_email, '') AS committer_email, author_timestamp + review_duration AS committer_timestamp
    FROM {{raw_commits}}""",
)
sql(
    "parsed_parents",
    """SELECT lpad(CAST(child AS VARCHAR), 9, '0') AS commit_id, lpad(CAST(parent AS VARCHAR), 9, '0') AS parent_id, ordinal
    FROM {{edges}}""",
)
sql(
    "parsed_commit_files",
    """
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS commit_id,
           CASE WHEN l_partkey % 5 = 0 THEN 'src/"' || chr(1) || '\\' || l_partkey ELSE 'src/p' || l_partkey END AS path,
           CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) END AS insertions,
           CASE WHEN l_partkey % 9 <> 0 THEN l_linenumber END AS deletions
    FROM lineitem""",
)
sql(
    "parsed_files",
    f"""
    SELECT 'HEAD' AS revision, {_TREE_PATH} AS file, p_partkey % 9 = 0 AS is_binary,
           CASE WHEN p_partkey % 4 = 1 THEN 0 ELSE p_partkey * 3 END AS size_bytes,
           CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey % 50 END AS lines_count
    FROM part WHERE p_brand <> 'Brand#17'""",
)
sql("parsed_submodules", f"SELECT 'HEAD' AS revision, {_TREE_PATH} AS path FROM part WHERE p_brand = 'Brand#17'")
sql(
    "parsed_tags",
    """
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS commit_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'late' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'v' || o_orderkey
                ELSE 'r/' || o_orderkey END AS tag_name,
           CASE WHEN o_orderkey % 3 = 1 THEN 'Release Master' END AS tagger_name,
           CASE WHEN o_orderkey % 3 = 1 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS tagger_time
    FROM orders WHERE o_totalprice > 250000""",
)
sql(
    "parsed_identities",
    """
    SELECT commit_id, CASE WHEN c_custkey % 6 = 0 THEN 'Both ' || c_custkey WHEN c_custkey % 6 = 1 THEN 'Mail ' || c_custkey
                           WHEN c_custkey % 6 = 2 THEN 'Name ' || c_custkey ELSE author_name END AS author_name, author_email
    FROM {{raw_commits}} JOIN customer ON c_name = author_name""",
)

# --- keyed forms --------------------------------------------------------------------

for _name, (_view, _key) in KEYED.items():
    keyed_sql(_name, _view, _key)
for _name in ("tag_assign", "tag_summary"):
    keyed_sql(_name, "raw_commits", "walk_pos")
