"""One query per operator, on history tables derived from the driver's tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import activity, authors, commits as extract, facts, graph, identity, revision, tags
from annalist.operators.grouping import positions
from annalist.operators.lineage import Scratch
from annalist.plans import report
from annalist.sources import exports
from contract import views as V

QUERIES = {}


def plain(df):
    """Compare-friendly types: dates as text, timestamps as epoch seconds, integers as long."""
    shown = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if kind == "date":
            value = F.date_format(value, "yyyy-MM-dd")
        elif kind == "timestamp":
            value = F.unix_seconds(value)
        elif kind in ("int", "smallint", "tinyint"):
            value = value.cast("long")
        shown.append(value.alias(name))
    return df.select(*shown)


def query(build):
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(spark, sf_dir))
    return build


# --- totals and distributions -------------------------------------------------------


@query
def commit_totals(spark, sf):
    return activity.commit_totals(V.commits(spark, sf))


@query
def commits_count(spark, sf):
    return extract.commits_count(V.commits(spark, sf))


@query
def line_totals(spark, sf):
    return activity.line_totals(V.linear(spark, sf))


@query
def active_days(spark, sf):
    return activity.active_days(V.commits(spark, sf))


@query
def review_bins(spark, sf):
    return activity.review_durations(V.commits(spark, sf))


@query
def timezones(spark, sf):
    return activity.timezones(V.commits(spark, sf))


@query
def domains(spark, sf):
    return activity.domains(V.commits(spark, sf))


@query
def domains_others(spark, sf):
    return activity.domains_with_others(V.commits(spark, sf), max_domains=3)


@query
def recent_weeks(spark, sf):
    return activity.recent_weeks(V.event_commits(spark, sf), V.EVENTS_AS_OF, 4)


@query
def recent_weeks_on_sunday(spark, sf):
    return activity.recent_weeks(V.event_commits(spark, sf), V.EVENTS_AS_OF_SUNDAY, 32)


@query
def month_of_year(spark, sf):
    return activity.months_of_year(V.commits(spark, sf))


@query
def weekday_hour(spark, sf):
    return activity.weekday_hours(V.event_commits(spark, sf))


@query
def weekday_hour_matrix(spark, sf):
    return activity.weekday_hour_matrix(V.commits(spark, sf))


@query
def weekday_hour_margins(spark, sf):
    return activity.weekday_hour_margins(V.commits(spark, sf))


@query
def heat_levels(spark, sf):
    return activity.heat_levels(activity.weekday_hours(V.commits(spark, sf)), 10)


# --- series -------------------------------------------------------------------------


def _history(name, sampling, view):
    def build(spark, sf):
        return activity.commit_history(view(spark, sf), sampling)

    build.__name__ = name
    query(build)


for _name, _alias in (
    ("history_d", "D"),
    ("history_w", "W"),
    ("history_w_wed", "W-WED"),
    ("history_2w", "2W"),
    ("history_m", "M"),
    ("history_ms", "MS"),
    ("history_q", "Q"),
    ("history_qs", "QS"),
    ("history_y", "Y"),
    ("history_2y", "2YS"),
    ("history_b", "B"),
    ("history_bm", "BM"),
    ("history_sm", "SM"),
):
    _history(_name, _alias, V.commits)
for _name, _alias in (("history_h", "H"), ("history_5h", "5H"), ("history_90min", "90min"), ("history_1d12h", "1D12H")):
    _history(_name, _alias, V.event_commits)


@query
def year_month(spark, sf):
    return activity.years_and_months(V.commits(spark, sf))


@query
def current_year_months(spark, sf):
    return activity.months_of_current_year(V.commits(spark, sf), V.BLAME_AS_OF)


@query
def linear_history_w(spark, sf):
    return activity.line_history(V.linear(spark, sf), "W")


@query
def linear_history_m(spark, sf):
    return activity.line_history(V.linear(spark, sf), "M")


@query
def linear_history_6h(spark, sf):
    events = V.event_commits(spark, sf).select(
        F.col("author_timestamp").alias("committer_timestamp"),
        (100 + F.col("walk_pos") % 50).alias("files_count"),
        "insertions",
        "deletions",
    )
    return activity.line_history(events, "6H")


# --- authors ------------------------------------------------------------------------


@query
def author_summary(spark, sf):
    return authors.author_summary(V.commits(spark, sf, lines=True))


@query
def author_days(spark, sf):
    return facts.author_days(V.commits(spark, sf, lines=True))


@query
def commit_cells(spark, sf):
    return facts.cells_of(facts.rollups(V.commits(spark, sf, lines=True)))


@query
def author_summary_of_rollup(spark, sf):
    return authors.author_summary(facts.author_days(V.commits(spark, sf, lines=True)))


@query
def authors_sorted(spark, sf):
    summary = authors.author_summary(V.commits(spark, sf, lines=True)).select("author_name", "insertions")
    return positions(summary, [], [F.desc("insertions"), F.asc("author_name")])


@query
def authors_by_lines(spark, sf):
    """``sort_authors`` with the position that its order gives."""
    summary = authors.author_summary(V.commits(spark, sf, lines=True)).select("author_name", "insertions")
    numbered = authors.sort_authors(summary, "insertions").withColumn("_at", F.monotonically_increasing_id())
    return positions(numbered, [], [F.asc("_at")]).drop("_at")


@query
def author_get(spark, sf):
    return authors.author(authors.author_summary(V.commits(spark, sf, lines=True)), "Customer#000000010")


@query
def author_names(spark, sf):
    return authors.author_names(V.commits(spark, sf))


@query
def authors_count(spark, sf):
    return authors.authors_count(V.commits(spark, sf))


@query
def top_authors(spark, sf):
    return authors.top_authors(V.commits(spark, sf, lines=True), 20)


@query
def remaining_authors(spark, sf):
    return authors.remaining_authors(V.commits(spark, sf), 20)


@query
def contributors_by_recency(spark, sf):
    return authors.authors_by_recency(V.commits(spark, sf))


@query
def rank_year(spark, sf):
    return authors.author_ranking(V.commits(spark, sf), "year")


@query
def rank_month(spark, sf):
    return authors.author_ranking(V.commits(spark, sf), "month")


@query
def rank_month_top3(spark, sf):
    return authors.author_ranking(V.commits(spark, sf), "month", limit=3)


@query
def period_totals(spark, sf):
    return authors.period_totals(V.commits(spark, sf), "month")


@query
def author_of_year(spark, sf):
    return authors.authors_of_periods(V.commits(spark, sf), "year", next_count=5)


@query
def author_of_month(spark, sf):
    return authors.authors_of_periods(V.commits(spark, sf), "month", max_periods=6, next_count=4)


@query
def author_history_w(spark, sf):
    return authors.author_history(V.commits(spark, sf, lines=True), "W")


@query
def author_history_q(spark, sf):
    return authors.author_history(V.commits(spark, sf, lines=True), "Q")


@query
def author_top_others_w(spark, sf):
    return authors.top_author_history(V.commits(spark, sf, lines=True), "W", 10)


@query
def author_top_others_by_kind(spark, sf):
    """Many histories in one job: merges and others as two repositories."""
    history = V.commits(spark, sf, lines=True).withColumn(
        "repo_id", F.when(F.col("is_merge_commit"), F.lit("merges")).otherwise(F.lit("plain"))
    )
    return authors.top_author_history(history, "M", 5, by=["repo_id"])


# --- revision -----------------------------------------------------------------------


@query
def contribution(spark, sf):
    return revision.contribution(V.blame(spark, sf))


@query
def contribution_others(spark, sf):
    return revision.contribution_with_others(V.blame(spark, sf), 10)


@query
def committers_per_file(spark, sf):
    return revision.committers_per_file(V.blame(spark, sf))


@query
def top_files(spark, sf):
    return revision.top_files(V.blame(spark, sf), 10)


@query
def monoauthor(spark, sf):
    return revision.monoauthor_files(V.blame(spark, sf))


@query
def lost_knowledge(spark, sf):
    return revision.lost_knowledge(V.blame(spark, sf), V.BLAME_AS_OF)


@query
def carriers(spark, sf):
    return revision.knowledge_carriers(V.blame(spark, sf), V.BLAME_AS_OF)


@query
def carriers_top(spark, sf):
    return revision.knowledge_carriers(V.blame(spark, sf), V.BLAME_AS_OF, top=5)


@query
def files_totals(spark, sf):
    return revision.file_totals(V.page_files(spark, sf))


@query
def extensions(spark, sf):
    return revision.extensions(V.files(spark, sf))


@query
def extensions_of_urls(spark, sf):
    return revision.extensions(V.page_files(spark, sf))


@query
def extensions_folded(spark, sf):
    return revision.extensions_folded(V.page_files(spark, sf), 2)


@query
def extension_shares(spark, sf):
    files = V.page_files(spark, sf)
    lines = activity.line_totals(V.linear(spark, sf))
    return revision.extension_shares(revision.extensions(files), files, lines)


@query
def files_without_submodules(spark, sf):
    return extract.without_submodules(V.part_files(spark, sf), V.submodules(spark, sf))


@query
def blame_hunks(spark, sf):
    return extract.blame(
        V.blame_lines(spark, sf),
        V.raw_commits(spark, sf),
        files=V.part_files(spark, sf),
        submodules=V.submodules(spark, sf),
        mailmap=V.mailmap(spark, sf),
        revision="HEAD",
    )


def _partial_blame(spark, sf):
    known = V.raw_commits(spark, sf).filter("walk_pos % 5 <> 0")
    return extract.blame(V.blame_lines(spark, sf), known)


@query
def blame_of_partial_log(spark, sf):
    """Lines whose commit the log lacks stay."""
    return _partial_blame(spark, sf)


@query
def unknown_lines(spark, sf):
    return revision.unknown_lines(_partial_blame(spark, sf))


# --- tags ---------------------------------------------------------------------------


def _assigned(spark, sf):
    return tags.assign_tags(V.commits(spark, sf), V.tag_refs(spark, sf), chunk=1000)


@query
def tag_assign(spark, sf):
    return _assigned(spark, sf)


@query
def tag_summary(spark, sf):
    return tags.tag_summary(_assigned(spark, sf))


@query
def tag_contributors(spark, sf):
    return tags.tag_contributors(_assigned(spark, sf))


@query
def tags_recent(spark, sf):
    return tags.recent_tags(tags.tag_summary(_assigned(spark, sf)), 4)


@query
def tags_regex(spark, sf):
    return tags.tag_summary(tags.tags_matching(_assigned(spark, sf), "^v[0-9]*2"))


@query
def commits_of_tag(spark, sf):
    first = V.tag_refs(spark, sf).selectExpr("concat('v', min(ref_order)) as _first")
    return _assigned(spark, sf).join(first, F.col("tag_name") == F.col("_first"), "left_semi")


@query
def commits_unreleased(spark, sf):
    return tags.commits_of_tag(_assigned(spark, sf), None)


@query
def tag_names(spark, sf):
    return tags.tag_names(_assigned(spark, sf))


@query
def tags_count(spark, sf):
    return tags.tags_count(_assigned(spark, sf))


# --- identities, extraction, graph --------------------------------------------------


@query
def identities(spark, sf):
    mapped = identity.resolve_identities(V.raw_commits(spark, sf), V.mailmap(spark, sf))
    return mapped.select("commit_id", "author_name", "author_email")


@query
def identities_crowded(spark, sf):
    """One e-mail holds half of the rows."""
    mapped = identity.resolve_identities(V.crowded_commits(spark, sf), V.crowded_mailmap(spark, sf))
    return mapped.select("commit_id", "author_name", "author_email")


@query
def merge_flags(spark, sf):
    return graph.merge_flags(V.parents(spark, sf))


@query
def commit_line_stats(spark, sf):
    return extract.commit_line_stats(V.commit_files(spark, sf))


@query
def whole_history(spark, sf):
    return extract.whole_history(
        V.raw_commits(spark, sf),
        V.parents(spark, sf),
        V.commit_files(spark, sf),
        V.mailmap(spark, sf),
    )


@query
def first_parent(spark, sf):
    return graph.first_parent_chain(V.parents(spark, sf), V.head(spark, sf))


@query
def reachable(spark, sf):
    return graph.reachable(V.parents(spark, sf), V.head(spark, sf, share=3))


@query
def topological_order(spark, sf):
    history = V.raw_commits(spark, sf)
    clocked = history.select(
        "commit_id", (1_000_000_000 - F.col("walk_pos") * 60 + F.col("walk_pos") * 7919 % 600).alias("time")
    )
    return graph.topological_order(clocked, V.parents(spark, sf), time="time")


@query
def topological_order_equal_clocks(spark, sf):
    history = V.raw_commits(spark, sf).select("commit_id", F.lit(7).cast("long").alias("time"))
    return graph.topological_order(history, V.parents(spark, sf), time="time")


@query
def chain_file_counts(spark, sf):
    chain = V.raw_commits(spark, sf).select("commit_id", "walk_pos")
    return extract.chain_file_counts(chain, V.file_changes(spark, sf), chunk=1000)


@query
def tree_file_counts(spark, sf):
    return extract.tree_file_counts(V.commit_files(spark, sf))


@query
def linear_history_from_parents(spark, sf):
    return extract.linear_history(
        V.raw_commits(spark, sf),
        V.parents(spark, sf),
        V.commit_files(spark, sf),
        V.head(spark, sf),
        file_changes=V.file_changes(spark, sf),
    )


# --- exports, from lines that the views write -----------------------------------------


@query
def parsed_commits(spark, sf):
    return exports.parse_commit_log(V.log_lines(spark, sf)).commits.drop("repo_id")


@query
def parsed_parents(spark, sf):
    return exports.parse_commit_log(V.log_lines(spark, sf)).parents.drop("repo_id")


@query
def parsed_commit_files(spark, sf):
    return exports.parse_commit_log(V.log_lines(spark, sf)).commit_files.drop("repo_id")


@query
def parsed_files(spark, sf):
    return exports.parse_tree(V.tree_lines(spark, sf)).files.drop("repo_id")


@query
def parsed_submodules(spark, sf):
    return exports.parse_tree(V.tree_lines(spark, sf)).submodules.drop("repo_id")


@query
def parsed_tags(spark, sf):
    """The last reference of a commit wins."""
    refs = exports.parse_tag_refs(V.ref_lines(spark, sf))
    return tags.tag_targets(refs).select("commit_id", "_tag.*")


@query
def parsed_identities(spark, sf):
    """Rules by name and e-mail win over rules by e-mail, later lines over earlier ones."""
    rules = exports.parse_mailmap(V.mailmap_lines(spark, sf))
    mapped = identity.resolve_identities(V.raw_commits(spark, sf), rules)
    return mapped.select("commit_id", "author_name", "author_email")


# --- scalars ------------------------------------------------------------------------


@query
def commit_scalars(spark, sf):
    local = S.local_seconds("author_timestamp", "author_tz_offset")
    month = F.month(S.utc_date("author_timestamp"))
    return V.commits(spark, sf).select(
        "commit_id",
        S.short_id("commit_id").alias("short_id"),
        S.email_domain("author_email").alias("domain"),
        S.utc_date("author_timestamp").alias("date"),
        S.offset_label("author_tz_offset").alias("timezone"),
        S.utc_weekday(local).alias("weekday"),
        S.weekday_name(S.utc_weekday(local)).alias("weekday_name"),
        S.utc_hour(local).alias("hour"),
        S.month_label(S.utc_date("author_timestamp")).alias("month"),
        S.month_name(month).alias("month_name"),
        S.duration_bin("review_duration").alias("bin"),
        F.unix_millis(S.utc_timestamp("author_timestamp")).alias("epoch_millis"),
        S.guarded_ratio(F.col("walk_pos"), F.col("walk_pos") % 3).alias("ratio"),
    )


@query
def url_scalars(spark, sf):
    pages = V.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        S.file_extension("url").alias("extension"),
        S.email_domain(F.replace("url", F.lit("://"), F.lit("@"))).alias("domain"),
    )


# --- report tables ------------------------------------------------------------------


def _history_of(spark, sf):
    return report.History(
        commits=V.commits(spark, sf, lines=True),
        linear_history=V.linear(spark, sf),
        files=V.page_files(spark, sf),
        blame=V.blame(spark, sf),
        assigned_tags=_assigned(spark, sf),
    )


@query
def general(spark, sf):
    return report.general(_history_of(spark, sf))


@query
def files_page(spark, sf):
    return report.files_overview(_history_of(spark, sf), report.Options(), V.BLAME_AS_OF)


@query
def file_series(spark, sf):
    return report.file_series(_history_of(spark, sf), report.Options(time_sampling="M"))


#: settings of the report queries, as a user writes them; keys that no setting has are left out
SETTINGS = """{"max_domains": 3, "max_recent_tags": 4, "orphaned_extension_count": 2, "colormap": "classic"}"""


def _report_table(name):
    def run(spark, sf):
        options = report.Options.from_json(SETTINGS)
        return report.report_tables(_history_of(spark, sf), V.BLAME_AS_OF, options, names=[name])[name]

    run.__name__ = f"report_{name}"
    query(run)


for _name in ("months_of_year", "timezones", "weekday_hours", "author_series", "extensions", "tags"):
    _report_table(_name)


@query
def report_written(spark, sf):
    """Writes the whole report to the shared folder and counts the rows of every table there."""
    folder = f"{Scratch(spark).folder}/report"
    options = report.Options.from_json(SETTINGS)
    names = report.write_report(_history_of(spark, sf), folder, V.BLAME_AS_OF, options)
    tables = [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("table_name")) for n in names]
    return reduce(DataFrame.unionAll, [t.groupBy("table_name").count() for t in tables]).withColumnRenamed("count", "rows_count")


# --- keyed forms: many repositories in one job, one of them with most rows --------------

BY = ["repo_id"]


def _keyed(name, build):
    def run(spark, sf):
        source = getattr(V, V.KEYED[name][0])
        view = source(spark, sf, lines=True) if name in ("author_summary", "top_authors") else source(spark, sf)
        return build(V.keyed(view, name))

    run.__name__ = f"{name}_keyed"
    query(run)


for _name, _build in {
    "commit_totals": lambda c: activity.commit_totals(c, BY),
    "review_bins": lambda c: activity.review_durations(c, BY),
    "timezones": lambda c: activity.timezones(c, BY),
    "domains_others": lambda c: activity.domains_with_others(c, 3, BY),
    "recent_weeks": lambda c: activity.recent_weeks(c, V.EVENTS_AS_OF, 4, BY),
    "current_year_months": lambda c: activity.months_of_current_year(c, V.BLAME_AS_OF, BY),
    "weekday_hour": lambda c: activity.weekday_hours(c, BY),
    "weekday_hour_margins": lambda c: activity.weekday_hour_margins(c, BY),
    "commit_cells": lambda c: facts.cells_of(facts.rollups(c, BY), BY),
    "history_2w": lambda c: activity.commit_history(c, "2W", BY),
    "linear_history_w": lambda c: activity.line_history(c, "W", BY),
    "author_summary": lambda c: authors.author_summary(c, BY),
    "top_authors": lambda c: authors.top_authors(c, 20, BY),
    "rank_month": lambda c: authors.author_ranking(c, "month", BY),
    "rank_month_top3": lambda c: authors.author_ranking(c, "month", BY, limit=3),
    "author_of_year": lambda c: authors.authors_of_periods(c, "year", next_count=5, by=BY),
    "contribution_others": lambda b: revision.contribution_with_others(b, 10, BY),
    "top_files": lambda b: revision.top_files(b, 10, BY),
    "lost_knowledge": lambda b: revision.lost_knowledge(b, V.BLAME_AS_OF, by=BY),
}.items():
    _keyed(_name, _build)


def _assigned_keyed(spark, sf):
    commits = V.commits(spark, sf).selectExpr("*", f"{V.repository('walk_pos')} as repo_id")
    refs = V.tag_refs(spark, sf).selectExpr("*", f"{V.repository('ref_order')} as repo_id")
    return tags.assign_tags(commits, refs, BY, chunk=1000)


@query
def tag_assign_keyed(spark, sf):
    return _assigned_keyed(spark, sf)


@query
def tag_summary_keyed(spark, sf):
    return tags.tag_summary(_assigned_keyed(spark, sf), BY)
