from datetime import datetime, timedelta, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F

from annalist.functions import scalars as S


def values(spark, inputs, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression("v")).collect()]


def test_file_extension(spark):
    cases = {
        "folder/filename.extension": "extension",
        "folder/.extension": ".extension",
        "folder/filename.suffix.extension": "extension",
        "folder/FILENAME": "FILENAME",
        "folder/.filename.suffix.extension": "extension",
        "f.": "",
        "dir/": "",
        "a.b/c": "c",
        "..": "",
        ".": ".",
    }
    assert values(spark, cases, "string", S.file_extension) == list(cases.values())


def test_email_domain(spark):
    cases = {"a@b.c": "b.c", "a@": "", "@b": "b", "plain": "unknown", "a@b@c": "unknown", "": "unknown", None: "unknown"}
    assert values(spark, cases, "string", S.email_domain) == list(cases.values())


def test_duration_bins_are_closed_on_the_right(spark):
    cases = {
        -1: None,
        0: "= 0s",
        1: "= 0s",
        2: "< 1hour",
        3600: "< 1hour",
        3601: "< 1day",
        86400: "< 1day",
        86401: "< 2days",
        172801: "< 1week",
        604801: "< 2weeks",
        1209601: "< 1month",
        2592000: "< 1month",
        2592001: "< 6 months",
        15811201: "< 3 years",
        94608000: "< 3 years",
        94608001: None,
    }
    assert values(spark, cases, "long", S.duration_bin) == list(cases.values())


def test_offset_label(spark):
    cases = {0: "+0000", 60: "+0100", -120: "-0200", 90: "+0130", -90: "-0130", 765: "+1245"}
    assert values(spark, cases, "int", S.offset_label) == list(cases.values())


@pytest.mark.parametrize("seconds", [0, -1, 86399, 86400, 1709210096, -86401])
def test_calendar_parts_are_utc(spark, seconds):
    when = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
    df = spark.range(1).select(F.lit(seconds).cast("long").alias("t"))
    parts = df.select(
        S.utc_date("t").cast("string"), S.utc_weekday("t"), S.utc_hour("t"), S.month_label(S.utc_date("t"))
    )
    assert rows(parts) == [(when.strftime("%Y-%m-%d"), when.weekday(), when.hour, when.strftime("%Y-%m"))]


def test_months_before_clamps_and_keeps_the_time_of_day(spark):
    for now, months, expected in [
        (datetime(2024, 8, 31, 12), 6, datetime(2024, 2, 29, 12)),
        (datetime(2024, 3, 1, 23, 59, 59), 1, datetime(2024, 2, 1, 23, 59, 59)),
        (datetime(2023, 1, 15), 13, datetime(2021, 12, 15)),
    ]:
        assert rows(spark.range(1).select(S.months_before(now, months))) == [(S.epoch_seconds(expected),)]


def test_guards_contributed_days_and_heat(spark):
    df = spark.range(1).select(
        S.guarded_ratio(F.lit(3), F.lit(0)),
        S.guarded_percent(F.lit(1), F.lit(4)),
        S.contributed_days(F.lit(100), F.lit(200)),
        S.contributed_days(F.lit(0), F.lit(2 * 86400 + 5)),
        S.heat_level(F.lit(5), F.lit(10), 11),
        S.heat_level(F.lit(10), F.lit(10), 11),
        S.weekday_name(F.lit(6)),
        S.month_name(F.lit(12)),
        S.tag_display_name(F.lit(None).cast("string")),
        S.short_id(F.lit("0123456789")),
    )
    assert rows(df) == [(0.0, 25.0, 1, 2, 5, 10, "Sunday", "Dec", "unreleased", "0123456")]
