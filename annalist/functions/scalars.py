"""Column expressions over history records. All JVM-side, none needs a Python UDF.

Calendar parts come from epoch seconds by integer arithmetic on days, which keeps
them in UTC whatever the session time zone is.
"""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400

# Review-duration bins as (upper edge in seconds, label); the first
# bin is closed on both sides at 0 and 1, all others are open left, closed right.
DURATION_BINS = (
    (1, "= 0s"),
    (3600, "< 1hour"),
    (86400, "< 1day"),
    (172800, "< 2days"),
    (604800, "< 1week"),
    (1209600, "< 2weeks"),
    (2592000, "< 1month"),
    (15811200, "< 6 months"),
    (94608000, "< 3 years"),
)

# English calendar names, Monday first.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# What an unreadable identity is called.
EMPTY_NAME = "Empty Empty"
EMPTY_EMAIL = "empty@empty.empty"

UNKNOWN_DOMAIN = "unknown"
UNRELEASED = "unreleased"


def column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def integer_div(dividend, divisor: int) -> Column:
    """Floor division on integers, right for negative dividends too."""
    dividend = column(dividend).cast("long")
    return F.call_function("div", dividend - F.pmod(dividend, F.lit(divisor)), F.lit(divisor).cast("long"))


def epoch_seconds(as_of) -> int:
    """Reference time of a statistic as epoch seconds; naive datetimes are UTC."""
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=timezone.utc)
        return int(as_of.timestamp())
    return int(as_of)


def utc_timestamp(seconds) -> Column:
    return F.timestamp_seconds(column(seconds))


def epoch_day(seconds) -> Column:
    return integer_div(seconds, DAY_SECONDS)


def day_to_date(day) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), column(day).cast("int"))


def date_to_day(date) -> Column:
    return F.unix_date(column(date)).cast("long")


def utc_date(seconds) -> Column:
    return day_to_date(epoch_day(seconds))


def local_seconds(seconds, offset_minutes) -> Column:
    """Epoch seconds shifted so that UTC calendar parts read as the author's clock."""
    return column(seconds) + column(offset_minutes).cast("long") * 60


def utc_hour(seconds) -> Column:
    return F.call_function("div", F.pmod(column(seconds).cast("long"), F.lit(DAY_SECONDS)), F.lit(3600)).cast("int")


def utc_weekday(seconds) -> Column:
    """Monday = 0."""
    return F.weekday(utc_date(seconds))


def month_label(date) -> Column:
    return F.date_format(column(date), "yyyy-MM")


def months_before(as_of, months: int) -> Column:
    """Epoch seconds ``months`` calendar months before ``as_of``, time of day kept,
    day of month clamped to the length of the earlier month."""
    seconds = epoch_seconds(as_of)
    day, time_of_day = divmod(seconds, DAY_SECONDS)
    earlier = F.add_months(day_to_date(F.lit(day)), -months)
    return date_to_day(earlier) * DAY_SECONDS + F.lit(time_of_day)


def offset_label(offset_minutes) -> Column:
    """Minutes east of UTC as ``+HHMM`` / ``-HHMM``."""
    offset = column(offset_minutes)
    size = F.abs(offset)
    sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
    hours = F.lpad(F.call_function("div", size, F.lit(60)).cast("string"), 2, "0")
    minutes = F.lpad((size % 60).cast("string"), 2, "0")
    return F.concat(sign, hours, minutes)


def email_domain(email) -> Column:
    """Part after the only ``@``; anything else (also NULL) is ``unknown``."""
    parts = F.split(column(email), "@", -1)
    return F.when(F.size(parts) == 2, parts.getItem(1)).otherwise(F.lit(UNKNOWN_DOMAIN))


def file_extension(path) -> Column:
    """Text after the last dot of the base name; names without a dot, and names
    whose only dot leads, stand for themselves."""
    base = F.substring_index(column(path), "/", -1)
    only_leading_dot = base.startswith(".") & (F.length(base) - F.length(F.replace(base, F.lit("."))) == 1)
    return F.when(~base.contains(".") | only_leading_dot, base).otherwise(F.substring_index(base, ".", -1))


def duration_bin(seconds) -> Column:
    """Label of the review-duration bin; NULL when negative or beyond the last edge."""
    value = column(seconds)
    (edge, label), *rest = DURATION_BINS
    binned = F.when(value < 0, F.lit(None).cast("string")).when(value <= edge, label)
    for edge, label in rest:
        binned = binned.when(value <= edge, label)
    return binned


def review_duration(author_timestamp, committer_timestamp) -> Column:
    return column(committer_timestamp) - column(author_timestamp)


def whole_days(first_seconds, last_seconds) -> Column:
    return integer_div(column(last_seconds) - column(first_seconds), DAY_SECONDS)


def contributed_days(first_seconds, last_seconds) -> Column:
    """Whole days from first to latest commit, at least one."""
    return F.greatest(whole_days(first_seconds, last_seconds), F.lit(1).cast("long"))


def guarded_ratio(value, maximum) -> Column:
    """``value / maximum``, 0 when the maximum is 0 or missing."""
    return F.coalesce(F.try_divide(column(value).cast("double"), column(maximum).cast("double")), F.lit(0.0))


def guarded_percent(value, maximum) -> Column:
    return F.coalesce(
        F.try_divide(column(value).cast("double") * 100.0, column(maximum).cast("double")), F.lit(0.0)
    )


def weekday_name(weekday) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), column(weekday).cast("int") + 1)


def month_name(month) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), column(month).cast("int"))


def short_id(commit_id) -> Column:
    """Display form only; never a key."""
    return F.substring(column(commit_id), 1, 7)


def tag_display_name(tag_name) -> Column:
    return F.coalesce(column(tag_name), F.lit(UNRELEASED))


def heat_level(value, maximum, levels: int) -> Column:
    """Position of a value on a scale of ``levels`` steps, 0 to ``levels - 1``."""
    return F.floor(guarded_ratio(value, maximum) * (levels - 1)).cast("int")
