"""Calendar periods named by sampling aliases (``W``, ``2W-WED``, ``M``, ``QS``, ``6H`` ...).

Every sampling numbers its periods with consecutive integers. Grouping, filling
gaps and multiples then work on integers; labels are made last.

Kinds that end on their label (``W``, ``M``, ``Q``, ``Y``, ``BM``, ``BQ``, ``BY``)
carry the last day of the period, all others carry the start. A multiple such as
``2W`` is anchored at the first period that holds data; clock multiples such as
``5H`` are anchored at midnight of the first day. Days and clock units may be combined,
as in ``1D12H`` or ``1h30min``.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import scalars as S

# Day and month abbreviations usable as anchors (``W-WED``, ``Q-NOV``).
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Accepted spellings of each kind of period.
SPELLINGS = {
    "day": ("D",),
    "business_day": ("B",),
    "week": ("W",),
    "month_end": ("M", "ME", "m"),
    "month_start": ("MS",),
    "half_month_last": ("SM", "SME"),
    "half_month_first": ("SMS",),
    "quarter_end": ("Q", "QE"),
    "quarter_start": ("QS",),
    "year_end": ("Y", "YE", "A"),
    "year_start": ("YS", "AS"),
    "business_month_end": ("BM", "BME"),
    "business_month_start": ("BMS",),
    "business_quarter_end": ("BQ", "BQE"),
    "business_quarter_start": ("BQS",),
    "business_year_end": ("BY", "BYE", "BA"),
    "business_year_start": ("BYS", "BAS"),
    "hour": ("H", "h"),
    "minute": ("T", "min"),
    "second": ("S", "s"),
}
KIND_OF = {spelling: kind for kind, spellings in SPELLINGS.items() for spelling in spellings}

CLOCK_SECONDS = {"hour": 3600, "minute": 60, "second": 1}
MONTHS_PER = {"month": 1, "quarter": 3, "year": 12}

ALIAS = re.compile(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?")
COMBINED = re.compile(r"(\d*)(D|H|h|T|min|S|s)")


def _month_number(date: Column) -> Column:
    """Months since year 0, January = 0."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def _month_first(number: Column) -> Column:
    return F.make_date(
        F.call_function("div", number, F.lit(12)).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1)
    )


def _last_business_day(date: Column) -> Column:
    last = F.last_day(date)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def _first_business_day(first: Column) -> Column:
    return F.date_add(first, F.when(F.weekday(first) >= 5, 7 - F.weekday(first)).otherwise(F.lit(0)))


@dataclass(frozen=True)
class Sampling:
    """One parsed alias. ``index`` and ``label`` are inverse up to the period."""

    alias: str
    kind: str
    multiple: int
    anchor: str | None

    @classmethod
    def parse(cls, alias: str) -> "Sampling":
        if re.fullmatch(f"(?:{COMBINED.pattern}){{2,}}", alias) and len(COMBINED.findall(alias)) > 1:
            return cls._combined(alias)
        match = ALIAS.fullmatch(alias)
        kind = KIND_OF.get(match.group(2)) if match else None
        if kind is None:
            raise ValueError(f"unsupported sampling alias: {alias!r}")
        multiple = int(match.group(1) or 1)
        anchor = match.group(3)
        anchors = DAYS if kind == "week" else MONTHS if ("quarter" in kind or "year" in kind) else ()
        if multiple < 1 or (anchor is not None and anchor not in anchors):
            raise ValueError(f"unsupported sampling alias: {alias!r}")
        return cls(alias, kind, multiple, anchor)

    @classmethod
    def _combined(cls, alias: str) -> "Sampling":
        """A sum of days and clock units, in the largest clock unit that divides it."""
        seconds = 0
        for count, unit in COMBINED.findall(alias):
            seconds += int(count or 1) * CLOCK_SECONDS.get(KIND_OF[unit], S.DAY_SECONDS)
        kind = next(k for k, size in CLOCK_SECONDS.items() if seconds % size == 0)
        if not seconds:
            raise ValueError(f"unsupported sampling alias: {alias!r}")
        return cls(alias, kind, seconds // CLOCK_SECONDS[kind], None)

    @property
    def is_clock(self) -> bool:
        """Shorter than a day, so day rollups cannot serve it."""
        return self.kind in CLOCK_SECONDS

    @property
    def ends_on_label(self) -> bool:
        return self.kind == "week" or self.kind.endswith("_end")

    @property
    def _span_months(self) -> int:
        return next(n for unit, n in MONTHS_PER.items() if unit in self.kind)

    @property
    def _phase_months(self) -> int:
        """Month number (mod span) of the first month of a period."""
        if self.ends_on_label:
            ends = MONTHS.index(self.anchor) if self.anchor else 11
            return (ends + 1) % self._span_months
        return (MONTHS.index(self.anchor) if self.anchor else 0) % self._span_months

    @property
    def _week_anchor_day(self) -> int:
        """An epoch day on which a week ends; epoch day 0 is a Thursday."""
        return DAYS.index(self.anchor or "SUN") - 3

    def _is_business(self) -> bool:
        return self.kind.startswith("business_") and self.kind != "business_day"

    def index_of_day(self, day) -> Column:
        """Number of the single period that holds an epoch day."""
        day = S.column(day)
        if self.kind == "day":
            return day.cast("long")
        if self.kind == "business_day":
            # five per week, weekend days belong to Friday; epoch day -3 is a Monday
            monday_based = day + 3
            return S.integer_div(monday_based, 7) * 5 + F.least(F.pmod(monday_based, F.lit(7)), F.lit(4)).cast("long")
        if self.kind == "week":
            return -S.integer_div(-(day - self._week_anchor_day), 7)
        date = S.day_to_date(day)
        number = _month_number(date)
        if self.kind == "half_month_first":
            return number * 2 + (F.day(date) >= 15).cast("long")
        if self.kind == "half_month_last":
            # from the 15th, from the last day, and before the 15th still from the last day of the month before
            return number * 2 + F.when(date == F.last_day(date), 1).when(F.day(date) >= 15, 0).otherwise(-1)
        if self._is_business() and self.ends_on_label:
            # days after the last business day open the next month
            number = number + F.when(date > _last_business_day(date), F.lit(1)).otherwise(F.lit(0))
        if self._is_business() and not self.ends_on_label:
            # days before the first business day still belong to the month before
            number = number - F.when(date < _first_business_day(F.trunc(date, "MM")), F.lit(1)).otherwise(F.lit(0))
        return S.integer_div(number - self._phase_months, self._span_months)

    def index(self, seconds) -> Column:
        """Number of the single period that holds a time given in epoch seconds."""
        if self.is_clock:
            return S.integer_div(seconds, CLOCK_SECONDS[self.kind])
        return self.index_of_day(S.epoch_day(seconds))

    def label(self, index) -> Column:
        """Date (or, below a day, timestamp) that names a period."""
        index = S.column(index)
        if self.is_clock:
            return S.utc_timestamp(index * CLOCK_SECONDS[self.kind])
        if self.kind == "day":
            return S.day_to_date(index)
        if self.kind == "business_day":
            return S.day_to_date(S.integer_div(index, 5) * 7 + F.pmod(index, F.lit(5)) - 3)
        if self.kind == "week":
            return S.day_to_date(index * 7 + self._week_anchor_day)
        if self.kind.startswith("half_month"):
            first, odd = _month_first(S.integer_div(index, 2)), F.pmod(index, F.lit(2)) == 1
            middle = F.date_add(first, 14)
            if self.kind == "half_month_first":
                return F.when(odd, middle).otherwise(first)
            return F.when(odd, F.last_day(first)).otherwise(middle)
        first_month = index * self._span_months + self._phase_months
        if self.ends_on_label:
            last_month = _month_first(first_month + (self._span_months - 1))
            return _last_business_day(last_month) if self._is_business() else F.last_day(last_month)
        first = _month_first(first_month)
        return _first_business_day(first) if self._is_business() else first

    def origin(self, first_index) -> Column:
        """Index that multiples count from, given the lowest index with data."""
        first_index = S.column(first_index)
        if self.is_clock:
            per_day = S.DAY_SECONDS // CLOCK_SECONDS[self.kind]
            return first_index - F.pmod(first_index, F.lit(per_day))
        return first_index

    def merged(self, index, origin) -> Column:
        """Index of the multiple-period, in single-period units."""
        distance = S.column(index) - S.column(origin)
        if self.ends_on_label:
            steps = -S.integer_div(-distance, self.multiple)
        else:
            steps = S.integer_div(distance, self.multiple)
        return S.column(origin) + steps * self.multiple


def label_epoch_millis(label: Column, sampling: Sampling) -> Column:
    """Period label as epoch milliseconds, the unit of plotted series."""
    if sampling.is_clock:
        return F.unix_millis(label)
    return S.date_to_day(label) * (S.DAY_SECONDS * 1000)
