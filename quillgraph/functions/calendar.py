"""Recurrences, buckets and live windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of recurrence. Fixed values.
RULES = ("daily", "weekly", "monthly", "yearly")


def occurrences(events: DataFrame, start: str = "start", rule: str = "repeat", until: str = "repeat_until") -> DataFrame:
    """One row per occurrence, column `occurs` (date), up to `until`; events without a rule or end occur once.

    Months and years without that day are skipped, not moved to their last day.
    However far the end is, all occurrences before it are there.
    """
    begin, end = F.to_date(F.col(start)), F.to_date(F.coalesce(F.col(until), F.col(start)))
    months = F.months_between(F.last_day(end), begin).cast("int") + 1
    steps = (
        F.when(F.col(rule) == "daily", F.date_diff(end, begin)).when(F.col(rule) == "weekly", F.floor(F.date_diff(end, begin) / 7))
        .when(F.col(rule) == "monthly", months).when(F.col(rule) == "yearly", F.floor(months / 12)).otherwise(0).cast("int")
    )
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), steps)))
    rows = events.withColumn("_k", k)
    day = (
        F.when(F.col(rule) == "daily", F.date_add(begin, F.col("_k"))).when(F.col(rule) == "weekly", F.date_add(begin, F.col("_k") * 7))
        .when(F.col(rule) == "monthly", F.add_months(begin, F.col("_k"))).when(F.col(rule) == "yearly", F.add_months(begin, F.col("_k") * 12)).otherwise(begin)
    )
    rows = rows.withColumn("occurs", day).drop("_k")
    kept = F.dayofmonth("occurs") == F.dayofmonth(begin)
    return rows.where(((F.col("occurs") <= end) & (kept | ~F.col(rule).isin("monthly", "yearly"))) | (F.col("occurs") == begin))


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _steps(begin: Column, rule: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """First and last step from `begin` whose date can lie between low and high, both included; the last is below the first where there is none."""
    days = lambda day: F.date_diff(day, begin)
    first_month = _months(low) - _months(begin) + F.when(F.dayofmonth(begin) < F.dayofmonth(low), 1).otherwise(0)
    last_month = _months(high) - _months(begin) - F.when(F.dayofmonth(begin) > F.dayofmonth(high), 1).otherwise(0)
    pick = lambda daily, weekly, monthly, yearly: F.when(rule == "daily", daily).when(rule == "weekly", weekly).when(rule == "monthly", monthly).when(rule == "yearly", yearly)
    up = lambda x, n: F.ceil(x / n).cast("int")
    down = lambda x, n: F.floor(x / n).cast("int")
    first = pick(days(low), up(days(low), 7), first_month, up(first_month, 12))
    last = pick(days(high), down(days(high), 7), last_month, down(last_month, 12))
    once = F.when((begin >= low) & (begin <= high), 0).otherwise(-1)
    return F.greatest(F.lit(0), F.coalesce(first, F.lit(0))), F.coalesce(last, once)


def _dates(begin: Column, rule: Column, first: Column, last: Column) -> Column:
    """The dates of monthly and yearly steps that there are, as an array."""
    none = F.array().cast("array<int>")
    months = F.when(rule == "yearly", 12).otherwise(1)
    days = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(none), lambda k: F.add_months(begin, k * months))
    return F.filter(days, lambda d: F.dayofmonth(d) == F.dayofmonth(begin))


def _spans(start: str, rule: str, until: str, low: Column | None, high: Column | None) -> tuple[Column, Column, Column, Column]:
    begin = F.to_date(F.col(start))
    end = F.greatest(begin, F.to_date(F.coalesce(F.col(until), F.col(start))))
    end = end if high is None else F.least(end, high)
    return begin, F.col(rule), *_steps(begin, F.col(rule), begin if low is None else F.greatest(begin, low), end)


def occurrences_between(events: DataFrame, low: Column, high: Column, start: str = "start", rule: str = "repeat", until: str = "repeat_until") -> DataFrame:
    """As occurrences, but only those from the date low to the date high, both included.

    The first and last step inside are found by arithmetic, so that no row is made for any other
    date: a view of a month costs the same however long ago an event began.
    """
    begin, kind, first, last = _spans(start, rule, until, low, high)
    none = F.array().cast("array<date>")
    by_day = F.when(kind == "weekly", 7).otherwise(1)
    even = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: F.date_add(begin, k * by_day))).otherwise(none)
    days = F.when(kind.isin("monthly", "yearly"), _dates(begin, kind, first, last)).otherwise(even)
    return events.withColumn("occurs", F.explode(days))


def occurrence_totals(events: DataFrame, low: Column | None = None, high: Column | None = None, start: str = "start", rule: str = "repeat", until: str = "repeat_until") -> DataFrame:
    """events with n, the number of their occurrences (from low to high, where given), last, the last of them, and days, the sum of their days since 1970, without a row for any.

    Daily and weekly ones by formula; of monthly and yearly ones the dates that the month lacks are left out.
    """
    begin, kind, first, last = _spans(start, rule, until, low, high)
    n = F.greatest(F.lit(0), last - first + 1).cast("long")
    by_day = F.when(kind == "weekly", 7).otherwise(1)
    sums = n * (F.unix_date(begin) + by_day * first) + by_day * (n * (n - 1) / 2).cast("long")
    skips = kind.isin("monthly", "yearly")
    rows = events.withColumn("_dates", F.when(skips, _dates(begin, kind, first, last)))
    totals = {
        "n": F.when(skips, F.size("_dates").cast("long")).otherwise(n),
        "last": F.when(skips, F.try_element_at("_dates", F.lit(-1))).otherwise(F.when(n > 0, F.date_add(begin, by_day * last))),
        "days": F.when(skips, F.aggregate("_dates", F.lit(0).cast("long"), lambda s, d: s + F.unix_date(d))).otherwise(sums),
    }
    return rows.withColumns(totals).drop("_dates")


def bucket(ts: Column, view: str) -> Column:
    """Start of the month, week or day that a calendar view shows."""
    return F.date_trunc(view, ts)


def is_live(now: Column, golive: Column, expire: Column) -> Column:
    """From golive on and before expire; either may be null."""
    return (golive.isNull() | (golive <= now)) & (expire.isNull() | (expire > now))
