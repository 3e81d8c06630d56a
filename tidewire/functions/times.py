"""Time rules as Column functions; the current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the zone in which editions are dated.
ZONE = "Asia/Karachi"


def trusted(publish: Column, scraped: Column) -> Column:
    return F.coalesce(publish, scraped)


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3_600_000_000)


def parse_feed_date(text: Column) -> Column:
    """RFC 822 or ISO dates as UTC; null for what is neither."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\b(?:GMT|UTC|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")),
        F.trim(text).try_cast("timestamp"),
    )


def publish_status(ts: Column, precision: Column | None = None) -> Column:
    """``missing``, ``date_only`` (flagged so, or local midnight to the microsecond) or ``precise``."""
    flagged = F.lit(False) if precision is None else F.coalesce(F.lower(F.trim(precision)).isin("date", "day"), F.lit(False))
    midnight = (F.unix_micros(ts.cast("timestamp")) % 86_400_000_000) == 19 * 3_600_000_000
    return F.when(ts.isNull(), "missing").when(flagged | midnight, "date_only").otherwise("precise")


def morning_fresh(run_at: Column, now: Column) -> Column:
    """Whether an edition run at ``run_at`` is this morning's at ``now``."""
    hour = F.hour(F.from_utc_timestamp(run_at, ZONE))
    return (local_date(run_at) == local_date(now)) & age_hours(run_at, now).between(0, 20) & (hour >= 5)


MONTH_DAY = (
    r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"
)


def watch_date(text: Column, reference: Column) -> Column:
    """The first month-day of a text as a date; without a year in the reference date's year; null if it is past."""
    part = lambda k: F.regexp_extract(text, MONTH_DAY, k)
    year = F.when(part(3) != "", part(3)).otherwise(F.date_format(reference, "yyyy"))
    day = F.try_to_date(F.concat_ws(" ", year, F.initcap(part(1)), part(2)), "yyyy MMM d")
    return F.when((part(1) != "") & (day >= reference), day)


#: The months of a line to watch by their short and long names.
MONTHS = "Jan(?:uary)? Feb(?:ruary)? Mar(?:ch)? Apr(?:il)? May Jun(?:e)? Jul(?:y)? Aug(?:ust)? Sep(?:t(?:ember)?)? Oct(?:ober)? Nov(?:ember)? Dec(?:ember)?".split()
NAMED_DAY = rf"(?i)\b(?:{'|'.join(MONTHS)})\.?\s+\d{{1,2}}(?:,\s*\d{{4}})?\b"


def named_day(mention: Column, reference: Column) -> Column:
    """The date of a match of ``NAMED_DAY``, without a year in that of ``reference``; null for no day of the calendar."""
    part = F.split(F.regexp_replace(mention, "[.,]", ""), r"\s+")
    year = F.coalesce(F.get(part, F.lit(2)), F.date_format(reference, "yyyy"))
    return F.try_to_date(F.concat_ws(" ", year, F.initcap(F.substring(part[0], 1, 3)), part[1]), "yyyy MMM d")
