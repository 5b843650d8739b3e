"""Date functions as Column expressions.  The session time zone is UTC; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions.binding import let

# Named zones allowed in mail-style dates.
ZONE_OFFSETS = (("GMT|UTC?|Z", "+0000"), ("EST|CDT", "-0500"), ("EDT", "-0400"), ("CST|MDT", "-0600"),
                ("MST|PDT", "-0700"), ("PST", "-0800"))
# Accepted formats, each behind the shape of text it can parse.
FORMATS = (
    (r"^\d+ \w{3} \d{4} \d{2}:\d{2}:\d{2} [+\-]\d{4}$", "d MMM yyyy HH:mm:ss Z"),
    (r"^\d+ \w{3} \d{4} \d{2}:\d{2} [+\-]\d{4}$", "d MMM yyyy HH:mm Z"),
    (r"^\d+ \w{3} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
    (r"^\d+ \w{3} \d{4} \d{2}:\d{2}$", "d MMM yyyy HH:mm"),
    (r"^\d+ \w{3} \d{4}$", "d MMM yyyy"),
    (r"^\w{3} \d+, \d{4} \d{2}:\d{2}:\d{2}$", "MMM d, yyyy HH:mm:ss"),
    (r"^\w{3} \d+, \d{4}$", "MMM d, yyyy"),
    (r"^\w{4,} \d+, \d{4}$", "MMMM d, yyyy"),
    (r"^\d+ \w{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}/\d+/\d+$", "yyyy/M/d"),
    (r"^\d+/\d+/\d{4}$", "M/d/yyyy"),
)
DAY = r"^\d{4}-\d{2}(-\d{2})?$"
ISO = r"^\d{4}-\d{2}(-\d{2})?([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([ ]?([Zz]|[+\-]\d{2}:?\d{2}))?)?$"


def parse_date(text: Column, now: Column) -> Column:
    """Permissive parse; null outside 1990-01-01 .. now + 1 day."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    for names, offset in ZONE_OFFSETS:
        t = F.regexp_replace(t, rf"(?i)(:[0-9.]+) ?({names})$", f"$1 {offset}")
    return let(let(t, _any_format), lambda ts: sane_time(ts, now))


def _any_format(t: Column) -> Column:
    iso = F.regexp_replace(F.regexp_replace(t, r" \+0000$", "Z"), r" ?([+\-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(
        F.when(t.rlike(DAY), t.try_cast("timestamp")),
        F.when(t.rlike(ISO), iso.try_cast("timestamp")),
        *[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f))) for shape, f in FORMATS],
    )


def sane_time(ts: Column, now: Column) -> Column:
    """Event time when it lies in the accepted range, else null (never replaced by arrival time)."""
    low = F.lit("1990-01-01 00:00:00").cast("timestamp")
    return F.when((ts >= low) & (ts <= now + F.expr("INTERVAL 1 DAY")), ts)


def valid_day(text: Column) -> Column:
    """Strict calendar date in yyyy-MM-dd form."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_range(start: Column, end: Column, now: Column) -> Column:
    """Both days real, start <= end <= today, and the start at most 90 days back."""
    both = valid_day(start) & valid_day(end)
    first, last = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    recent = first.cast("timestamp") >= now - F.expr(f"INTERVAL {K.RANGE_MAX_DAYS} DAY")
    return F.coalesce(both & (first <= last) & (last <= F.to_date(now)) & recent, F.lit(False))


def date_eligibility(published: Column, start: Column, end: Column) -> Column:
    return (
        F.when(published.isNull(), "unknownDate")
        .when(~F.to_date(published).between(start, end), "outsideRange")
        .otherwise("eligible")
    )


def local_date(ts: Column, zone: str = "Asia/Kolkata", with_time: bool = False, placeholder: str = "Date unknown") -> Column:
    pattern = "d MMM yyyy, HH:mm" if with_time else "d MMM yyyy"
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit(placeholder))
