"""Date functions: Column to Column, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let

# Fixed values.
EARLIEST_YEAR = 1990
UPLOAD_FOLDERS = r"(?i)/(?:wp-content|uploads?|media|files|assets|images?|img|static|download)/"
ARCHIVED = r"(?i)^https?://web\.archive\.org/web/"
PATH_DATE = r"/((?:19|20)\d{2})/(0[1-9]|1[0-2])(?:/(0[1-9]|[12]\d|3[01]))?(?=/|$|[?#])"
# Evidence for a date, best first.
DATE_BASES = ("library", "title-date", "url-date", "file-metadata", "capture", "ingest")
OVERRIDE_DAYS = 365


def parse_date(text: Column) -> Column:
    """A real calendar date from YYYY-MM-DD or YYYY-MM at the start of a text, not before 1990; else null."""
    at = lambda k: F.regexp_extract(F.trim(text), r"^(\d{4})-(\d{2})(?:-(\d{2}))?", k)
    day = F.when(at(3) == "", "01").otherwise(at(3))
    found = F.try_to_date(F.concat_ws("-", at(1), at(2), day), "yyyy-MM-dd")
    return let(found, lambda d: F.when(F.year(d) >= EARLIEST_YEAR, d))


def split_title_date(title: Column) -> Column:
    """struct(title, day): a title without its filing-date prefixes, and the outermost of these that is a date."""
    text = F.trim(title)
    prefixes = F.regexp_extract(text, r"^((?:\d{4}-\d{2}-\d{2}\s+[-–—]\s+(?=\S))*)", 1)
    days = F.filter(F.transform(F.regexp_extract_all(prefixes, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), parse_date), lambda d: d.isNotNull())
    return F.struct(F.substr(text, F.length(prefixes) + 1).alias("title"), F.get(days, F.lit(0)).alias("day"))


def url_date(url: Column) -> Column:
    """The date in a blog-style path, null below upload folders; archived addresses are read for what they wrap."""
    path = F.regexp_replace(F.regexp_replace(url, ARCHIVED + r"\d+[a-z_]*/", ""), r"(?i)^https?://[^/]+", "")
    part = lambda k: F.regexp_extract(path, PATH_DATE, k)
    found = parse_date(F.concat(part(1), F.lit("-"), part(2), F.when(part(3) != "", F.concat(F.lit("-"), part(3))).otherwise("")))
    return F.when(~path.rlike(UPLOAD_FOLDERS), found)


def capture_date(url: Column) -> Column:
    """The day on which a web archive captured the page."""
    part = lambda k: F.regexp_extract(url, ARCHIVED + r"(\d{4})(\d{2})(\d{2})", k)
    return parse_date(F.concat_ws("-", part(1), part(2), part(3)))


def ranked_date(library: Column, title_date: Column, in_url: Column, file_date: Column, captured: Column, ingest: Column) -> Column:
    """struct(day, basis): the best evidence for a date.

    Title, address and capture count only up to the ingest day; a library date a year or more before the address's
    gives way to it.
    """
    bound = lambda d: F.when(ingest.isNull() | (d <= ingest), d)
    url_day = bound(in_url)
    stale = F.datediff(url_day, library) >= OVERRIDE_DAYS
    order = [
        (F.when(stale, url_day), "url-date"),
        (library, "library"),
        (bound(title_date), "title-date"),
        (url_day, "url-date"),
        (file_date, "file-metadata"),
        (bound(captured), "capture"),
        (ingest, "ingest"),
    ]
    pick = [F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(b).alias("basis"))) for d, b in order]
    return F.coalesce(*pick, F.struct(F.lit(None).cast("date").alias("day"), F.lit("unknown").alias("basis")))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_start(label: Column) -> Column:
    """The first day of a quarter such as 2024-Q3."""
    return F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 7, 1).cast("int") * 3 - 2, F.lit(1))


def window_start(day: Column, months: int = 24) -> Column:
    """So many months back, to the start of that quarter."""
    return F.date_trunc("quarter", F.add_months(day, -months)).cast("date")


def mail_date(text: Column) -> Column:
    """The day of an RFC 822 date in its own offset."""
    return F.try_to_date(F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy")


def claim_date(text: Column) -> Column:
    """struct(day, basis) of a first-seen claim: a date, a month, or a year as its first day."""
    full = parse_date(text)
    year = F.regexp_extract(F.trim(text), r"^(\d{4})$", 1)
    only = F.when((year != "") & (F.try_to_number(F.nullif(year, F.lit("")), F.lit("9999")) >= EARLIEST_YEAR), F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd"))
    return F.struct(F.coalesce(full, only).alias("day"), F.when(full.isNotNull(), "date").when(only.isNotNull(), "year").alias("basis"))
