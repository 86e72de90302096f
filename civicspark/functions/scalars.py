"""Casts, dates, distances and text helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feet and miles per degree of latitude and of longitude, and the accepted date forms.
FEET = (364000.0, 288200.0)
MILES = (69.0, 54.6)
DATE_FORMS = ["M/d/yyyy h:m:s a", "M/d/yyyy H:m:s", "yyyy-M-d'T'H:m:s", "M/d/yyyy"]
# A text that starts with the form is enough, whatever follows it.
_DATE_SHAPES = [
    r"^(\d{1,2}/\d{1,2}/\d{1,4} +\d{1,2}:\d{1,2}:\d{1,2} *[AaPp][Mm])",
    r"^(\d{1,2}/\d{1,2}/\d{1,4} +\d{1,2}:\d{1,2}:\d{1,2})",
    r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})",
    r"^(\d{1,2}/\d{1,2}/\d{1,4})",
]


def to_text(c: Column) -> Column:
    return c.cast("string")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Integer from text or number, rounded half away from zero; text such as ' 3.7 ' counts, junk is NULL."""
    return F.round(c.cast("string").try_cast("double")).try_cast("int")


def to_date(c: Column, lenient: bool = False) -> Column:
    """ISO dates only; ``lenient`` also takes the month-first forms of :func:`epoch_seconds`."""
    text = F.trim(c.cast("string"))
    strict = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz").cast("date"))
    return F.coalesce(strict, parse_moment(text).cast("date")) if lenient else strict


def to_moment(c: Column, lenient: bool = False) -> Column:
    text = F.trim(c.cast("string"))
    strict = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz"))
    return F.coalesce(strict, parse_moment(text)) if lenient else strict


def parse_moment(text: Column) -> Column:
    """First of the four accepted forms that the text starts with; NULL if none."""
    tried = []
    for shape, form in zip(_DATE_SHAPES, DATE_FORMS):
        hit = F.regexp_replace(F.regexp_extract(text, shape, 1), r"\s+", " ")
        hit = F.regexp_replace(hit, r"(?i)(\d) ?([ap]m)$", "$1 $2")
        tried.append(F.try_to_timestamp(F.nullif(hit, F.lit("")), F.lit(form)).cast("timestamp_ntz"))
    return F.coalesce(*tried)


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 (UTC) of a text date in one of four forms, 0 when blank or unreadable."""
    moment = parse_moment(F.btrim(text, F.lit(' \t\r\n"')))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("SECOND", origin, moment), F.lit(0)).cast("bigint")


def resolution_days(created: Column, closed: Column) -> Column:
    """Days between two epoch seconds as float, -1 unless both are known and in order."""
    days = (closed - created).cast("float") / F.lit(86400.0).cast("float")
    return F.when((created > 0) & (closed > created), days).otherwise(F.lit(-1.0)).cast("float")


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale: tuple[float, float]) -> Column:
    """Flat-earth distance; ``scale`` is FEET or MILES per degree."""
    return F.sqrt(F.pow((lat1 - lat2) * F.lit(scale[0]), F.lit(2)) + F.pow((lon1 - lon2) * F.lit(scale[1]), F.lit(2)))


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees, in single precision."""
    dlat = (lat1.cast("float") - lat2.cast("float")).cast("float")
    dlon = (lon1.cast("float") - lon2.cast("float")).cast("float")
    return ((dlat * dlat).cast("float") + (dlon * dlon).cast("float")).cast("float")


def present(coordinate: Column) -> Column:
    """A coordinate of 0 counts as missing."""
    return coordinate.isNotNull() & (coordinate != 0)


def missing_key(c: Column) -> Column:
    return c.isNull() | F.trim(c.cast("string")).isin("", "0")


def truncated(text: Column, limit: int, tail: str = "") -> Column:
    cut = F.substring(text, 1, limit)
    return cut if not tail else F.when(F.length(text) > limit, F.concat(cut, F.lit(tail))).otherwise(text)


def looks_like_bbl(text: Column) -> Column:
    """The ten-digit lot number when the text is one after dropping blanks and dashes, else NULL."""
    bare = F.regexp_replace(text, r"[\s-]", "")
    return F.when(bare.rlike(r"^[0-9]{10}$"), bare)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the md5 of the parts joined by '_'."""
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 16)


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c.cast("double"))


def grouped(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c, 0)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
