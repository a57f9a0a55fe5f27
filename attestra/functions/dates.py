"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they are written in the documents.
MONTHS = {
    "enero": 1,
    "febrero": 2,
    "marzo": 3,
    "abril": 4,
    "mayo": 5,
    "junio": 6,
    "julio": 7,
    "agosto": 8,
    "septiembre": 9,
    "setiembre": 9,
    "octubre": 10,
    "noviembre": 11,
    "diciembre": 12,
}
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
WRITTEN = rf"(?i)\b(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)})\s+de\s+(\d{{4}})\b"
DAY_FIRST = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b"


def _valid(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """The first date.  The shape found first decides (ISO, written month,
    day first), even if its date does not exist."""
    month = F.create_map(*[F.lit(str(x)) for kv in MONTHS.items() for x in kv])

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(c, pattern, k)

    return (
        F.when(c.rlike(ISO), _valid(part(ISO, 1), part(ISO, 2), part(ISO, 3)))
        .when(c.rlike(WRITTEN), _valid(part(WRITTEN, 3), F.try_element_at(month, F.lower(part(WRITTEN, 2))), part(WRITTEN, 1)))
        .when(c.rlike(DAY_FIRST), _valid(part(DAY_FIRST, 3), part(DAY_FIRST, 2), part(DAY_FIRST, 1)))
    )


def split_period(c: Column) -> Column:
    """Start and end of a period written ``A a B`` or ``A al B``."""
    parts = F.split(F.replace(c, F.lit(" al "), F.lit(" a ")), " a ")
    return F.struct(parse_date(F.get(parts, F.lit(0))).alias("start"), parse_date(F.get(parts, F.lit(1))).alias("end"))


def month_start(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01")).try_cast("date"))


def seconds_to_midnight(c: Column) -> Column:
    next_day = F.date_trunc("day", c) + F.expr("INTERVAL 1 DAY")
    return F.unix_timestamp(next_day) - F.unix_timestamp(c)


def spanish_date(c: Column) -> Column:
    """dd/MM/yyyy; what is not an ISO date passes through."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "dd/MM/yyyy"), c)


def backoff_seconds(attempt: Column, base: int = 5) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")
