"""Due dates written in many ways, and days overdue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import fixed_values as fv

# Date shapes that are understood. Anything else counts as unreadable.
_TIME = r"(?:[T ](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
SHAPES = [
    rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}",
    r"(\d{4})(\d{2})(\d{2})",
    rf"(\d{{1,2}})([-/.])(\d{{1,2}})\9(\d{{4}}){_TIME}",
    r"(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})",
    r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})",
]
ANY_SHAPE = "^(?:" + "|".join(SHAPES) + ")$"
# Groups of ANY_SHAPE that hold year, day and month. Only one shape's groups are filled.
PARTS = {
    "dayfirst": ("$1$5$11$14$17", "$3$6$8$12$16", "$4$7$10$13$15"),
    "iso": ("$1$5$11$14$17", "$4$7$8$12$16", "$3$6$10$13$15"),
}
_MARK = "\x01"
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]


def _is_date(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = (
        F.when(m.isin(4, 6, 9, 11), F.lit(30))
        .when(m == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28)))
        .otherwise(F.lit(31))
    )
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def _date(y: Column, m: Column, d: Column) -> Column:
    """make_date without the error for impossible days."""
    return F.when(_is_date(y, m, d), F.make_date(y, m, d))


def _month_number(text: Column) -> Column:
    numbers = {month: i for i, month in enumerate(MONTHS, 1)}
    numbers |= {month[:3]: i for month, i in numbers.items()}
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    is_number = text < F.lit(":")
    return F.when(is_number, text.cast("int")).otherwise(F.try_element_at(table, F.lower(text)))


def parse_due_date(text: Column, date_mode: str = "dayfirst") -> Column:
    """Read a due date; null where it is unreadable.

    ``dayfirst`` reads the day before the month wherever that gives a date, in ``2026-05-12`` too
    (5 December). ``iso`` prefers year, month, day in year-first dates.

    One search sorts any known shape into year, day and month. Lambdas over one element name the
    pieces, so that none is worked out more than once, and no cast is tried that can fail.
    """
    if date_mode not in PARTS:
        raise ValueError("date_mode must be 'dayfirst' or 'iso'")
    s = F.btrim(text, F.lit(fv.WHITE_SPACE))
    sorted_out = F.split(F.regexp_replace(s, ANY_SHAPE, _MARK.join(PARTS[date_mode])), _MARK)

    def numbers(p: Column) -> Column:
        pieces = F.struct(
            F.get(p, F.lit(0)).cast("int").alias("y"),
            F.get(p, F.lit(1)).cast("int").alias("d"),
            _month_number(F.get(p, F.lit(2))).alias("m"),
        )
        return F.when(F.size(p) == 3, pieces)

    def date(p: Column) -> Column:
        return F.coalesce(_date(p["y"], p["m"], p["d"]), _date(p["y"], p["d"], p["m"]))

    return F.get(F.transform(F.transform(F.array(sorted_out), numbers), date), F.lit(0))


def days_overdue(due_date: Column, as_of: Column) -> Column:
    """Whole days past due, never below 0. ``as_of`` is the local date of the reader."""
    return F.greatest(F.datediff(as_of, due_date), F.lit(0))
