"""Scalar column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_LINE = "decimal(28,4)"
MONEY_POSTING = "decimal(18,2)"

# Spellings of "no text".
NULL_SPELLINGS = ("", "nan", "None")

# Accepted shapes of a date. Digits stand for themselves, so that the shape tells two years from four. No text
# has two of these shapes. What follows an accepted date is a time, fractions, am or pm and a zone.
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_SHAPES = {
    "year first": r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})",
    "numbers": r"(\d{1,2})([-/.])(\d{1,2})\6(\d{4}|\d\d)",
    "day and name": rf"(\d{{1,2}})[ -/.]? *({_MONTH})[ -/.,]? *(\d{{4}}|\d\d)",
    "name and day": rf"({_MONTH})[ -/.]? *(\d{{1,2}})(?!\d),? *[ -/.]?(\d{{4}}|\d\d)",
    "one number": r"(\d{4})(\d\d)(\d\d)",
}
_CLOCK = r"(?:[T ] *(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:(\.\d{1,6})\d{0,3})?)?(?: *([ap])m)?(?: *(?:z|[+-]\d\d:?\d\d))?)?"
_DATE = f"(?i)^(?:{'|'.join(DATE_SHAPES.values())}){_CLOCK}$"
#: A date in its parts: mark, year, first and second number, name, the separator if the order of the numbers is open, hour,
#: minute, second, a or p. Groups of the other shapes are empty.
_PARTS = "=,$1$8$11$14$15,$3$5$16,$4$7$9$13$17,$10$12,$6,$18,$19,$20$21,$22,"
#: Two-digit years from here on are of the last century.
CENTURY_PIVOT = 69

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def unfused(c: Column) -> Column:
    """The column as it is, through a higher-order function.

    Spark fuses projections into one generated method, which the JVM never compiles above 8000 bytes. A projection that holds
    a higher-order function is not fused, and its code is split into small methods.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def heading_key(c: Column) -> Column:
    """Heading text reduced to lower-case letters, digits and slashes."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9/]", "")


def text_or_null(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(*NULL_SPELLINGS), trimmed)


def parse_amount(c: Column) -> Column:
    """Amount text to money: brackets negate, everything but digits, dot and minus is dropped, junk becomes 0."""
    trimmed = F.trim(c)
    digits = F.regexp_replace(trimmed, r"[^0-9.\-]", "")
    zero = F.lit(0).cast(MONEY_LINE)
    # Texts without a digit that are frequent are not cast: the JVM makes an exception of each.
    value = F.when(trimmed.isin("", "-"), zero).otherwise(F.coalesce(digits.try_cast(MONEY_LINE), zero))
    bracketed = trimmed.startswith("(") & trimmed.endswith(")")
    return F.when(bracketed, -value).otherwise(value).cast(MONEY_LINE)


def amount_is_suspect(c: Column) -> Column:
    """True where ``parse_amount`` changes the meaning: letters, comma decimals, a minus that is not leading, or digits that
    are no number of up to 24 places before the point."""
    trimmed = F.coalesce(F.trim(c), F.lit(""))
    digits = F.regexp_replace(trimmed, r"[^0-9.\-]", "")
    unread = digits.rlike("[0-9]") & digits.try_cast(MONEY_LINE).isNull()
    return unread | trimmed.rlike("[A-Za-z]") | trimmed.rlike(r",\d{1,2}\)?$") | trimmed.rlike(r"[0-9.]-")


def date_outline(c: Column) -> Column:
    """A date text with 9 for each digit and a for each run of letters, for listings of what was not read."""
    return F.regexp_replace(F.regexp_replace(text_or_null(c), "[0-9]", "9"), "[A-Za-z]+", "a")


def _month_number(word: Column) -> Column:
    first = F.lower(F.substring(word, 1, 3))
    return F.floor((F.position(first, F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int")


def _date_numbers(parts: Column, i: int) -> dict[str, Column]:
    """Year, two numbers, hour and minute of text ``i``, cut into its parts."""
    part = lambda k: F.get(parts, F.lit(k))
    number = lambda k: part(k).try_cast("int")
    century = F.when(F.length(part(1)) > 2, 0).when(number(1) >= CENTURY_PIVOT, 1900).otherwise(2000)
    hour = number(6)
    half_day = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part(9)) == "p", 12).otherwise(0))
    columns = {
        "year": number(1) + century,
        "x": F.when(part(4) == "", number(2)).otherwise(_month_number(part(4))),
        "y": number(3),
        "hour": F.when(part(6) == "", 0).when(part(9) == "", hour).otherwise(half_day),
        "minute": F.when(part(6) == "", 0).otherwise(number(7)),
        "open": part(5) != "",
    }
    return {f"_{k}{i}": c for k, c in columns.items()}


def with_dates(df: DataFrame, texts: dict[str, Column], day_first: bool = True) -> DataFrame:
    """Add readings of date texts: for each name, name_month reads numbers month first and name_day (if wanted) day first.

    One regular expression cuts a text into its parts; the readings are arithmetic on those. They agree for shapes that
    settle the order. Zones are dropped: the time is that on the writer's clock. What has no accepted shape, or names no
    day, is null. Each step is a projection of its own, so that nothing is computed twice and no generated method outgrows
    what the JVM compiles.
    """
    kept, ids = df.columns, list(enumerate(texts))
    of = lambda part, i: F.col(f"_{part}{i}")
    # A text without a shape stands as it is, so only those cut begin with the mark.
    plain = lambda t: F.when(~F.startswith(F.trim(t), F.lit("=")), text_or_null(t))
    cut = F.transform(F.array(*texts.values()), lambda t: F.split(F.regexp_replace(plain(t), _DATE, _PARTS), ","))
    cut = F.transform(cut, lambda p: F.when(F.get(p, F.lit(0)) == "=", p))
    df = df.withColumn("_cut", cut)
    # Spark splits the generated code of a projection with a higher-order function; else this one would outgrow a method.
    seconds = F.transform("_cut", lambda p: F.when(F.get(p, F.lit(8)) == "", F.lit("0")).otherwise(F.get(p, F.lit(8))).cast("decimal(16,6)"))
    numbers = {"_seconds": seconds}
    for i, _ in ids:
        numbers |= _date_numbers(F.get("_cut", F.lit(i)), i)
    df = df.withColumns(numbers)
    month_first, swapped = {}, {}
    for i, name in ids:
        rest = (of("hour", i), of("minute", i), F.get("_seconds", F.lit(i)))
        month_first[f"{name}_month"] = F.when(of("x", i) <= 12, F.try_make_timestamp_ntz(of("year", i), of("x", i), of("y", i), *rest))
        # Only the order of numbers is open; a first number above 12 is no month.
        other = F.when(of("y", i) <= 12, F.try_make_timestamp_ntz(of("year", i), of("y", i), of("x", i), *rest))
        swapped[f"{name}_day"] = F.when(of("open", i), other).otherwise(F.col(f"{name}_month"))
    df, readings = df.withColumns(month_first), list(month_first)
    if day_first:
        df, readings = df.withColumns(swapped), [*readings, *swapped]
    return df.select(*kept, *readings)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days of a difference, rounded down (a plain date difference would ignore the time of day)."""

    def time_of_day(c: Column) -> Column:
        return c - F.to_date(c).cast("timestamp_ntz")

    return F.datediff(F.to_date(later), F.to_date(earlier)) - F.when(
        time_of_day(later) < time_of_day(earlier), 1
    ).otherwise(0)


def year_month(c: Column) -> Column:
    return F.date_format(F.to_date(c), "yyyy-MM")


def weekday_name(c: Column) -> Column:
    number = F.weekday(F.to_date(c))
    name = F.when(number == 0, WEEKDAYS[0])
    for i, day in enumerate(WEEKDAYS[1:], 1):
        name = name.when(number == i, day)
    return name


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rate(flag: Column) -> Column:
    """Share of true values, six places."""
    return F.round(F.avg(flag.cast("int")), 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, six places, null when b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def measure(c: Column) -> Column:
    """Decimal measure as a double with six places."""
    return F.round(c, 6).cast("double")


def plain_number(c: Column) -> Column:
    """Two-place money as text, with at least one and no needless second decimal."""
    return F.regexp_replace(c.cast("string"), r"(\.\d)0$", "$1")


def decimals_as_double(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
