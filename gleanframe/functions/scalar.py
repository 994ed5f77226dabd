"""Scalar expressions shared by the operators (all stay inside Catalyst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# Text accepted as a number, date formats tried in order,
# values that never identify anything.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
# Shapes of date text; what the groups hold is written side by side in DATE_PARTS: the year, month and day of a text that
# begins with the year, two numbers in either order with the year after them, a month's name and day, and the time.
DATE_TEXT = (
    r"^(?:(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{4})(\d\d)(\d\d)|(\d{1,2})([-/.])(\d{1,2})\9(\d{4})"
    r"|([A-Za-z]{3,9})\.? (\d{1,2}), ?(\d{4})|(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4}))"
    r"(?:(?: +|T)(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,9})?))?(?: ?([AaPp])[Mm])? ?(Z|[+-]\d\d:?\d\d)?)?|(\d{4}))$"
)
DATE_PARTS = "$1$5$23|$3$6|$4$7|$8|$10|$11$14$17|$12$16|$13$15|$18|$19|$20|$21|$22"
LONGEST_DATE = 64
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BLANKS = " \t\n\r\f\v\u00a0"
GENERIC_VALUES = ("да", "нет", "yes", "no", "true", "false", "0", "1", "-", "нет данных", "nan", "none")

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIMES)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def col(name: str) -> Column:
    """Reference a column literally: headers may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN taken as missing and -0.0 as 0.0."""
    c = col(name)
    return F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype)) if is_fractional(dtype) else c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def text_to_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_TEXT), strip(c).try_cast("double"))


def number(name: str, dtype: T.DataType) -> Column:
    """The column as double, with whatever is not a number as null."""
    if isinstance(dtype, T.StringType):
        return text_to_number(col(name))
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return present(name, dtype).cast("double")
    return F.lit(None).cast("double")


def text_to_timestamp(c: Column, day_first: bool = False) -> Column:
    """Date text as a timestamp, else null.

    The shape of the text says which of its numbers is what, so nothing is tried in vain: one expression takes the
    parts out, and they make the timestamp or not.  Of ``01/02/2024`` the month comes first unless ``day_first``; a
    first number above 12 is the day.  A zone shifts the time to the session's.
    """
    value = strip(c)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for key in dict.fromkeys((m, m[:3])) for x in (key, i)])

    def made(p: Column) -> Column:
        whole = lambda i: F.nullif(p[i], F.lit("")).try_cast("int")
        a, b = (whole(4), whole(3)) if day_first else (whole(3), whole(4))
        swapped = (a > 12) & (b <= 12)
        month = F.when(p[6] != "", F.try_element_at(months, F.lower(p[6]))).when(p[3] != "", F.when(swapped, b).otherwise(a)).otherwise(F.coalesce(whole(1), F.lit(1)))
        day = F.when(p[6] != "", whole(7)).when(p[3] != "", F.when(swapped, a).otherwise(b)).otherwise(F.coalesce(whole(2), F.lit(1)))
        hour = F.coalesce(whole(8), F.lit(0))
        # a clock of twelve hours has hours from 1 to 12
        hour = F.when(p[11] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(p[11]) == "p", 12).otherwise(0))
        second = F.coalesce(F.nullif(p[10], F.lit("")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
        clock = (F.coalesce(whole(0), whole(5)), month, day, hour, F.coalesce(whole(9), F.lit(0)), second)
        return F.when(p[12] == "", F.try_make_timestamp(*clock)).otherwise(F.try_make_timestamp(*clock, F.nullif(p[12], F.lit(""))))

    parts = F.split(F.regexp_replace(value, DATE_TEXT, DATE_PARTS), r"\|")
    return F.when((F.length(value) <= LONGEST_DATE) & value.rlike(DATE_TEXT), F.element_at(F.transform(F.array(parts), made), 1))


def moment(name: str, dtype: T.DataType, day_first: bool = False) -> Column:
    """The column as a timestamp without zone, invalid text as null."""
    if isinstance(dtype, T.StringType):
        return text_to_timestamp(col(name), day_first).cast("timestamp_ntz")
    if is_datetime(dtype):
        return col(name).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def label(name: str, dtype: T.DataType, null_label: str | None = None) -> Column:
    """The column as stripped text; missing values get ``null_label`` if given."""
    text = strip(present(name, dtype).cast("string"))
    return F.coalesce(text, F.lit(null_label)) if null_label is not None else text


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def canonical_key(name: str, dtype: T.DataType) -> Column:
    """Text under which equal key values of different types meet."""
    value = present(name, dtype)
    if isinstance(dtype, T.StringType):
        text = strip(value)
        usable = (text != "") & ~F.lower(text).isin(*GENERIC_VALUES)
        return F.when(usable, F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"))
    if is_fractional(dtype):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(9.0e18))
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(
            F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""
        )
    if is_nested(dtype):
        return F.lit(None).cast("string")
    return F.lower(value.cast("string")) if isinstance(dtype, T.BooleanType) else value.cast("string")


def script_of(c: Column) -> Column:
    cyrillic, latin = c.rlike("[А-Яа-яЁё]"), c.rlike("[A-Za-z]")
    return (
        F.when(cyrillic & latin, "mixed")
        .when(cyrillic, "cyrillic")
        .when(latin, "latin")
        .otherwise("other")
    )


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """Share in percent, 0 when there is nothing to divide by."""
    share = F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
    return F.round(share, digits) if digits is not None else share


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0.0)))


def strength_of(c: Column, strong: float, moderate: float, weak: float = 0.2) -> Column:
    size = F.abs(c)
    return (
        F.when(size >= strong, "strong")
        .when(size >= moderate, "moderate")
        .when(size >= weak, "weak")
        .otherwise("very weak")
    )
