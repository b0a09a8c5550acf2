"""Scalar functions. Missing is always NULL here; Spark's NaN is turned into NULL on the way in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings a CSV reader of the usual dataframe libraries takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Plain decimal or scientific notation only: Java would also read '1d', '1f' and '0x1p3'.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"

HASH_DIGITS = 15  # hex digits of md5 kept, so the hash is uniform on [0, 2**60)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: str | Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """NULL for every missing-value spelling (N12)."""
    c = _col(c)
    return F.when(~c.isin(list(tokens)), c)


def nan_to_null(c: str | Column) -> Column:
    """NULL instead of NaN: NaN compares as larger than any number in Spark."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def number(c: str | Column) -> Column:
    """The value as a double, with NaN as missing."""
    return nan_to_null(_col(c).cast("double"))


def text_to_double(c: str | Column) -> Column:
    """CLN01 on a string: a number, or NULL for anything that is not one."""
    text = F.trim(_col(c))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def text_to_integer(c: str | Column, kind: str = "bigint") -> Column:
    """A whole number, exact over the whole range of ``kind``; NULL for anything else.

    Plain digits never pass through a double. Other spellings of a whole number ("5.0", "1e3") count
    while a double holds them exactly; a fraction is not a whole number and gives NULL.
    """
    text = F.trim(_col(c))
    value = text_to_double(text)
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(float(1 << 53)))
    plain = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind))
    return F.coalesce(plain, F.when(~text.rlike(r"^[+-]?\d+$") & whole, value.cast("bigint").try_cast(kind)))


def sum0(c: str | Column) -> Column:
    """Sum in which an all-missing group is 0 (N1)."""
    return F.coalesce(F.sum(_col(c).cast("double")), F.lit(0.0))


def safe_divide(n: str | Column, d: str | Column) -> Column:
    """SCA01: a zero or missing denominator gives NULL."""
    return _col(n).cast("double") / F.nullif(_col(d).cast("double"), F.lit(0.0))


def pct(n: str | Column, d: str | Column) -> Column:
    """SCA02: rate as a percentage."""
    return safe_divide(n, d) * F.lit(100.0)


def flag_ge(c: str | Column, threshold: float) -> Column:
    """SCA03: 1 where the value reaches the threshold, else 0; missing counts as 0 (N6)."""
    return F.coalesce((_col(c) >= F.lit(threshold)).cast("int"), F.lit(0))


def route_key(origin: str | Column, dest: str | Column, sep: str = "-") -> Column:
    """SCA04: missing on either side makes the key missing (N8)."""
    return F.concat(_col(origin), F.lit(sep), _col(dest))


def day_name(ts: str | Column) -> Column:
    """SCA06: full English day name."""
    return F.date_format(_col(ts), "EEEE")


def iso_week(ts: str | Column) -> Column:
    """SCA07: ISO week number, 1 to 53."""
    return F.weekofyear(_col(ts))


def iso_year(ts: str | Column) -> Column:
    """The year an ISO week belongs to: that of its Thursday."""
    return F.year(F.date_add(F.trunc(_col(ts), "week"), 3))


def hhmm_hour(c: str | Column) -> Column:
    """SCA08: hour of an HHMM clock value; 2400 gives 24."""
    return F.floor(_col(c).cast("int") / F.lit(100)).cast("int")


def report_round(c: str | Column, digits: int) -> Column:
    """SCA09: half-even rounding, as Python's ``round`` does it."""
    return F.bround(_col(c), digits)


def sign_class(c: str | Column) -> Column:
    """SCA10: "up" for a change of zero or more, "down" below; a missing change counts as zero."""
    return F.when(F.coalesce(_col(c), F.lit(0.0)) >= 0, F.lit("up")).otherwise(F.lit("down"))


def label(prefix: str, c: str | Column) -> Column:
    """SCA12: display label such as "Month 1"."""
    return F.concat(F.lit(f"{prefix} "), _col(c).cast("int").cast("string"))


def zfill(c: str | Column, width: int) -> Column:
    """CLN04: left-pad the integer form with zeros; longer values stay whole.

    ``lpad`` is not used because it cuts longer values. 5.0 gives "0005" and missing stays missing.
    """
    text = F.trim(_col(c).cast("string"))
    number = text_to_double(text)
    whole = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(text)
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(whole), F.lit(0))), whole)


def key_hash(keys: Iterable[str], seed: int) -> Column:
    """A seeded, partition-independent hash of the key columns, uniform on [0, 2**60).

    Each part is preceded by its length, so different keys, missing ones included, have different texts.
    """
    texts = [F.col(k).cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")
