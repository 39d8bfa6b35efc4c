"""Column functions for cleaning codes, names, numbers, times and flags; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode characters that are written for the full stop between the numbers of a district's name.
NUMBER_DOTS = {
    0x00B7: "middle dot",
    0x2027: "hyphenation point",
    0x2219: "bullet operator",
    0x22C5: "dot operator",
    0x30FB: "katakana middle dot",
    0x318D: "hangul letter araea, typed as a dot",
    0xFF65: "halfwidth katakana middle dot",
}


def to_number(c: Column) -> Column:
    """Number from text with thousands commas; blanks, "nan" and "-" are null."""
    plain = F.trim(F.regexp_replace(c, ",", ""))
    return F.when(F.lower(plain).isin("", "nan", "-"), F.lit(None)).otherwise(plain).try_cast("double")


def strict_number(c: Column) -> Column:
    """As ``to_number``, but text that is no number fails the job."""
    parsed = to_number(c)
    plain = F.lower(F.trim(F.regexp_replace(c, ",", "")))
    return F.when(c.isNotNull() & ~plain.isin("", "nan", "-") & parsed.isNull(), F.raise_error(F.concat(F.lit("not a number: "), c))).otherwise(parsed)


def code8(c: Column, width: int = 10) -> Column:
    """First 8 digits of a district code that may have gone through a float ("1111065000.0")."""
    return F.substring(F.lpad(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), width, "0"), 1, 8)


def code10(c: Column) -> Column:
    """10-digit code: 8 digits get "00" appended, 10 digits that start with "00" lose them first; others are null."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"\D", "")
    return F.when(F.length(s) == 8, F.concat(s, F.lit("00"))).when((F.length(s) == 10) & s.startswith("00"), F.concat(F.substring(s, 3, 8), F.lit("00"))).when(F.length(s) == 10, s)


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def repair_name(c: Column) -> Column:
    """Last token of a place name, with broken dots between digits mended."""
    dots = "".join(rf"\x{{{code:04X}}}" for code in NUMBER_DOTS)
    return F.regexp_replace(last_token(c), rf"(?<=\d)[?{dots}](?=\d)", ".")


def drop_ordinal(c: Column) -> Column:
    """Without the ordinal prefix before a digit."""
    return F.regexp_replace(c, "제([0-9])", "$1")


def add_ordinal(c: Column) -> Column:
    """With the ordinal prefix before the first number."""
    return F.regexp_replace(c, r"^(\D*?)(?<!제)(\d)", "$1제$2")


def split_address(c: Column) -> list[Column]:
    """City, district and the rest of an address."""
    parts = F.split(F.trim(c), r"\s+")
    return [F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).alias("gu"), F.array_join(F.slice(parts, 3, 1000), " ").alias("rest")]


def code_in_parentheses(c: Column) -> Column:
    return F.regexp_extract(c, r"\((\d{10})\)", 1)


def without_code(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\(\d{10}\)", ""))


def lot_number(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n.cast("string"))


def category(c: Column, words: dict[str, str], default: str = "other") -> Column:
    """The value of the first key that ``c`` contains."""
    out = F.when(F.lit(False), F.lit(""))
    for word, value in words.items():
        out = out.when(c.contains(word), F.lit(value))
    return out.otherwise(F.lit(default))


def by_pattern(c: Column, patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first pattern that matches."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, value in patterns:
        out = out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(default))


def minutes(c: Column) -> Column:
    """Minute of the day of an "HH:MM" text; null if malformed."""
    h, m = F.regexp_extract(c, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int"), F.regexp_extract(c, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((h < 24) & (m < 60), h * 60 + m)


def in_morning(start: Column, end: Column, low: int = 420, high: int = 580) -> Column:
    """Start or end between ``low`` and ``high`` minutes, both included."""
    return F.coalesce(start.between(low, high), F.lit(False)) | F.coalesce(end.between(low, high), F.lit(False))


def time_code(c: Column) -> Column:
    """"07:00" from 700; null where hour or minute is out of range."""
    h, m = F.floor(c / 100), c % 100
    return F.when(h.between(0, 23) & m.between(0, 59), F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")))


def to_flag(c: Column, fallback: Column) -> Column:
    """Boolean from mixed text, else ``fallback``."""
    t = F.lower(F.trim(c))
    return F.coalesce(F.when(t.isin("true", "1", "y", "yes", "예"), F.lit(True)).when(t.isin("false", "0", "n", "no", "아니오"), F.lit(False)), fallback)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; null where d is 0 or the result is infinite."""
    q = F.when(d != 0, n / d)
    return F.when(F.abs(q) < float("inf"), q)


def sql_round(c: Column, digits: int) -> Column:
    """SQL's round of a double: the scaled value is rounded, halves away from zero.

    ``F.round`` takes the digits of the double as it is printed, so a half that is stored a little low (14.281049999999999
    for 14.28105) goes down there and up in SQL.
    """
    return F.round(c * 10.0**digits) / 10.0**digits


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` in [low, high]; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def least_or_null(a: Column, b: Column) -> Column:
    """The smaller, or null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
