"""Text functions as Columns; none runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_SHAPE = r"^[+-]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)$"
DATA_SHAPE = r"^(?:[+-]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)%?|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})$"
# Accepted date formats.
DATE_FORMATS = (
    "d-M-yyyy",
    "d-M-yy",
    "d/M/yyyy",
    "d/M/yy",
    "d.M.yyyy",
    "d.M.yy",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy.M.d",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d MMM yyyy",
    "d MMM yy",
    "d-MMMM-yyyy",
    "d-MMMM-yy",
    "d MMMM yyyy",
    "d MMMM yy",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def named(name: str) -> Column:
    """A column by its exact name, whatever punctuation it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(c: Column) -> Column:
    """Null or nothing but (Unicode) white space."""
    text = c.cast("string")
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_script(c: Column, keep_layout: bool = False) -> Column:
    """Without Devanagari, joiners and the brackets and leading periods that it leaves behind."""
    c = F.regexp_replace(c, r"[ऀ-ॿ᳐-᳿꣠-ꣿ\x{11B00}-\x{11B5F}]+", "")
    c = F.regexp_replace(c, r"[‌‍]", "")
    c = F.regexp_replace(c, r"\(\s*\)|\[\s*\]|\{\s*\}", "")
    c = F.regexp_replace(c, r"^\s*(?:\.\s*){2,}", "")
    return F.trim(c) if keep_layout else collapse(c)


def clean_cell(c: Column, remove_script: bool = False) -> Column:
    """A generic cell: optionally without Devanagari letters and empty round brackets, white space collapsed."""
    if remove_script:
        c = F.regexp_replace(F.regexp_replace(c, r"[ऀ-ॿ]+", ""), r"\(\s*\)", " ")
    return collapse(c)


def repair_wrapped_name(c: Column) -> Column:
    """Lines joined by spaces; a last line of one letter is glued to a line that ends in a letter."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), collapse), lambda x: x != "")
    n = F.size(lines)
    glue = (n >= 2) & F.element_at(lines, -1).rlike(r"^\p{L}$") & F.element_at(lines, -2).rlike(r"\p{L}$")
    head = F.array_join(F.slice(lines, 1, F.greatest(n - 1, F.lit(0))), " ")
    return F.when(c.isNull(), None).when(glue, F.concat(head, F.element_at(lines, -1))).otherwise(F.array_join(lines, " "))


def parsed_date(c: Column) -> Column:
    """The date of a text in one of DATE_FORMATS, null else. The text's shape tells its parts, which are parsed once."""
    text = F.lower(collapse(c))
    month = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    shapes = (  # place of year, month and day in the pattern
        (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$", 4, 3, 1),
        (r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$", 1, 3, 4),
        (rf"^([0-9]{{1,2}})([- ])({month})\2([0-9]{{4}}|[0-9]{{2}})$", 4, 3, 1),
    )
    year, middle, day = F.lit(""), F.lit(""), F.lit("")
    for shape, *places in shapes:
        y, m, d = (F.regexp_extract(text, shape, p) for p in places)
        hit = text.rlike(shape)
        year, middle, day = (F.when(hit, new).otherwise(old) for new, old in ((y, year), (m, middle), (d, day)))
    # years of two digits lie between 1969 and 2068
    year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", F.lit("20")).otherwise(F.lit("19")), year)).otherwise(year)
    names = F.array(*(F.lit(m[:3]) for m in MONTHS))
    middle = F.when(middle.rlike("^[a-z]"), F.array_position(names, F.substring(middle, 1, 3)).cast("string")).otherwise(middle)
    return F.try_to_timestamp(F.when(year != "", F.concat_ws("-", year, middle, day)), F.lit("yyyy-M-d")).cast("date")


def is_date_like(c: Column) -> Column:
    """A date in one of the formats, by shape and in the calendar."""
    return F.coalesce(parsed_date(c.cast("string")).isNotNull(), F.lit(False))


def is_number_like(c: Column) -> Column:
    return F.coalesce(collapse(c.cast("string")).rlike(NUMBER_SHAPE), F.lit(False))


def is_data_like(c: Column) -> Column:
    return F.coalesce(collapse(c.cast("string")).rlike(DATA_SHAPE), F.lit(False))


def to_number(c: Column, kind: str = "double") -> Column:
    """Strict: digits only in the accepted forms, null otherwise; overflow to infinity is null too."""
    value = F.when(c.rlike(NUMBER), F.trim(c)).try_cast(kind)
    return F.when(F.abs(value) < F.lit(float("inf")), value) if kind == "double" else value


def lenient_number(c: Column) -> Column:
    """Commas dropped; a cell that ends in % counts in hundredths."""
    text = F.regexp_replace(collapse(c), ",", "")
    percent = text.endswith("%")
    value = to_number(F.when(percent, F.regexp_replace(text, r"\s*%$", "")).otherwise(text))
    return F.when(percent, value / 100).otherwise(value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
