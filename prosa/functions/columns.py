"""Small column builders shared by the operators. Everything stays inside codegen."""

from __future__ import annotations

from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosa.functions.words import TRIMMED


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def below(value: Column | str, bands: Sequence[tuple[float, Any]], last: Any, null: Any) -> Column:
    """The value of the first band whose upper bound lies above ``value``."""
    value = col(value)
    picked = F.when(value.isNull(), F.lit(null))
    for bound, result in bands:
        picked = picked.when(value < bound, F.lit(result))
    return picked.otherwise(F.lit(last))


def at_least(value: Column | str, bands: Sequence[tuple[float, Any]], last: Any) -> Column:
    """The value of the first band whose lower bound ``value`` reaches."""
    value = col(value)
    (bound, result), *rest = bands
    picked = F.when(value >= bound, F.lit(result))
    for bound, result in rest:
        picked = picked.when(value >= bound, F.lit(result))
    return picked.otherwise(F.lit(last))


def lookup(value: Column | str, table: Mapping[str, Any], default: Any) -> Column:
    """Literal lookup: no join, no shuffle."""
    value = col(value)
    (key, result), *rest = table.items()
    picked = F.when(value == key, F.lit(result))
    for key, result in rest:
        picked = picked.when(value == key, F.lit(result))
    return picked.otherwise(F.lit(default))


def group_of(value: Column | str, groups: Mapping[str, Iterable[str]], default: str) -> Column:
    """Name of the first group that lists ``value``."""
    value = col(value)
    (name, members), *rest = groups.items()
    picked = F.when(value.isin(*members), F.lit(name))
    for name, members in rest:
        picked = picked.when(value.isin(*members), F.lit(name))
    return picked.otherwise(F.lit(default))


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value. Null stays null, unlike plain greatest/least."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def points(condition: Column, worth: float) -> Column:
    return F.when(condition, F.lit(worth)).otherwise(F.lit(0.0))


def round_to(value: Column, places: int) -> Column:
    """Scale, round half away from zero, scale back, all in double."""
    scale = float(10 ** places)
    return F.round(value * F.lit(scale)) / F.lit(scale)


def mean_to(value: Column | str, places: int) -> Column:
    """Rounded mean, as an aggregate. A sum of doubles depends on the order of its rows in the last
    digits; rounding to six places first makes a tie a tie in every order."""
    return round_to(round_to(F.avg(col(value)), 6), places)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double, 0 where there is nothing to divide by."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column | str, whole: Column | str, places: int = 2) -> Column:
    part, whole = col(part), col(whole)
    return F.when(whole > 0, round_to(part / whole * 100, places)).otherwise(F.lit(0.0))


def share_of(condition: Column, places: int = 2) -> Column:
    """Percent of rows that fulfil a condition, as an aggregate; null without rows."""
    return round_to(F.try_divide(F.count_if(condition), F.count(F.lit(1))) * 100, places)


def hash16(value: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(col(value), 256), 1, 16)


def first_match(value: Column | str, pattern: str, where: Column | None = None) -> Column:
    """First match or null. Rows outside ``where`` skip the regular expression."""
    found = F.nullif(F.regexp_extract(col(value), pattern, 0), F.lit(""))
    return found if where is None else F.when(where, found)


def all_matches(value: Column | str, pattern: str) -> Column:
    """Distinct matches in sorted order; an empty array when there are none."""
    found = F.regexp_extract_all(col(value), F.lit(pattern), F.lit(0))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def replace_all(value: Column, pattern: str, tag: str, where: Column) -> Column:
    return F.when(where, F.regexp_replace(value, pattern, tag)).otherwise(value)


def strip(value: Column | str) -> Column:
    """Cut white space of any kind from both ends."""
    return F.regexp_replace(col(value), rf"^{TRIMMED}+|{TRIMMED}+\z", "")


def title_label(value: Column | str) -> Column:
    return F.initcap(F.replace(col(value), F.lit("_"), F.lit(" ")))


def earliest(value: Column | str, order: Column, where: Column | None = None) -> Column:
    """Value of the first row by ``order`` among those fulfilling ``where``. Rows whose order is
    null are skipped, so the condition goes there and no filter or join is needed."""
    return F.min_by(col(value), order if where is None else F.when(where, order))
