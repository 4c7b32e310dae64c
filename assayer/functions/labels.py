"""Column expressions over label cells: atoms, canonical categories, placeholders, composite labels, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as "no value" in a cell, after trimming and lower-casing.
PLACEHOLDERS = ("optional", "none", "", "na")
# Curly quotes and what they are read as.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def atoms(c: Column | str) -> Column:
    """Values of a multi-value cell, split at semicolons and trimmed; a missing cell has none."""
    return F.coalesce(F.filter(F.transform(F.split(_col(c), ";"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def atoms_or_na(c: Column | str) -> Column:
    found = atoms(c)
    return F.when(F.size(found) == 0, F.array(F.lit("NA"))).otherwise(found)


def canonical(c: Column | str) -> Column:
    """Straight quotes, cut at the first parenthesis, trimmed."""
    plain = reduce(lambda x, q: F.replace(x, F.lit(q), F.lit(QUOTES[q])), QUOTES, F.trim(_col(c)))
    return F.trim(F.split_part(plain, F.lit("("), F.lit(1)))


def canonical_text(text: str) -> str:
    """canonical of a string of the driver."""
    plain = reduce(lambda x, q: x.replace(q, QUOTES[q]), QUOTES, text.strip(" "))
    return plain.split("(", 1)[0].strip(" ")


def placeholder(c: Column | str) -> Column:
    return _col(c).isNull() | F.lower(F.trim(_col(c))).isin(*PLACEHOLDERS)


def or_na(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def part(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), or_na(f"`{name}`"))


def composite(columns: list[str]) -> Column:
    return F.concat_ws("+", *map(part, columns))


def contains_rule(combo: Column, rule: Column) -> Column:
    """Whether the values of rule are among those of combo, as often as rule has them."""
    times = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    return F.forall(F.array_distinct(rule), lambda v: times(combo, v) >= times(rule, v))


def penalty(n: Column, k: Column) -> Column:
    return F.lit(1.0) - F.least(n, k).cast("double") / k.cast("double")


def significant(c: Column, digits: int = 2) -> Column:
    """Rounded to significant figures; 0 and non-finite values stay."""
    c = c.cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(c * scale) / scale)
