"""Text clean-up, and numbers from text by the rules of data frames in memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(?:inity)?\s*$"


def strip(c: Column) -> Column:
    """Remove all white space at both ends; ``F.trim`` removes only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(SPACE.replace("[", "[^", 1))


def to_number(c: Column) -> Column:
    """Text to DOUBLE or null: decimal and exponent forms and infinities count, the rest is null.

    Patterns come first: the JVM also reads 5d and 0x1p3, and a cast that fails is slow.
    """
    infinity = F.when(c.contains("-"), float("-inf")).otherwise(float("inf"))
    return F.when(c.rlike(_DECIMAL), c.try_cast("double")).when(c.rlike(_INFINITE), infinity)


def number_or_zero(c: Column) -> Column:
    """Text to DOUBLE where whatever is not a number becomes 0; infinities stay."""
    return F.coalesce(to_number(c), F.lit(0.0))


def snake(c: Column) -> Column:
    """Strip, lower-case and replace blanks by underscores."""
    return F.regexp_replace(F.lower(strip(c)), " ", "_")
