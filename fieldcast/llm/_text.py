"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Inside a higher-order function a column is computed anew for every element;
    bound as the element of a one-element array it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and blank give none."""
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0,
                  F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def has_word(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(BLANK))) > 0


def hashes(items: Column) -> Column:
    """64-bit hash of each string."""
    return F.transform(items, lambda w: F.xxhash64(w))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
