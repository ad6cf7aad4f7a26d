"""Scalar expressions that plans and queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: str | Column) -> Column:
    """A cell's number; 0 for what is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def single(value: str | Column) -> Column:
    """Through single precision, as branch lengths are kept."""
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("float").cast("double")


def low_bits(value: str | Column, bits: int) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return c if bits >= 64 else c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def hamming(a: str, b: str) -> Column:
    """The share of positions in which two arrays of one length differ."""
    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return unequal / F.size(a).cast("double")


def jaccard_to_weighted(mismatch: Column) -> Column:
    """From the mismatch share d of weighted sketches to the normalised distance d / (2 - d)."""
    return F.when(mismatch >= 2, F.lit(1.0)).otherwise(mismatch / (2 - mismatch))
