"""Keyword functions on arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_terms(text: Column) -> Column:
    """Keywords of a comma-separated string; none for null or empty."""
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, ","))


def normalise(term: Column) -> Column:
    return F.replace(term, F.lit(" "), F.lit("-"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct keywords; two empty sets are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)
