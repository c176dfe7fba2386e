"""String and vector similarity, and functions on names and values."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of matching blocks, between 0 and 1; null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def plain_letters(s: pd.Series) -> pd.Series:
    """Text without diacritics (compatibility decomposition, combining marks dropped)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def canonical_name(c: Column) -> Column:
    """A name for matching: no diacritics, quotes, generation suffix or punctuation; lower case; blanks collapsed."""
    plain = F.regexp_replace(F.lower(plain_letters(c)), "[\"'`’‘“”]", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(words, r" (jr|sr|ii|iii|iv)$", ""))


def relative_error(gold: Column, found: Column) -> Column:
    """|found - gold| / |gold|; the absolute error where gold is 0; 1 where one of them is missing."""
    error = F.when(gold == 0, F.abs(found)).otherwise(F.try_divide(F.abs(found - gold), F.abs(gold)))
    return F.when(gold.isNull() | found.isNull(), F.lit(1.0)).otherwise(error)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def finite_number(c: Column) -> Column:
    """A finite double from text with thousands commas, else null."""
    n = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def surface_forms(c: Column) -> Column:
    """Ways a number is written in text: as it is, with thousands commas, with one to three decimals. Empty for other text."""
    n = finite_number(c)
    return F.when(n.isNotNull(), F.array_distinct(F.array(F.trim(c), F.format_number(n, 0), F.format_string("%.1f", n), F.format_string("%.2f", n), F.format_string("%.3f", n)))).otherwise(F.array().cast("array<string>"))
