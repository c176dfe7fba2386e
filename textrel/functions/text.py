"""Column functions on text: missing markers, blank handling, match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers that stand for a missing cell, in lower case and trimmed.
MISSING_MARKERS = ("", "n/a", "none", "null", "unknown")


def squeezed(c: Column) -> Column:
    """Outer blanks removed, inner runs of white space replaced by one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_missing(c: Column) -> Column:
    """True for null, blank and the markers of MISSING_MARKERS in any letter case."""
    return c.isNull() | F.lower(squeezed(c)).isin(*MISSING_MARKERS)


def missing_to_null(c: Column) -> Column:
    """The cell as it is, or null where it counts as missing."""
    return F.when(~is_missing(c), c)


def folded(c: Column) -> Column:
    """Lower case with the dotted capital I as a plain i, which engines lower differently."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def match_key(c: Column) -> Column:
    """Key under which names are equal: trimmed, blanks collapsed, lower case."""
    return F.lower(squeezed(c))


def normalized(c: Column) -> Column:
    """Lower case, everything but letters, digits, underscore and blanks turned into blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalized_for_match(c: Column) -> Column:
    """Lower case, commas dropped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), ",", ""), r"\s+", " "))


def number_or_null(c: Column) -> Column:
    """A double from text such as ``1,200`` or ``45%``; null where it is none."""
    return F.regexp_replace(F.trim(c), "[,%]", "").try_cast("double")


def canonical_attribute(c: Column) -> Column:
    """snake_case form of an attribute name; camelCase is split before lower-casing."""
    split = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(split), r"[\s\-]+", "_"), r"_+", "_"), r"^_+|_+$", "")


def multi_values(c: Column, separator: str = r"\|\|") -> Column:
    """The non-empty trimmed parts of a multi-value cell; null stays null."""
    return F.filter(F.transform(F.split(c, separator), lambda x: squeezed(x)), lambda x: x != "")


def token_estimate(c: Column) -> Column:
    """Rough token count: a quarter of the characters, at least 1, 0 for empty or null text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(4)))).cast("bigint")
