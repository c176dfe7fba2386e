"""Semantic types of columns and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The semantic types; the numeric ones are stored as doubles, all others as text.
SEMANTIC_TYPES = ("PERSON", "ORG", "DATE", "GPE", "CODE", "MONEY", "QUANTITY", "QUANTITY_COUNT", "PRODUCT", "EVENT", "OTHER")
NUMERIC_TYPES = ("MONEY", "QUANTITY", "QUANTITY_COUNT")
#: Patterns of column names, tried in this order.
NAME_RULES = (
    ("DATE", r"date|(^|_)(year|month|day|dob|born|birthday|time)(_|$)"),
    ("CODE", r"code|(^|_)(id|zip|isbn|sku|ticker)(_|$)"),
    ("MONEY", r"price|cost|salary|revenue|gdp|acctbal|(^|_)(amount|value|budget|income|fee)(_|$)"),
    ("QUANTITY_COUNT", r"count|number|championship|medal|award|(^|_)(num|titles|wins|population|quantity)(_|$)"),
    ("QUANTITY", r"(^|_)(age|area|height|weight|size|pick|rate|ratio|percent|score|points)(_|$)"),
    ("GPE", r"city|country|state|nation|region|location|address|place|province"),
    ("ORG", r"hospital|company|team|college|university|school|club|organi[sz]ation|employer|ownership|supplier"),
    ("PERSON", r"name|owner|author|player|doctor|patient|person|director|manager"),
    ("PRODUCT", r"product|(^|_)(part|brand|item|drug|model)(_|$)"),
    ("EVENT", r"event|tournament|match|season|conference"),
)


def semantic_type(column: str, summed: bool = False) -> str:
    """Type by the column's name; an otherwise untyped column that is summed or averaged is a quantity."""
    for kind, pattern in NAME_RULES:
        if re.search(pattern, column.lower()):
            return kind
    return "QUANTITY" if summed else "OTHER"


def spark_type(semantic: str) -> T.DataType:
    return T.DoubleType() if semantic in NUMERIC_TYPES else T.StringType()


def field(column: str, semantic: str) -> T.StructField:
    return T.StructField(column, spark_type(semantic), True, {"semantic_type": semantic})
