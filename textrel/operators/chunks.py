"""Chunking and filtering of documents."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default chunk size and overlap in characters, and separators from coarse to fine.
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
WINDOW_WORDS = 500


def stride_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-length pieces ``size - overlap`` apart: key, chunk_index, content. Null and empty texts have none."""
    step = size - overlap
    if step < 1:
        raise ValueError("the overlap must be smaller than the size")
    rows = df.where(F.length(text) > 0)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    return rows.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))).alias("chunk_index", "content"))


def word_windows(df: DataFrame, key: str, text: str, words: int = WINDOW_WORDS) -> DataFrame:
    """Consecutive windows of ``words`` blank-separated words: key, chunk_index, content, n_words."""
    parts = df.select(key, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(words))
    return parts.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("_w", i + 1, words))).alias("chunk_index", "_c")).select(key, "chunk_index", F.array_join("_c", " ").alias("content"), F.size("_c").alias("n_words"))


def _tail(previous: str, overlap: int) -> str:
    return previous[-overlap:] if overlap else ""


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of a text, cut at the coarsest separator that makes them small enough; each starts with the end of the one before.

    Parts are gathered up to ``size`` characters (separators not counted), a part that is too long is cut by the finer
    separators, and text without any is cut at fixed strides. The overlap is added at each level, so a piece may exceed
    ``size`` by the overlaps of the levels it went through.
    """
    if not text.strip():
        return []
    if len(text) <= size:
        return [text.strip()]
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    first, finer = separators[0], separators[1:]
    parts = text.split(first) if first else list(text)
    pieces: list[str] = []
    gathered: list[str] = []
    length = 0

    def close() -> None:
        nonlocal gathered, length
        whole = "".join(gathered).strip()
        if whole:
            pieces.append(whole)
        gathered, length = [], 0

    for part in parts:
        if length + len(part) <= size:
            gathered.append(part + first)
            length += len(part) + len(first)
            continue
        close()
        if len(part) > size:
            pieces.extend(split_recursive(part, size, overlap, finer))
        else:
            gathered, length = [part + first], len(part) + len(first)
    close()
    return [p if i == 0 else _tail(pieces[i - 1], overlap) + p for i, p in enumerate(pieces)]


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """split_recursive on a column: key, chunk_index, content. Blank and null texts have no chunks. Texts that fit stay in the JVM."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_recursive(t, size, overlap))

    rows = df.where(F.col(text).rlike(r"\S"))
    short = rows.where(F.length(text) <= size).select(key, F.array(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("_c"))
    long = rows.where(F.length(text) > size).select(key, cut(F.col(text)).alias("_c"))
    return short.unionByName(long).select(key, F.posexplode("_c").alias("chunk_index", "content"))


def chunk_id(doc: Column, index: Column) -> Column:
    """A deterministic id of a chunk."""
    return F.sha2(F.concat_ws("|", doc.cast("string"), index.cast("string")), 256)


#: Chunk numbers that are looked at together for the chunk before each of them.
LEAD_SPAN = 1024


def with_lead(chunks: DataFrame, doc: str, index: str, content: str, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Each chunk with the last ``overlap`` characters of the chunk before in its document (whatever gap lies between): adds lead.

    A document is taken in spans of LEAD_SPAN chunk numbers; the last tail of each span is handed to the next one that has
    chunks. Only tails are sorted, and a document with a third of all chunks is many spans. The first chunk has an empty lead.
    """
    span = F.floor(F.col(index) / F.lit(LEAD_SPAN))
    rows = chunks.withColumn("_span", span).withColumn("_tail", F.right(F.coalesce(content, F.lit("")), F.lit(overlap)))
    last = rows.groupBy(doc, "_span").agg(F.max_by("_tail", index).alias("_last"))
    handed = last.select(doc, "_span", F.lag("_last").over(Window.partitionBy(doc).orderBy("_span")).alias("_handed"))
    within = F.lag("_tail").over(Window.partitionBy(doc, "_span").orderBy(index))
    return rows.join(handed, [doc, "_span"], "left").withColumn("lead", F.coalesce(within, "_handed", F.lit(""))).select(*chunks.columns, "lead")


def new_chunks(existing: DataFrame, arriving: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """The arriving chunks whose key is not stored yet, one per key: the idempotent part of an append.

    Of arriving rows that share a key, the one with the smallest content is kept.
    """
    once = arriving.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in arriving.columns if c not in keys]), "content").alias("_r"))
    return once.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*keys, "_r.*")


def chunks_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks whose chunk_id is in ``ids``."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def any_literal(content: Column, literals: Iterable[str]) -> Column:
    """True where a literal is a substring in any letter case; without literals everything passes."""
    out = None
    for v in literals:
        hit = F.contains(F.lower(content), F.lit(v.lower()))
        out = hit if out is None else out | hit
    return F.lit(True) if out is None else out


#: General patterns of relevant text.
PATTERNS = {"date": r"(?:^|[^0-9])\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[^0-9]|$)", "money": r"[$€£]\s?\d[\d,.]*", "percent": r"\d+(?:\.\d+)?\s?%", "year": r"(?:^|[^0-9A-Za-z_])(?:19|20)\d{2}(?:[^0-9A-Za-z_]|$)", "code": r"\b[A-Z]{2,6}-?\d{2,}\b"}


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern for whole keywords in any letter case, for both the scan and other engines."""
    import re

    return r"(?i)\b(" + "|".join(re.escape(k).replace(r"\ ", " ").replace(r"\-", "-") for k in sorted(set(keywords), key=lambda k: (-len(k), k))) + r")\b"


def sieve(df: DataFrame, content: str, keywords: Iterable[str], patterns: Iterable[str] = ()) -> DataFrame:
    """The rows that hold a keyword or match a pattern; a declarative relevance filter. Null texts are dropped."""
    hit = F.col(content).rlike(keyword_pattern(keywords))
    for p in patterns:
        hit = hit | F.col(content).rlike(p)
    return df.where(hit)


def matches_predicate(value: Column, op: str, literal: str | float) -> Column:
    """A predicate on a text cell of an extracted record: numbers are compared as numbers where both sides are, text equality ignores letter
    case, a missing cell fails, and a range on text that is no number passes."""
    number = F.regexp_replace(value, ",", "").try_cast("double")
    try:
        wanted = F.lit(float(literal))
    except (TypeError, ValueError):
        wanted = F.lit(None).cast("double")
    both = number.isNotNull() & wanted.isNotNull()
    same = F.when(both, number == wanted).otherwise(F.lower(value) == F.lit(str(literal).lower()))
    if op in ("=", "!="):
        test = same if op == "=" else ~same
    else:
        compare = {"<": number < wanted, "<=": number <= wanted, ">": number > wanted, ">=": number >= wanted}[op]
        test = F.coalesce(F.when(both, compare), F.lit(True))
    return value.isNotNull() & test


def keyword_counts(df: DataFrame, content: str, least_length: int = 4, limit: int = 60, share: float = 0.1) -> DataFrame:
    """The terms in most rows: term, n_rows; at least max(2, share of the rows), the ``limit`` most frequent, ties by term."""
    terms = df.select(F.explode(F.array_distinct(F.split(F.lower(content), r"[^\p{L}\p{N}_]+"))).alias("term")).where(F.length("term") >= least_length)
    total = df.agg(F.count("*").alias("_total"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n_rows"))
    return counted.where(F.col("n_rows") >= F.greatest(F.lit(2), total.select(F.ceil(F.col("_total") * share)).scalar())).orderBy(F.desc("n_rows"), "term").limit(limit)
