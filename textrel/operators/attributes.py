"""The attribute index: which chunks mention which attribute."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrel.functions.text import canonical_attribute

#: Share of the key occurrences a key needs to stay in a schema, share of the indexed chunks beyond which an attribute selects
#: nothing, least ratio of a fuzzy match, and how many such matches are used.
SCHEMA_SHARE, OVERBROAD_SHARE, FUZZY_RATIO, FUZZY_MATCHES = 0.2, 0.3, 0.6, 3
#: Chunks of the report index_chunks; deltas read all.
REPORTED_CHUNKS = 50


def key_frequencies(records: DataFrame, column: str, share: float = SCHEMA_SHARE) -> DataFrame:
    """Keys of map records: key, n, share of all key occurrences, and whether the key stays in the schema."""
    keys = records.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    total = keys.agg(F.sum("n").alias("t"))
    return keys.withColumn("share", F.col("n") / total.scalar()).withColumn("frozen", F.col("share") >= share)


def build_index(discoveries: DataFrame) -> DataFrame:
    """Inverted index from (table_name, chunk_id, raw_attr): table_name, attribute, variants, n_chunks, and a row per chunk in entries().

    Discoveries are made distinct before they are grouped.
    """
    d = discoveries.select("table_name", canonical_attribute(F.col("raw_attr")).alias("attribute"), "raw_attr", "chunk_id").where("attribute <> ''").distinct()
    variants = d.select("table_name", "attribute", "raw_attr").distinct().groupBy("table_name", "attribute").agg(F.sort_array(F.collect_list("raw_attr")).alias("variants"))
    chunks = d.select("table_name", "attribute", "chunk_id").distinct().groupBy("table_name", "attribute").agg(F.count("*").alias("n_chunks"))
    return variants.join(chunks, ["table_name", "attribute"])


def entries(discoveries: DataFrame) -> DataFrame:
    """The index as rows: table_name, attribute, chunk_id."""
    return discoveries.select("table_name", canonical_attribute(F.col("raw_attr")).alias("attribute"), "chunk_id").where("attribute <> ''").distinct()


def coverage(index: DataFrame) -> DataFrame:
    """Chunks per attribute."""
    return index.groupBy("table_name", "attribute").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def selective_attributes(index: DataFrame, share: float = OVERBROAD_SHARE) -> DataFrame:
    """Coverage without attributes that more than ``share`` of a table's indexed chunks mention: these select nothing."""
    per_table = index.groupBy("table_name").agg(F.count_distinct("chunk_id").alias("n_indexed"))
    return coverage(index).join(F.broadcast(per_table), "table_name").where(F.col("n_chunks") <= share * F.col("n_indexed"))  # a row per table


def fuzzy_attributes(wanted: str, known: list[str], ratio: float = FUZZY_RATIO, most: int = FUZZY_MATCHES) -> list[str]:
    """The attribute itself if it is known, else up to ``most`` known ones by matching-block ratio, best first, ties by name."""
    if wanted in known:
        return [wanted]
    scored = sorted(((-SequenceMatcher(None, wanted, k).ratio(), k) for k in known))
    return [k for s, k in scored if -s >= ratio][:most]


def chunks_for(index: DataFrame, table_name: str, attributes: list[str], limit: int) -> DataFrame:
    """The chunks that mention one of the attributes, the first ``limit`` by id."""
    hit = index.where((F.col("table_name") == table_name) & F.col("attribute").isin(attributes))
    return hit.select("chunk_id").distinct().orderBy("chunk_id").limit(limit)


def indexed_candidates(index: DataFrame, candidates: DataFrame, table_name: str) -> DataFrame:
    """The indexed chunks of a table that are candidates of it too."""
    c = candidates.where(F.col("table_name") == table_name).select("chunk_id").distinct()
    return index.where(F.col("table_name") == table_name).select("chunk_id").distinct().join(c, "chunk_id", "left_semi")


class StaleIndexError(RuntimeError):
    """The index and the candidates of a table share no chunk."""


def require_fresh(index: DataFrame, candidates: DataFrame, table_name: str) -> DataFrame:
    """indexed_candidates; an index of a table that knows none of its candidates raises StaleIndexError."""
    shared = indexed_candidates(index, candidates, table_name)
    if not index.where(F.col("table_name") == table_name).limit(1).isEmpty() and shared.limit(1).isEmpty():
        raise StaleIndexError(table_name)
    return shared


def candidate_chunks(index: DataFrame, candidates: DataFrame, table_name: str, attributes: list[str]) -> DataFrame:
    """All chunks that mention one of the attributes and are candidates of the table: chunk_id. A stale index raises StaleIndexError."""
    fresh = require_fresh(index, candidates, table_name)
    hit = index.where((F.col("table_name") == table_name) & F.col("attribute").isin(attributes)).select("chunk_id").distinct()
    return hit.join(fresh, "chunk_id", "left_semi")
