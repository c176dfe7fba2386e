"""Synthesized tables: inserts, entity upserts, consolidation, lineage and the registry of what is materialized.

Tables are immutable DataFrames; each function returns the next version of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrel.functions.text import folded
from textrel.operators.skew import salted_join

SYSTEM_COLUMNS = ("row_id", "created_at")


def row_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def create_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty synthesized table with the system columns in front and behind."""
    fields = [T.StructField("row_id", T.StringType()), *schema.fields, T.StructField("created_at", T.TimestampType())]
    return spark.createDataFrame([], T.StructType(fields))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def evolve(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with missing columns added as nulls of the given types."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def records_to_rows(records: DataFrame, column: str, schema: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Maps of text as typed columns: keys that the schema does not know are dropped, numbers lose commas and percent signs,
    text that is no number becomes null. ``keep`` names columns of ``records`` to carry along."""

    def cell(name: str, kind: str) -> Column:
        v = F.try_element_at(column, F.lit(name))
        if kind in ("double", "bigint", "int"):
            return F.regexp_replace(F.trim(v), "[,%]", "").try_cast("double").try_cast(kind).alias(name)
        return v.cast(kind).alias(name)

    return records.select(*keep, *[cell(n, k) for n, k in schema.items()])


def upsert_by_entity(table: DataFrame, arriving: DataFrame, entity: str, known_only: bool = False, order: str | None = None) -> DataFrame:
    """Upsert by entity: of a known entity only nulls are filled, new ones are inserted (or left out, with ``known_only``).

    The key is the trimmed, lower-cased ``entity``; arriving rows of one entity are merged first, first value in ``order``
    (default: the order of the values themselves) wins. Rows of the table without a key stay as they are; arriving ones
    without a key are dropped.
    """
    key = folded(F.trim(F.col(entity)))
    values = [c for c in table.columns if c != entity and c in arriving.columns]
    merged = first_values(arriving.where(key.isNotNull() & (key != "")).withColumn("_key", key), ["_key"], [entity, *values], order)
    merged = merged.select("_key", *[F.col(c).alias(f"_new_{c}") for c in (entity, *values)])
    old = table.withColumn("_key", key)
    filled = old.join(merged, "_key", "left").select(*[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in values else F.col(c) for c in table.columns])
    if known_only:
        return filled
    fresh = merged.join(old.where(F.col("_key").isNotNull()).select("_key").distinct(), "_key", "left_anti")
    inserted = fresh.select(*[F.col(f"_new_{c}").alias(c) if c in (entity, *values) else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return filled.unionByName(inserted)


def first_values(df: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """Per key the first non-null value of each column in ``order``; without one, the smallest value."""
    if order is None:
        return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns])
    return df.groupBy(*keys).agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c) for c in columns])


def consolidate(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row per identity; each attribute takes its most frequent non-null value, ties going to the value seen first in
    ``order``, then to the smaller. Zeros count like other values. Result: key, columns as text, n_rows.

    Values are counted per key before anything is grouped by the key alone, so a key with many rows is a few counts.
    """
    long = df.select(key, order, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key, order], columns, "_column", "_value").where(F.col("_value").isNotNull())
    votes = long.groupBy(key, "_column", "_value").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = votes.groupBy(key, "_column").agg(F.min_by("_value", F.struct(-F.col("_n"), "_first", "_value")).alias("_value"))
    wide = best.groupBy(key).agg(*[F.max(F.when(F.col("_column") == c, F.col("_value"))).alias(c) for c in columns])
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).join(wide, key, "left").select(key, *columns, "n_rows")


def merged_sources(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Distinct non-blank ids of all id lists per key, sorted: key, ids. Ids are made distinct before they are gathered."""
    each = df.select(key, F.explode(ids).alias("_id")).where(F.trim("_id") != "").distinct()
    return each.groupBy(key).agg(F.sort_array(F.collect_list("_id")).alias(ids))


def cell_provenance(rows: DataFrame, row: str, columns: list[str], source: list[str], order: str) -> DataFrame:
    """One source per filled cell: row, column_name and the ``source`` columns of the first row in ``order`` that filled it."""
    long = rows.select(row, order, *source, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([row, order, *source], columns, "column_name", "_value").where(F.col("_value").isNotNull())
    first = long.groupBy(row, "column_name").agg(F.min_by(F.struct(*source), F.struct(F.col(order), *[F.col(s) for s in source])).alias("_s"))
    return first.select(row, "column_name", "_s.*")


def replace_rows(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Point updates: rows of ``changed`` take the place of rows with their key; keys that are not there are ignored."""
    known = changed.join(table.select(key).distinct(), key, "left_semi")
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(known.select(*table.columns))


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def lineage(provenance: DataFrame, chunks: DataFrame, table_name: str | None = None) -> DataFrame:
    """The chunks behind each row, of one table or all: row_id, table_name, chunk_id, doc_id. Unknown chunks have a null doc_id."""
    rows = provenance if table_name is None else provenance.where(F.col("table_name") == table_name)
    pairs = rows.select("row_id", "table_name", F.explode("chunk_ids").alias("chunk_id")).where(F.trim("chunk_id") != "").distinct()
    return pairs.join(chunks.select("chunk_id", "doc_id").distinct(), "chunk_id", "left").select("row_id", "table_name", "chunk_id", "doc_id")


def apply_registry(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry rows merged by (table_name, column_name): predicate scopes are made distinct, then united, FULL is never lowered to PARTIAL, the latest
    time and its record count stay. Both have table_name, column_name, predicate_scope, status, last_updated, record_count."""
    both = registry.unionByName(changes)
    column = ["table_name", "column_name"]
    scopes = both.select(*column, F.explode("predicate_scope").alias("_p")).distinct().groupBy(*column).agg(F.array_sort(F.collect_list("_p")).alias("predicate_scope"))
    merged = both.groupBy(*column).agg(
        F.when(F.max((F.col("status") == "FULL").cast("int")) == 1, "FULL").otherwise("PARTIAL").alias("status"),
        F.max("last_updated").alias("last_updated"),
        F.max_by("record_count", F.struct("last_updated", "record_count")).alias("record_count"),
    )
    empty = F.array().cast("array<string>")
    return merged.join(scopes, column, "left").select(*column, F.coalesce("predicate_scope", empty).alias("predicate_scope"), "status", "last_updated", "record_count")


def new_candidates(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving (table_name, chunk_id, relevance_score) not stored yet, the highest score of each."""
    best = arriving.groupBy("table_name", "chunk_id").agg(F.max("relevance_score").alias("relevance_score"))
    return best.join(existing.select("table_name", "chunk_id").distinct(), ["table_name", "chunk_id"], "left_anti")


def ordered_candidates(candidates: DataFrame, table_name: str) -> DataFrame:
    """The candidates of a table, the most relevant first, ties by chunk id."""
    return candidates.where(F.col("table_name") == table_name).select("chunk_id", "relevance_score").orderBy(F.desc_nulls_last("relevance_score"), "chunk_id")


def not_cached(chunks: DataFrame, cache: DataFrame, table_name: str) -> DataFrame:
    """The chunks whose extraction for a table is not in the cache yet, by md5 of chunk and table: adds cache_key."""
    keyed = chunks.withColumn("cache_key", F.md5(F.concat_ws(":", F.col("chunk_id").cast("string"), F.lit(table_name))))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def call_counters(calls: DataFrame, operation: str, tokens: Column) -> DataFrame:
    """Calls and tokens per operation: operation, calls, tokens."""
    return calls.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def frequent_fields(records: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The fields that most map records hold with a value: field_name, n_records, the ``most`` most frequent, ties by name."""
    each = records.select(F.explode(column).alias("field_name", "_v")).where(F.trim("_v") != "")
    return each.groupBy("field_name").agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), "field_name").limit(most)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def snapshot_state(registry: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """One row: whether all columns are FULL, candidates, indexed chunks, indexed chunks that are candidates, and whether the
    snapshot may be queried."""
    full = registry.agg(F.min((F.col("status") == "FULL").cast("int")).alias("all_full"))
    c = candidates.agg(F.count_distinct("chunk_id").alias("n_candidates"))
    i = index.agg(F.count_distinct("chunk_id").alias("n_indexed"))
    shared = index.select("chunk_id").distinct().join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("n_shared"))
    one = full.select("all_full", c.select("n_candidates").scalar().alias("n_candidates"), i.select("n_indexed").scalar().alias("n_indexed"), shared.select("n_shared").scalar().alias("n_shared"))
    return one.withColumn("ready", (F.col("all_full") == 1) & (F.col("n_candidates") > 0) & (F.col("n_shared") > 0))


def upsert_salted(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Column values of ``updates`` (one row per key) laid over the rows of ``table`` where these are null, hot keys spread."""
    values = [c for c in updates.columns if c != key]
    joined = salted_join(table, updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in values]), [key], table.columns, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_u_{c}")).alias(c) if c in values else F.col(c) for c in table.columns])
