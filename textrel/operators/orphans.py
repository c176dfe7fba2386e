"""References to records that do not exist, or did not exist when the referring row was loaded.

Parent and child keys are united in long form and grouped by parent table and key; groups without a parent are
``missing``. For the rest the number of living parents at each distinct time of the key decides: a parent adds one at
its first time and takes one away at its last, and a running sum per key gives the number alive at a child's time.
Both sides are aggregated to one row per (parent table, key, time) first. The running sum is taken in slices of the rows
in order of key and time (skew.range_bucketed): within a slice, plus what the key's slices before it add up to. A key with
a third of all references, each at its own time, is many slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrel.functions.text import is_missing, match_key, squeezed
from textrel.operators.skew import range_bucketed, salted_join
from textrel.session import checkpointed

REFERENCE_COLUMNS = ["parent_table", "table_name", "field_name", "rec_id", "ref_value", "at"]


@dataclass(frozen=True)
class Parent:
    """A referred table: its name, rows, key column, and the times a row lives from and until (until may be null)."""

    name: str
    rows: DataFrame
    key: str
    since: str = "ingested_at"
    until: str = "deleted_at"


def references(df: DataFrame, table_name: str, field: str, parent_table: str, rec_id: str = "id", at: str = "ingested_at", value: str | None = None) -> DataFrame:
    """The non-missing references of a column in long form. Rows without an id or a time are kept with nulls."""
    c = F.col(value or field)
    return df.where(~is_missing(c)).select(
        F.lit(parent_table).alias("parent_table"),
        F.lit(table_name).alias("table_name"),
        F.lit(field).alias("field_name"),
        F.col(rec_id).cast("bigint").alias("rec_id"),
        squeezed(c).alias("ref_value"),
        F.col(at).alias("at"),
    )


def orphan_references(refs: DataFrame, parents: list[Parent]) -> DataFrame:
    """One row per reference without a living parent: the columns of ``refs`` plus orphan_kind.

    ``refs`` has REFERENCE_COLUMNS. A parent lives at t if since <= t and (until is null or until > t); keys match by
    match_key. orphan_kind is ``missing`` if no parent has the key at all, else ``late`` if one has since > t, else
    ``deleted``. Rows that repeat (table, field, id, value) count once, at their earliest time. A reference with a null
    time is ``missing`` or ``deleted``, since nothing lives at an unknown time. Parents with a null since never live.
    Empty tables give an empty result or ``missing`` for all. References and slices are written to the checkpoint folder.
    """
    named = refs.withColumn("_key", match_key(F.col("ref_value")))
    once = checkpointed(named.groupBy("parent_table", "table_name", "field_name", "rec_id", "ref_value", "_key").agg(F.min("at").alias("at")))
    probes = once.groupBy("parent_table", "_key", "at").agg(F.lit(0).cast("bigint").alias("delta")).select("parent_table", "_key", "at", "delta", F.lit(False).alias("is_parent"), F.lit(True).alias("is_child"))
    events = None
    for p in parents:
        rows = p.rows.where(~is_missing(F.col(p.key))).select(F.lit(p.name).alias("parent_table"), match_key(F.col(p.key)).alias("_key"), F.col(p.since).alias("since"), F.col(p.until).alias("until"))
        lives = F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since")))
        moves = rows.select(
            "parent_table",
            "_key",
            F.inline(F.array(F.struct(F.col("since").alias("at"), lives.cast("bigint").alias("delta"), F.lit(True).alias("starts")), F.struct(F.col("until").alias("at"), (-lives.cast("bigint")).alias("delta"), F.lit(False).alias("starts")))),
        ).where(F.col("starts") | (F.col("at").isNotNull() & (F.col("delta") != 0)))
        events = moves if events is None else events.unionByName(moves)
    events = events.groupBy("parent_table", "_key", "at").agg(F.sum("delta").alias("delta"), F.max("starts").alias("is_parent")).withColumn("is_child", F.lit(False))
    key = ["parent_table", "_key"]
    tagged = range_bucketed(probes.unionByName(events), key, ["at"])
    sums = tagged.groupBy(*key, "_bucket").agg(F.sum(F.when(F.col("at").isNotNull(), F.col("delta"))).alias("_net"), F.max("is_parent").alias("_parent"), F.max(F.when(F.col("is_parent"), F.col("at"))).alias("_since"), F.max("is_child").alias("_asked"))
    whole = Window.partitionBy(*key)  # a row per slice
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, "_bucket", "_asked", F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_base"), F.max("_parent").over(whole).alias("any_parent"), F.max("_since").over(whole).alias("last_since")).where("_asked").drop("_asked")
    until_now = Window.partitionBy(*key, "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alive = F.col("_base") + F.coalesce(F.sum(F.when(F.col("at").isNotNull(), F.col("delta"))).over(until_now), F.lit(0))
    judged = (
        tagged.join(bases, [*key, "_bucket"])
        .withColumn("alive", F.when(F.col("at").isNotNull(), alive).otherwise(F.lit(0)))
        .where(F.col("is_child") & (F.col("alive") <= 0))
        .select(
            *key,
            F.struct(F.col("at")).alias("_at"),
            F.when(~F.col("any_parent"), "missing").when(F.col("last_since") > F.col("at"), "late").otherwise("deleted").alias("orphan_kind"),
        )
    )
    found = salted_join(once.withColumn("_at", F.struct(F.col("at"))), judged, ["parent_table", "_key", "_at"], ["table_name", "field_name", "rec_id"])
    return found.select(*REFERENCE_COLUMNS, "orphan_kind")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphans per table, field, kind and month of the referring row's time (``YYYY-MM``, null if unknown)."""
    return found.groupBy("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("period"), "orphan_kind").agg(F.count("*").alias("n_orphans"), F.countDistinct("ref_value").alias("n_values"))
