"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrel.session import checkpointed


def salted_join(many: DataFrame, unique: DataFrame, keys: list[str], salt_from: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join ``many`` to ``unique`` (one row per key) with each key spread over ``salts`` tasks.

    The rows of ``many`` get a salt from a hash of ``salt_from`` and the input partition (so that repeated rows spread
    too, and a lost task that is run again salts alike); each row of ``unique`` is repeated once per salt. The
    cost is ``salts`` times the (one row per key) side, the gain that a key with a third of all rows is no single task.
    Rows of ``many`` with a null key behave as in any equi-join. Result columns: those of ``many``, then the rest of
    ``unique``.
    """
    kinds = dict(many.dtypes)
    hashed = [c for c in salt_from if "map<" not in kinds[c]]
    left = many.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def range_bucketed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_bucket``: slices of the rows in order of ``keys`` and ``order``, of about equal numbers of rows.

    A key with many rows lies in several neighbouring slices, so work per (key, slice) is bounded by a slice. Slices come
    from sampled bounds and are written to the checkpoint folder, so that every reader sees the same ones.
    """
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """The rows with their place (from 1) among the rows of their key in ``order``: counted within slices, plus the rows of the
    key in the slices before. No key is sorted in one task. Ties take any order."""
    sliced = range_bucketed(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    sizes = sliced.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"z.{c}")) for c in (*keys, "_bucket")]
    test = same[0]
    for x in same[1:]:
        test = test & x
    joined = sliced.alias("s").join(sizes.alias("z"), test).select("s.*", "z._before")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.withColumn(number, (F.col("_before") + F.row_number().over(within)).cast("int")).drop("_before", "_bucket")
