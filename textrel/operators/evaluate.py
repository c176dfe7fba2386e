"""Scoring of found tables against gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrel.functions.similarity import canonical_name, f1, relative_error
from textrel.operators.skew import numbered, salted_join


def paired_rows(gold: DataFrame, found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of equal key paired k-th with k-th in ``order``: keys, pair_no, and the other columns as gold_* and found_*.

    Each row is in one pair at most; a key with m and n rows gives min(m, n) pairs. Null keys pair with none.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return numbered(df, keys, [order], "pair_no").select(*keys, "pair_no", *[F.col(c).alias(f"{side}_{c}") for c in rest])

    return placed(gold, "gold").join(placed(found, "found"), [*keys, "pair_no"])


def number_score(gold: Column, found: Column, tolerance: float = 0.0) -> Column:
    """1 if two numbers differ by no more than ``tolerance``, else 0; both missing counts as equal."""
    both = gold.isNull() & found.isNull()
    return F.when(both | (F.abs(gold - found) <= tolerance), 1.0).otherwise(0.0)


def aggregate_score(gold: Column, found: Column) -> Column:
    """1 / (1 + relative error) of an aggregate."""
    return 1 / (1 + relative_error(gold, found))


def string_score(gold: Column, found: Column) -> Column:
    """1 if two texts are equal but for letter case and blanks around and between."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    both = gold.isNull() & found.isNull()
    return F.when(both | (plain(gold) == plain(found)), 1.0).otherwise(0.0)


def list_scores(gold: DataFrame, found: DataFrame, keys: list[str], value: str, both_empty: float = 0.0) -> DataFrame:
    """Precision and recall of list cells given as rows (keys, value): keys, precision, recall; repeated values count as often as
    both sides have them.

    Values are counted per (key, value) on each side first, so a key of many values is never gathered. A null value stands for
    the empty list of its key; a key whose lists are empty on both sides scores ``both_empty``. Keys of one side only score 0.
    """
    real = F.col(value).isNotNull().cast("int")
    sides = gold.select(*keys, value, real.alias("_a"), F.lit(0).alias("_b")).unionByName(found.select(*keys, value, F.lit(0).alias("_a"), real.alias("_b")))
    counts = sides.groupBy(*keys, value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = counts.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.least("_a", "_b")).alias("_s"))
    empty = (F.col("_a") == 0) & (F.col("_b") == 0)
    score = lambda n: F.when(empty, F.lit(both_empty)).when(n > 0, F.col("_s") / n).otherwise(0.0)
    return sums.select(*keys, score(F.col("_b")).alias("precision"), score(F.col("_a")).alias("recall"))


def column_metrics(pairs: DataFrame, scores: dict[str, Column], n_gold: int | Column, n_found: int | Column) -> DataFrame:
    """Per column: column_name, precision (score sum / found rows), recall (score sum / gold rows), f1."""
    sums = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in scores.items()]).unpivot([], list(scores), "column_name", "total")
    p = F.coalesce(F.try_divide(F.col("total"), n_found if isinstance(n_found, Column) else F.lit(float(n_found))), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("total"), n_gold if isinstance(n_gold, Column) else F.lit(float(n_gold))), F.lit(0.0))
    return sums.select("column_name", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def group_errors(gold: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Relative error per group of both sides: keys, gold_value, found_value, error; a group missing on a side counts 1."""
    g, f = gold.select(*keys, F.col(value).alias("gold_value")), found.select(*keys, F.col(value).alias("found_value"))
    return g.join(f, keys, "full").withColumn("error", relative_error(F.col("gold_value"), F.col("found_value")))


def mean_error(errors: DataFrame) -> DataFrame:
    return errors.agg(F.avg("error").alias("mean_error"), F.count("*").alias("n_groups"))


def name_matches(gold: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Found names matched to gold names in levels: 1 the same (trimmed), 2 equal as canonical names, 3 the same first and last word,
    4 the same last word and another shared word, 5 two shared words, 6 the same last word and a word that begins with the first.

    Each distinct found name takes its lowest level, and of several gold names the one that shares most words, then the
    alphabetically first: found, gold, level. Names that match none have no row. Levels 4 to 6 meet on pairs of words, or the
    last word with each beginning of a word, so no common word brings all its names together.
    """

    def described(df: DataFrame, side: str) -> DataFrame:
        d = df.select(F.trim(name).alias(side)).where(F.col(side) != "").distinct()
        c = canonical_name(F.col(side))
        d = d.withColumn("_c", c).withColumn("_l", F.split("_c", " "))
        return d.withColumn("_w", F.array_sort(F.array_distinct(F.filter("_l", lambda w: w != "")))).withColumn("_z", F.element_at("_l", -1))

    g, f = described(gold, "gold"), described(found, "found")
    end = lambda n: F.concat_ws(" ", F.lit(n), F.element_at("_l", 1), "_z")
    two = F.size("_w") >= 2
    pairs = F.flatten(F.transform("_w", lambda x: F.transform(F.filter("_w", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    none = F.array().cast("array<string>")
    last_pair = F.when(two, F.transform(F.filter(pairs, lambda p: (p.x == F.col("_z")) | (p.y == F.col("_z"))), lambda p: F.concat_ws(" ", F.lit("4"), "_z", p.x, p.y))).otherwise(none)
    any_pair = F.when(two, F.transform(pairs, lambda p: F.concat_ws(" ", F.lit("5"), p.x, p.y))).otherwise(none)

    def keys(df: DataFrame, side: str, last) -> DataFrame:
        base = F.array(F.concat(F.lit("1 "), F.col(side)), F.when(F.col("_c") != "", F.concat(F.lit("2 "), F.col("_c"))), F.when(two, end("3")))
        all_keys = F.filter(F.concat(base, last_pair, any_pair, last), lambda k: k.isNotNull())
        return df.select(side, "_w", F.explode(F.array_distinct(all_keys)).alias("key"))

    begins = F.flatten(F.transform("_w", lambda w: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(w))), lambda n: F.concat_ws(" ", F.lit("6"), "_z", F.substring(w, F.lit(1), n)))))
    first = F.when(two & (F.length(F.element_at("_l", 1)) >= 2), F.array(F.concat_ws(" ", F.lit("6"), "_z", F.element_at("_l", 1)))).otherwise(none)
    met = keys(f, "found", first).withColumnRenamed("_w", "_fw").join(keys(g, "gold", F.when(two, begins).otherwise(none)), "key")
    level = F.substring("key", 1, 1).cast("int")
    best = met.groupBy("found").agg(F.min(F.struct(level.alias("level"), (-F.size(F.array_intersect("_fw", "_w"))).alias("_s"), "gold")).alias("_b"))
    return best.select("found", F.col("_b.gold").alias("gold"), F.col("_b.level").alias("level"))


def rewritten_keys(gold: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The rows of ``found`` with the column ``name`` rewritten to the gold spelling that name_matches gives; others stay as they are."""
    best = name_matches(gold, found, name).where("level > 1").select(F.col("found").alias("_name"), F.col("gold").alias("_gold"))
    keyed = found.withColumn("_name", F.trim(name))
    return salted_join(keyed, best, ["_name"], found.columns, "left").withColumn(name, F.coalesce("_gold", name)).select(*found.columns)
