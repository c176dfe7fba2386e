"""Named queries of the core operators: ``QUERIES[name](spark, folder)``; ``ORACLES[name]`` is the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrel.operators.orphans import Parent, orphan_references, orphan_report, references
from textrel.operators.packed import split_packed
from textrel.operators.units import COMMON, unify_quantities
from textrel.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _nationalities(spark: SparkSession, folder: str) -> DataFrame:
    demonyms = [r[0] for r in table(spark, folder, "demonyms").collect()]  # a fixed table of 51 rows
    rows = table(spark, folder, "player").select(F.lit("player").alias("table_name"), F.lit("nationality").alias("field_name"), F.col("id").alias("rec_id"), F.col("nationality").alias("cell"))
    return split_packed(rows, "cell", small_lexicon=demonyms, dashes=True)


def _owners(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    rows = table(spark, folder, "team").select(F.lit("team").alias("table_name"), F.lit("ownership").alias("field_name"), F.col("id").alias("rec_id"), F.col("ownership").alias("cell"), *extra)
    return split_packed(rows, "cell", lexicon=table(spark, folder, "owner").select("name"))


@query()
def p2_found(spark, folder):
    values = _nationalities(spark, folder).unionByName(_owners(spark, folder)).where("n_values > 1")
    return values.select("table_name", "field_name", "rec_id", "value_pos", "item_value").distinct()


@query()
def p2_values(spark, folder):
    """All values, single ones too, with the error flag of the parser."""
    values = _nationalities(spark, folder).unionByName(_owners(spark, folder))
    return values.select("table_name", "field_name", "rec_id", "value_pos", "item_value", "flag")


@query()
def p3_found(spark, folder):
    cells = unify_quantities(table(spark, folder, "city"), table(spark, folder, "source_units"))
    return cells.where(~F.col("unit_code").isin(*COMMON.values())).select("rec_id", "field_name", "unit_code")


@query()
def p3_unified(spark, folder):
    return unify_quantities(table(spark, folder, "city"), table(spark, folder, "source_units"))


def _references(spark: SparkSession, folder: str) -> DataFrame:
    owned = _owners(spark, folder, "ingested_at")
    return (
        references(table(spark, folder, "player"), "player", "team", "team")
        .unionByName(references(table(spark, folder, "owner"), "owner", "nba_team", "team"))
        .unionByName(references(table(spark, folder, "team"), "team", "location", "city"))
        .unionByName(references(owned, "team", "ownership", "owner", rec_id="rec_id", value="item_value"))
    )


def _parents(spark: SparkSession, folder: str) -> list[Parent]:
    return [Parent("team", table(spark, folder, "team"), "team_name"), Parent("city", table(spark, folder, "city"), "city_name"), Parent("owner", table(spark, folder, "owner"), "name")]


@query()
def p7_found(spark, folder):
    return orphan_references(_references(spark, folder), _parents(spark, folder)).select("table_name", "field_name", "rec_id", "ref_value", "orphan_kind")


_NAME = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_MISSING = "({0} IS NULL OR lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) IN ('', 'n/a', 'none', 'null', 'unknown'))"


def _plain_refs_sql() -> str:
    child = "SELECT DISTINCT '{p}' AS parent, '{t}' AS table_name, '{f}' AS field_name, id AS rec_id, trim(regexp_replace({f}, '\\s+', ' ', 'g')) AS ref_value, ingested_at AS asked FROM {t} WHERE NOT {m}"
    kids = " UNION ALL ".join(child.format(p=p, t=t, f=f, m=_MISSING.format(f)) for p, t, f in (("team", "player", "team"), ("team", "owner", "nba_team"), ("city", "team", "location")))
    folk = " UNION ALL ".join(f"SELECT '{t}' AS parent, {_NAME.format(c)} AS k, ingested_at AS since, deleted_at AS until FROM {t} WHERE NOT {_MISSING.format(c)}" for t, c in (("team", "team_name"), ("city", "city_name")))
    return f"""WITH kids AS ({kids}), folk AS ({folk}),
j AS (SELECT kids.parent, table_name, field_name, rec_id, ref_value, asked, count(since) AS n,
  coalesce(bool_or(since <= asked AND (until IS NULL OR until > asked)), false) AS lives, coalesce(bool_or(since > asked), false) AS late
  FROM kids LEFT JOIN folk ON folk.parent = kids.parent AND folk.k = lower(ref_value) GROUP BY ALL)
SELECT table_name, field_name, strftime(asked, '%Y-%m') AS period, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS orphan_kind,
  count(*) AS n_orphans, count(DISTINCT ref_value) AS n_values FROM j WHERE NOT lives GROUP BY 1, 2, 3, 4"""


@query(_plain_refs_sql())
def p7_report_plain(spark, folder):
    """Orphans per table, field, kind and month, of the fields that hold one reference per cell."""
    refs = (
        references(table(spark, folder, "player"), "player", "team", "team")
        .unionByName(references(table(spark, folder, "owner"), "owner", "nba_team", "team"))
        .unionByName(references(table(spark, folder, "team"), "team", "location", "city"))
    )
    return orphan_report(orphan_references(refs, _parents(spark, folder)[:2]))


@query()
def p7_report(spark, folder):
    """Orphans of all references per table, field, kind and month."""
    return orphan_report(orphan_references(_references(spark, folder), _parents(spark, folder)))
