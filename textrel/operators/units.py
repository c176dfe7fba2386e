"""Quantities recorded in different units: the unit of every cell, from what it says and from what others say of the same entity.

1. Cells are parsed: number, unit in the text, unit in a remark, unit its source declares (the stated unit is the first
   of these that is there).
2. Rows of one entity are linked by its key. In logarithms of the common unit a wrong unit is an additive constant.
3. For each field, each pair of nodes (a source's cells that name their unit, or its bare cells) gets the median
   difference over the entities both report on; it is snapped to the nearest difference of known conversions.
4. The snapped differences are propagated through the graph of nodes, by support, from the nodes that name their unit;
   this corrects sources whose declared unit is wrong throughout.
5. The entity's consensus is the median of its corrected cells (of those that name a unit, if any). A cell that is far
   from it gets the unit that brings it nearest.

The nodes are two per source of the fixed table of sources plus two for all others, so the pairs of one entity and the
graph on the driver are bounded; medians are sketches, so an entity with a third of all rows is one small buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrel.functions.text import is_missing, match_key
from textrel.operators.skew import salted_join

#: Common unit, and for each unit its factor to the common unit.
COMMON = {"area": "km2", "population": "persons", "gdp": "usd_m"}
FACTORS = {
    "area": {"km2": 1.0, "mi2": 2.589988110336, "ha": 0.01, "acre": 0.0040468564224},
    "population": {"persons": 1.0, "thousand": 1e3, "million": 1e6},
    "gdp": {"usd_m": 1.0, "usd": 1e-6, "usd_k": 1e-3, "usd_bn": 1e3},
}
#: How units are written behind or before a number (which stands as 9 here), tried in this order.
IN_TEXT = {
    "area": [("mi2", r"(?i)sq\.? ?mi|mi²|mi9|miles"), ("ha", r"(?i)hectare|\bha\b|9ha\b"), ("acre", r"(?i)\bac\b|9ac\b|acre"), ("km2", r"(?i)km|kilomet")],
    "population": [("million", r"(?i)9 ?m\b|\bmn\b|\bmio\b|million"), ("thousand", r"(?i)9 ?k\b|\btsd\b|thsd|thousand"), ("persons", r"(?i)pop\.|inhabitant|people|persons|heads")],
    "gdp": [("usd_bn", r"(?i)billion|9 ?bn\b|\bbn\b|\bbln\b"), ("usd_m", r"(?i)million|9 ?m\b|\bmn\b|\bmio\b|9m\b"), ("usd_k", r"(?i)thsd|thousand|9 ?k\b|\btsd\b"), ("usd", r"(?i)dollar|usd|\$")],
}
IN_REMARK = {
    "area": [("km2", r"(?i)square kilomet|km"), ("mi2", r"(?i)square mile|sq\.? ?mi"), ("ha", r"(?i)hectare"), ("acre", r"(?i)acre")],
    "population": [("million", r"(?i)million"), ("thousand", r"(?i)thousand"), ("persons", r"(?i)heads|persons|people|inhabitant")],
    "gdp": [("usd_bn", r"(?i)billion"), ("usd_m", r"(?i)million"), ("usd_k", r"(?i)thousand"), ("usd", r"(?i)dollar|usd")],
}
#: A cell within this distance (decimal logarithm) of the consensus keeps its stated unit; the closest units differ by 0.39.
TOLERANCE = 0.15


def parse_number(text: Column, mark: Column) -> Column:
    """The number in a text with thousands marks, as a double.

    With both marks the later one is the decimal mark; one that repeats separates thousands; a single one is decimal if
    it is the source's decimal mark ``mark`` or is not followed by exactly three digits.
    """
    t = F.regexp_extract(text, r"\d(?:[\d.,]*\d)?", 0)
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."))), F.length(t) - F.length(F.replace(t, F.lit(",")))
    last = F.regexp_extract(t, r"([.,])\d+$", 1)
    single_thousands = t.rlike(r"^\d{1,3}[.,]\d{3}$") & (last != F.coalesce(mark, F.lit(".")))
    decimal = F.when((dots > 0) & (commas > 0), last).when(dots + commas != 1, F.lit("")).when(single_thousands, F.lit("")).otherwise(last)
    plain = (
        F.when(decimal == ".", F.replace(t, F.lit(",")))
        .when(decimal == ",", F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit(".")))
        .otherwise(F.regexp_replace(t, "[.,]", ""))
    )
    return plain.try_cast("double")


def _first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(unit)).otherwise(out)
    return out


def _per_field(fields: list[str], make) -> Column:
    out = F.lit(None)
    for f in fields:
        out = F.when(F.col("field_name") == f, make(f)).otherwise(out)
    return out


def quantity_cells(rows: DataFrame, sources: DataFrame, entity: str = "city_name") -> DataFrame:
    """Long form of the non-missing cells: rec_id, entity_key, field_name, src, raw, number, named_unit, stated_unit."""
    fields = list(COMMON)
    declared = F.broadcast(sources.select("src", "decimal_mark", F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"{f}_unit"))]).alias("units")))
    cells = (
        rows.select(F.col("id").alias("rec_id"), match_key(F.col(entity)).alias("entity_key"), "src", "remark", *fields)
        .unpivot(["rec_id", "entity_key", "src", "remark"], fields, "field_name", "raw")
        .where(~is_missing(F.col("raw")))
        .join(declared, "src", "left")
    )
    body = F.regexp_replace("raw", r"\d(?:[\d.,]*\d)?", "9")
    about = F.filter(F.split(F.coalesce("remark", F.lit("")), ";"), lambda s: F.lower(s).contains(F.col("field_name")))
    remark = F.array_join(about, ";")
    return cells.select(
        "rec_id",
        "entity_key",
        "field_name",
        "src",
        "raw",
        parse_number(F.col("raw"), F.col("decimal_mark")).alias("number"),
        F.coalesce(_per_field(fields, lambda f: _first_match(body, IN_TEXT[f])), _per_field(fields, lambda f: _first_match(remark, IN_REMARK[f]))).alias("named_unit"),
        F.coalesce(F.element_at("units", F.col("field_name")), _per_field(fields, lambda f: F.lit(COMMON[f]))).alias("declared_unit"),
    ).withColumn("stated_unit", F.coalesce("named_unit", "declared_unit"))


def _log_common(unit: Column) -> Column:
    factors = F.create_map(*[x for f in FACTORS.values() for u, k in f.items() for x in (F.lit(u), F.lit(k))])
    return F.log10(F.when(F.col("number") > 0, F.col("number")) * F.element_at(factors, unit))


def snapped(field: str, difference: float) -> float:
    """The difference of two known conversions (in decimal logarithms) nearest to ``difference``."""
    from math import log10

    logs = [log10(k) for k in FACTORS[field].values()]
    return min({a - b for a in logs for b in logs}, key=lambda x: (abs(x - difference), abs(x)))


def propagate(edges: list[tuple[str, str, str, float, int]]) -> dict[tuple[str, str], float]:
    """Correction of each (field, node) from edges (field, a, b, median of log a - log b, support).

    Nodes that name their unit (``n:...``) are right; others are reached over the edges with most support first. A node
    that none of them reaches keeps 0.
    """
    fixed: dict[tuple[str, str], float] = {}
    for f, a, b, _, _ in edges:
        for x in (a, b):
            if x.startswith("n:"):
                fixed[f, x] = 0.0
    ordered = sorted(edges, key=lambda e: (-e[4], e[:3]))
    grew = True
    while grew:
        grew = False
        for f, a, b, d, _ in ordered:
            step = snapped(f, d)
            if ((f, a) in fixed) != ((f, b) in fixed):
                if (f, a) in fixed:
                    fixed[f, b] = fixed[f, a] - step
                else:
                    fixed[f, a] = fixed[f, b] + step
                grew = True
                break
    return fixed


def unify_quantities(rows: DataFrame, sources: DataFrame, entity: str = "city_name", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per non-missing cell: rec_id, field_name, raw, number, stated_unit, unit_code, value_common.

    ``rows`` has id, ``entity``, src, remark and the fields of COMMON as text; ``sources`` is the small fixed table of
    declared units. A cell without a readable positive number keeps its stated unit (value_common null or 0). An entity
    with a single cell keeps the stated unit. Where just two cells without named units disagree, the one nearer to the
    field's overall median is believed. Rows without an entity key are entities of their own. Repeated rows stay.
    """
    cells = quantity_cells(rows, sources, entity).withColumn("value", _log_common(F.col("stated_unit")))
    known = F.broadcast(sources.select("src", F.lit(True).alias("is_known")))
    node = F.concat(F.when(F.col("named_unit").isNotNull(), "n:").otherwise("b:"), F.when(F.col("is_known"), F.col("src")).otherwise("other"))
    cells = cells.join(known, "src", "left").withColumn("node", node).drop("is_known")
    linked = cells.where(F.col("value").isNotNull() & F.col("entity_key").isNotNull() & (F.col("entity_key") != ""))

    per_node = linked.groupBy("field_name", "entity_key", "node").agg(F.percentile_approx("value", 0.5, 1000).alias("v"))
    nodes = per_node.groupBy("field_name", "entity_key").agg(F.sort_array(F.collect_list(F.struct("node", "v"))).alias("nodes")).where(F.size("nodes") > 1)
    pair = F.flatten(
        F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), (x["v"] - y["v"]).alias("d"))))
    )
    edges = nodes.select("field_name", F.inline(pair)).groupBy("field_name", "a", "b").agg(F.percentile_approx("d", 0.5, 1000).alias("d"), F.count("*").alias("n"))
    corrections = {k: v for k, v in propagate([tuple(r) for r in edges.collect()]).items() if abs(v) > 1e-9}
    correction = F.lit(0.0)
    for (f, n), v in sorted(corrections.items()):
        correction = F.when((F.col("field_name") == f) & (F.col("node") == n), F.lit(v)).otherwise(correction)
    cells, linked = cells.withColumn("right", F.col("value") - correction), linked.withColumn("right", F.col("value") - correction)

    overall = F.broadcast(linked.groupBy("field_name").agg(F.percentile_approx("right", 0.5, 1000).alias("overall")))
    named = F.col("named_unit").isNotNull()
    groups = linked.groupBy("entity_key", "field_name").agg(
        F.percentile_approx(F.when(named, F.col("right")), 0.5, 1000).alias("named_mid"),
        F.percentile_approx("right", 0.5, 1000).alias("mid"),
        F.min("right").alias("low"),
        F.max("right").alias("high"),
        F.count("*").alias("n"),
    )
    nearer = F.when(F.abs(F.col("low") - F.col("overall")) <= F.abs(F.col("high") - F.col("overall")), F.col("low")).otherwise(F.col("high"))
    consensus = groups.join(overall, "field_name").select(
        "entity_key",
        "field_name",
        F.coalesce("named_mid", F.when((F.col("n") == 2) & (F.col("high") - F.col("low") > tolerance), nearer).otherwise(F.col("mid"))).alias("consensus"),
    )
    judged = salted_join(cells, consensus, ["entity_key", "field_name"], ["rec_id", "raw"], "left")
    distances = _per_field(
        list(COMMON),
        lambda f: F.array_min(F.array(*[F.struct(F.abs(_log_common(F.lit(u)) - F.col("consensus")).alias("off"), F.lit(u).alias("unit")) for u in FACTORS[f]])),
    )
    judged = judged.withColumn("best", distances)
    keep = F.col("consensus").isNull() | F.col("value").isNull() | (F.abs(F.col("value") - F.col("consensus")) <= tolerance) | (F.col("best.off") > tolerance)
    unit = F.when(keep, F.col("stated_unit")).otherwise(F.col("best.unit"))
    factors = F.create_map(*[x for f in FACTORS.values() for u, k in f.items() for x in (F.lit(u), F.lit(k))])
    return judged.select(
        "rec_id",
        "field_name",
        "raw",
        "number",
        "stated_unit",
        unit.alias("unit_code"),
        (F.col("number") * F.element_at(factors, unit)).alias("value_common"),
    )
