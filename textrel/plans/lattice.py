"""A workload as one picture: the tables, columns, predicates and joins that its statements need."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textrel.plans.profile import Predicate, profile
from textrel.plans.types import field as typed_field
from textrel.plans.types import semantic_type

log = logging.getLogger(__name__)


@dataclass
class Column:
    table: str
    name: str
    semantic: str = "OTHER"
    predicates: set[Predicate] = field(default_factory=set)
    is_join_key: bool = False
    is_grouped: bool = False
    aggregates: set[str] = field(default_factory=set)


@dataclass
class Lattice:
    """columns by (table, name), join pairs (each once, in either direction), statements that could not be parsed."""

    columns: dict[tuple[str, str], Column] = field(default_factory=dict)
    tables: set[str] = field(default_factory=set)
    joins: list[tuple[tuple[str, str], tuple[str, str]]] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)

    def schema(self, table: str) -> T.StructType:
        return T.StructType([typed_field(c.name, c.semantic) for (t, _), c in sorted(self.columns.items()) if t == table])

    def hints(self, table: str) -> dict[str, list[str]]:
        """Literals of equality predicates by column; extracted values are normalised towards them."""
        out: dict[str, list[str]] = {}
        for (t, n), c in sorted(self.columns.items()):
            values = sorted({p.value for p in c.predicates if p.op == "=" and p.value is not None})
            if t == table and values:
                out[n] = values
        return out

    def subsumption(self) -> list[tuple[tuple[Predicate, ...], list[tuple[str, str]]]]:
        """Columns with identical predicates (on columns of any name): they are needed for the same rows."""
        groups: dict[tuple, list[tuple[str, str]]] = {}
        for key, c in sorted(self.columns.items()):
            shape = tuple(sorted((p.op, p.value or "") for p in c.predicates))
            if shape:
                groups.setdefault((key[0], shape), []).append(key)
        return [(k[1], v) for k, v in groups.items() if len(v) > 1]

    def join_pairs(self) -> list[tuple[tuple[str, str], tuple[str, str]]]:
        return list(self.joins)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, n, c.semantic, c.is_join_key, c.is_grouped, sorted(c.aggregates), sorted(f"{p.op} {p.value}" if p.value is not None else p.op for p in c.predicates)) for (t, n), c in sorted(self.columns.items())
        ]
        return spark.createDataFrame(rows, "table_name string, column_name string, semantic_type string, is_join_key boolean, is_grouped boolean, aggregates array<string>, predicates array<string>")


def build(spark: SparkSession, statements: list[str]) -> Lattice:
    """The lattice of a workload. Statements that cannot be parsed are logged, kept in ``failed`` and skipped."""
    out = Lattice()

    def column(t: str, n: str) -> Column:
        return out.columns.setdefault((t, n), Column(t, n))

    for sql in statements:
        try:
            p = profile(spark, sql)
        except PySparkException as e:
            log.warning("statement skipped: %s", str(e).splitlines()[0])
            out.failed.append(sql)
            continue
        out.tables |= set(p.tables)
        for t, names in p.columns.items():
            for n in names:
                if t:
                    column(t, n)
        for x in p.predicates:
            if x.table:
                column(x.table, x.column).predicates.add(x)
        for j in p.joins:
            for t, n in (j.left, j.right):
                if t:
                    column(t, n).is_join_key = True
            if j.left[0] and j.right[0] and (j.left, j.right) not in out.joins and (j.right, j.left) not in out.joins:
                out.joins.append((j.left, j.right))
        for t, n in p.group_by:
            if t:
                column(t, n).is_grouped = True
        for f, t, n in p.aggregates:
            if t:
                column(t, n).aggregates.add(f)
    for c in out.columns.values():
        c.semantic = semantic_type(c.name, bool(c.aggregates & {"sum", "avg", "mean"}))
    return out


def name_variations(column: str) -> list[str]:
    """Ways a column's name may stand in text: with blanks, in camel case, in the plural and the singular."""
    words = column.lower().split("_")
    spaced = " ".join(words)
    out = {column, spaced, "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:])}
    for v in (column, spaced):
        out |= {v[:-1] if v.endswith("s") else v + "s"}
    return sorted(out)
