"""Comparison of Spark results with DuckDB, and tables with awkward rows."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, dict):
        return str(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    return str(v)


def rows_of(table: pa.Table) -> list:
    names = sorted(table.column_names)
    return sorted(str([_plain(r[n]) for n in names]) for r in table.select(names).to_pylist())


def duck(folder: str, sql: str) -> pa.Table:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c.execute(sql).to_arrow_table()


def same(df, folder: str, sql: str) -> None:
    mine, theirs = df.toArrow(), duck(folder, sql)
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    a, b = rows_of(mine), rows_of(theirs)
    assert a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])


#: Names that operators use inside; a table that has columns of these names must not confuse them.
CLASHING = ("value", "key", "tokens", "label", "n", "priority", "part", "word", "start", "units", "alive", "at")


def awkward(folder: str, to: str, kind: str) -> str:
    """A copy of the tables: ``empty`` (no rows), ``nulls`` (a row of nulls, repeated rows, empty and very long texts) or
    ``clash`` (extra columns with the names that operators use)."""
    os.makedirs(to, exist_ok=True)
    for f in sorted(os.listdir(folder)):
        t = pq.read_table(os.path.join(folder, f)).replace_schema_metadata(None)
        fixed = f.removesuffix(".parquet") in ("source_units", "demonyms", "chunk_limits", "extractor_trust", "mix_targets", "pack_specs")
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "nulls" and not fixed:
            none = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names})
            keys = {"raw_chunks": "chunk_id", "documents": "doc_id", "extraction_result": "result_id", "row_provenance": "row_id"}
            name = f.removesuffix(".parquet")
            if name in keys:
                k = keys[name]
                kind_ = t.schema.field(k).type
                none = none.slice(0, 1).set_column(none.column_names.index(k), k, pa.array([10**7 if pa.types.is_integer(kind_) else "none-row"], kind_))
                parts = [t, none]
                text = {"raw_chunks": "content", "documents": "text"}.get(name)
                if text:
                    for n, s in enumerate(("", "   \n ", "x" * 70_000, "Ã¼ber " * 9_000)):
                        row = t.slice(0, 1)
                        row = row.set_column(row.column_names.index(k), k, pa.array([10**7 + 1 + n if pa.types.is_integer(kind_) else f"long-{n}"], kind_))
                        parts.append(row.set_column(row.column_names.index(text), text, pa.array([s], t.schema.field(text).type)))
                t = pa.concat_tables(parts)
            else:
                t = pa.concat_tables([t, none, t.slice(0, 3), t.slice(0, 3)])
        elif kind == "clash":
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array([f"{c}{i % 3}" for i in range(len(t))]))
        pq.write_table(t, os.path.join(to, f))
    return to
