import pytest
from pyspark.sql import functions as F

from textrel.operators import attributes as ai
from textrel.operators import store as st


def test_upsert_fills_nulls_only_and_is_idempotent(spark):
    table = spark.createDataFrame([("1", "Ann", None, 5.0), ("2", None, "x", None)], "row_id string, name string, team string, age double")
    new = spark.createDataFrame([(" ANN ", "Red", 9.0), ("Bo", "Blue", 3.0), ("bo", None, 4.0), (None, "q", 1.0), ("", "q", 1.0)], "name string, team string, age double")
    once = st.upsert_by_entity(table, new, "name")
    got = {(r.row_id, r.team, r.age) for r in once.collect()}
    assert got == {("1", "Red", 5.0), ("2", "x", None), (None, "Blue", 3.0)}
    twice = st.upsert_by_entity(once, new, "name")
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    assert st.upsert_by_entity(table, new, "name", known_only=True).count() == 2


def test_consolidation_keeps_zeros_and_breaks_ties_by_first(spark):
    df = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, "y"), ("a", 3, None, "y"), ("a", 4, None, "x"), ("b", 5, None, None)], "k string, o int, n int, s string")
    got = {r.k: (r.n, r.s, r.n_rows) for r in st.consolidate(df, "k", ["n", "s"], "o").collect()}
    assert got == {"a": ("0", "x", 4), "b": (None, None, 1)}


def test_registry_never_downgrades(spark):
    schema = "table_name string, column_name string, predicate_scope array<string>, status string, last_updated timestamp, record_count bigint"
    old = spark.createDataFrame([], schema).unionByName(spark.sql("SELECT 't' table_name, 'c' column_name, array('a = 1') predicate_scope, 'FULL' status, timestamp'2024-01-01' last_updated, 9L record_count"))
    new = spark.sql("SELECT 't' table_name, 'c' column_name, array('b = 2', 'a = 1') predicate_scope, 'PARTIAL' status, timestamp'2024-02-01' last_updated, 3L record_count")
    r = st.apply_registry(old, new).first()
    assert r.status == "FULL" and r.predicate_scope == ["a = 1", "b = 2"] and r.record_count == 3


def test_schema_evolution_and_updates(spark):
    t = spark.createDataFrame([("1", "a")], "row_id string, name string")
    wide = st.evolve(t, {"age": "double", "name": "string"})
    assert wide.columns == ["row_id", "name", "age"] and wide.first().age is None
    changed = spark.createDataFrame([("1", "b"), ("9", "z")], "row_id string, name string")
    assert [tuple(r) for r in st.replace_rows(t, changed, "row_id").collect()] == [("1", "b")]
    assert st.delete_rows(t, changed, "row_id").count() == 0
    records = spark.sql("SELECT map('age', '1,200', 'what', 'x') AS m UNION ALL SELECT map('age', 'old')")
    assert sorted(str(r.age) for r in st.records_to_rows(records, "m", {"age": "double"}).collect()) == ["1200.0", "None"]
    empty = st.create_table(spark, t.schema["name"].dataType and t.select("name").schema)
    assert empty.columns == ["row_id", "name", "created_at"] and empty.isEmpty()


def test_attribute_index(spark):
    d = spark.createDataFrame([("t", "c1", "Birth Date"), ("t", "c2", "birth_date"), ("t", "c1", "birth_date"), ("t", "c3", "Team"), ("t", "c1", " ")], "table_name string, chunk_id string, raw_attr string")
    got = {r.attribute: (r.variants, r.n_chunks) for r in ai.build_index(d).collect()}
    assert got == {"birth_date": (["Birth Date", "birth_date"], 2), "team": (["Team"], 1)}
    index = ai.entries(d)
    assert {r.attribute for r in ai.selective_attributes(index, 0.5).collect()} == {"team"}
    assert ai.fuzzy_attributes("colege", ["college", "team"]) == ["college"] and ai.fuzzy_attributes("zzz", ["college"]) == []
    stale = spark.createDataFrame([("t", "zz")], "table_name string, chunk_id string")
    with pytest.raises(ai.StaleIndexError):
        ai.require_fresh(index, stale, "t")
    assert ai.require_fresh(index, d, "t").count() == 3
    keys = spark.sql("SELECT map('a', '1', 'b', '2') AS m UNION ALL SELECT map('a', '1')")
    assert {r.key: round(r.share, 3) for r in ai.key_frequencies(keys, "m").collect()} == {"a": 0.667, "b": 0.333}


def test_cell_and_row_provenance(spark):
    rows = spark.createDataFrame([("r", 2, "c2", "x", None), ("r", 1, "c1", None, "y"), ("r", 3, "c3", "z", "w")], "row_id string, o int, chunk_id string, a string, b string")
    got = {r.column_name: r.chunk_id for r in st.cell_provenance(rows, "row_id", ["a", "b"], ["chunk_id"], "o").collect()}
    assert got == {"a": "c2", "b": "c1"}
    lists = spark.createDataFrame([("r", ["b", "a", None]), ("r", ["a", " "])], "row_id string, ids array<string>")
    assert st.merged_sources(lists, "row_id", "ids").first().ids == ["a", "b"]
    assert rows.where(F.col("a").isNull()).count() == 1
