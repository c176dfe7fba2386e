import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textrel.functions import similarity as sim
from textrel.functions import text as tx
from textrel.operators import chunks as ch


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, tx.normalized, "  Éric O'Neal—Jr. ") == "éric o neal jr"
    assert one(spark, tx.number_or_null, " 1,200 ") == 1200 and one(spark, tx.number_or_null, "45%") == 45 and one(spark, tx.number_or_null, "x") is None
    assert one(spark, tx.canonical_attribute, "StateOfResidence") == "state_of_residence"
    assert one(spark, tx.canonical_attribute, "Birth - Date__") == "birth_date"
    assert one(spark, tx.multi_values, "a || b||  ||c") == ["a", "b", "c"]
    assert one(spark, tx.token_estimate, "") == 0 and one(spark, tx.token_estimate, "abc") == 1 and one(spark, tx.token_estimate, "a" * 9) == 2
    assert [one(spark, tx.is_missing, v) for v in (None, " ", "N/A", "None", "x")] == [True, True, True, True, False]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "a")], "a string, b string")
    got = df.select(sim.edit_ratio(F.col("a"), F.col("b")).alias("e"), sim.gestalt_ratio("a", "b").alias("g")).collect()
    assert got[0].e == 0.75 and got[0].g == 0.75 and got[1].e == 1 and got[2].g is None
    assert one(spark, sim.canonical_name, "José “Pepe” Núñez-Díaz Jr.") == "jose pepe nunez diaz"
    assert one(spark, sim.finite_number, "1,5e3") == 15000 and one(spark, sim.finite_number, "NaN") is None
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = v.select(sim.cosine(sim.vector(F.col("a")), sim.vector(F.col("b"))).alias("c"), sim.cosine(sim.vector(F.col("a")), sim.vector(F.col("z"))).alias("z")).first()
    assert abs(r.c - 0.70710678) < 1e-6 and r.z is None
    assert sorted(one(spark, sim.surface_forms, "1234.5")) == ["1,234", "1234.5", "1234.50", "1234.500"] and one(spark, sim.surface_forms, "x") == []


def test_overlap_of_chunks():
    pieces = ch.split_recursive("A" * 200 + "B" * 200, 100, 20)
    assert len(pieces) > 1 and pieces[1][:20] == pieces[0][-20:]
    assert ch.split_recursive("  ") == [] and ch.split_recursive(" short ", 100) == ["short"]


@given(st.text("ab .\n", max_size=400), st.integers(10, 60))
def test_chunks_hold_all_text(text, size):
    pieces = ch.split_recursive(text, size, 0)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    assert all(len(p) <= size for p in pieces)


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, ""), (3, None), (4, "x" * 25)], "doc_id int, text string")
    stride = ch.stride_chunks(docs, "doc_id", "text", 10, 3).collect()
    assert [r.content for r in stride if r.doc_id == 4] == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    windows = ch.word_windows(docs, "doc_id", "text", 2).collect()
    assert [r.content for r in windows if r.doc_id == 1] == ["one two", "three four", "five"]
    with pytest.raises(ValueError):
        ch.stride_chunks(docs, "doc_id", "text", 10, 10)
    stored = spark.createDataFrame([(1, 0)], "doc_id int, chunk_index int")
    arriving = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 1, "b")], "doc_id int, chunk_index int, content string")
    assert [(r.chunk_index, r.content) for r in ch.new_chunks(stored, arriving).collect()] == [(1, "b")]


def test_predicates_on_records(spark):
    df = spark.createDataFrame([("30",), ("1,200",), ("abc",), (None,)], "v string")
    keep = lambda op, x: [r.v for r in df.where(ch.matches_predicate(F.col("v"), op, x)).collect()]
    assert keep(">=", "100") == ["1,200", "abc"]  # a range on text that is no number passes
    assert keep("=", "ABC") == ["abc"] and keep("!=", "30") == ["1,200", "abc"] and keep("=", "30.0") == ["30"]
    assert ch.any_literal(F.lit("x"), []) is not None


def test_sieve(spark):
    df = spark.createDataFrame([("The Arena is big",), ("arenas",), ("costs 5 %",), (None,)], "t string")
    assert [r.t for r in ch.sieve(df, "t", ["arena"], [ch.PATTERNS["percent"]]).collect()] == ["The Arena is big", "costs 5 %"]
