from pyspark.sql import functions as F

from textrel.operators.units import parse_number, propagate, snapped, unify_quantities

SOURCES = "src string, area_unit string, population_unit string, gdp_unit string, decimal_mark string"


def test_numbers(spark):
    cases = [("1,234.5", ".", 1234.5), ("1.234,5", ",", 1234.5), ("12.345.678", ",", 12345678.0), ("89509,26 hectares", ",", 89509.26), ("0.5552 mn", ".", 0.5552), ("218.288", ",", 218288.0), ("US$ 6,701.4 mn", ".", 6701.4), ("none here", ".", None), ("7", None, 7.0), ("1,234", ".", 1234.0), ("12,3456", ".", 12.3456)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, m string").select(parse_number(F.col("t"), F.col("m")).alias("n"))
    assert [r.n for r in df.collect()] == [c for _, _, c in cases]


def _city(spark, rows):
    return spark.createDataFrame(rows, "id bigint, city_name string, area string, population string, gdp string, remark string, src string")


def test_units_from_text_remark_source_and_others(spark):
    sources = spark.createDataFrame([("a", "km2", "persons", "usd_m", "."), ("b", "mi2", "thousand", "usd_bn", "."), ("c", "ha", "persons", "usd", ",")], SOURCES)
    rows = [
        (1, "X", "259", "100,000", "5,000", None, "a"),
        (2, " x ", "100", "100", "5", None, "b"),
        (3, "X", "25.900,5", "100.000", "5000000000", None, "c"),
        (4, "X", "64000 acres", "0.1 million", "$5 bn", None, "a"),
        (5, "X", "100", "100", "5.0", "area: figures in square miles; population (thousands); gdp given in billions of US dollars", "a"),
        (6, "X", "100", "n/a", "5000", None, "a"),
        (7, None, "12", None, None, None, "unheard"),
        (8, "lonely", "10", "x", "0", None, "b"),
    ]
    got = {(r.rec_id, r.field_name): r.unit_code for r in unify_quantities(_city(spark, rows), sources).collect()}
    assert got[1, "area"] == "km2" and got[2, "area"] == "mi2" and got[3, "area"] == "ha" and got[4, "area"] == "acre" and got[5, "area"] == "mi2"
    assert got[6, "area"] == "mi2"  # the source says square kilometres
    assert (6, "population") not in got and got[5, "population"] == "thousand" and got[4, "population"] == "million"
    assert got[2, "gdp"] == "usd_bn" and got[3, "gdp"] == "usd" and got[5, "gdp"] == "usd_bn" and got[6, "gdp"] == "usd_m"
    assert got[7, "area"] == "km2" and got[8, "area"] == "mi2" and got[8, "population"] == "thousand"


def test_a_source_that_is_wrong_throughout(spark):
    sources = spark.createDataFrame([("a", "km2", "persons", "usd_m", "."), ("liar", "km2", "persons", "usd_m", ".")], SOURCES)
    rows = []
    for i in range(12):
        km2 = 100.0 + 37 * i
        rows += [(3 * i, f"c{i}", f"{km2:.2f} km²", None, None, None, "a"), (3 * i + 1, f"c{i}", f"{km2 / 2.59:.2f}", None, None, None, "liar")]
    got = {r.rec_id: r.unit_code for r in unify_quantities(_city(spark, rows), sources).collect()}
    assert all(got[3 * i + 1] == "mi2" and got[3 * i] == "km2" for i in range(12))


def test_graph():
    assert abs(snapped("area", -0.41) + 0.4133) < 1e-3
    fixed = propagate([("area", "b:x", "n:y", -0.41, 9), ("area", "b:x", "b:z", 0.01, 5)])
    assert fixed["area", "n:y"] == 0 and abs(fixed["area", "b:x"] + 0.4133) < 1e-3 and fixed["area", "b:z"] == fixed["area", "b:x"]
