import datetime as dt

from textrel.operators.orphans import Parent, orphan_references, orphan_report, references


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_kinds(spark):
    kids = spark.createDataFrame([(1, "Ann  Lee", day(5)), (2, "ann lee", day(0)), (3, "Ann Lee", day(20)), (4, "Nobody", day(5)), (5, "n/a", day(5)), (6, None, day(5)), (7, "Ann Lee", None), (4, "Nobody", day(5)), (8, "Bo", day(12)), (9, "ann lee", day(10))], "id bigint, ref string, ingested_at timestamp")
    folk = spark.createDataFrame([(" ANN LEE ", day(1), day(10)), ("Ann Lee", day(15), day(18)), ("Bo", day(3), day(2)), ("Bo", day(11), None), (None, day(1), None)], "name string, ingested_at timestamp, deleted_at timestamp")
    found = orphan_references(references(kids, "kid", "ref", "folk"), [Parent("folk", folk, "name")])
    got = {(r.rec_id, r.ref_value): r.orphan_kind for r in found.collect()}
    assert got == {(2, "ann lee"): "late", (3, "Ann Lee"): "deleted", (4, "Nobody"): "missing", (7, "Ann Lee"): "deleted", (9, "ann lee"): "late"}
    assert sum(r.n_orphans for r in orphan_report(found).collect()) == 5


def test_one_key_holds_most_rows(spark):
    kids = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) AS ref", "timestamp'2024-02-01' AS ingested_at")
    folk = spark.range(1).selectExpr("'other' AS name", "timestamp'2024-01-01' AS ingested_at", "cast(null AS timestamp) AS deleted_at")
    found = orphan_references(references(kids, "kid", "ref", "folk"), [Parent("folk", folk, "name")])
    assert found.count() == 3000 and {r.orphan_kind for r in found.select("orphan_kind").distinct().collect()} == {"missing"}
