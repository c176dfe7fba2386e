import json

from textrel.sources import files
from textrel.streaming.ingest import document_stream, ingest, stored_chunks


def test_text_and_csv(spark, tmp_path):
    for name, text in (("player/1.txt", "Ann\nx"), ("player/2.txt", " \n"), ("team/a b.txt", "Foxes")):
        p = tmp_path / "set" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    docs = {r.doc_id: (r.table_name, r.text) for r in files.text_documents(spark, str(tmp_path / "set")).collect()}
    assert docs == {"player/1.txt": ("player", "Ann\nx"), "player/2.txt": ("player", " \n"), "team/a b.txt": ("team", "Foxes")}
    assert [r.doc_id for r in files.table_documents(spark, str(tmp_path / "set"), "player").collect()] == ["doc::player::1"]
    (tmp_path / "t.csv").write_text('Unnamed: 0,name ,age,tags\n0,"  Ann   Lee ","1,200",a||b\n1,,x,\n')
    t = files.clean_csv(spark, str(tmp_path / "t.csv"), {"age": "bigint"})
    assert [tuple(r) for r in t.collect()] == [("Ann Lee", 1200, "a || b"), (None, None, None)]
    (tmp_path / "p.csv").write_text('"""name""",file_name\nAnn,out/7.txt\n')
    p = files.predictions(spark, str(tmp_path / "p.csv"), ["id", "name", "age"])
    assert p.columns == ["id", "name", "age"] and tuple(p.first()) == ("7", "Ann", None)
    files.write_results(str(tmp_path / "res"), t, t, {"f1": 1})
    assert json.loads((tmp_path / "res/acc.json").read_text()) == {"f1": 1}


def test_workloads(spark, tmp_path):
    text = "-- Query 1: first\nSELECT ';' AS a; -- rest\n/* no; */ SELECT b\nFROM t;\n-- Q2:\nSELECT c"
    got = files.workload(text)
    assert [(s.label, s.sql) for s in got] == [("Query 1: first", "SELECT ';' AS a"), ("", "SELECT b\nFROM t"), ("Q2", "SELECT c")]
    (tmp_path / "w.sql").write_text(text)
    assert files.read_workload(spark, str(tmp_path)) == got
    paths = files.write_manifests(spark, str(tmp_path / "m"), got, {"t": {"b": {"value_type": "int"}}}, lambda sql: {"t": {"b"}} if "FROM t" in sql else {})
    assert json.load(open(paths[1]))["t"] == {"b": {"value_type": "int"}}


def test_stream_adds_each_document_once(spark, tmp_path):
    """A document that comes again, in a batch or later, adds nothing; a stream that is started again goes on where it was."""
    docs = spark.createDataFrame([(1, "the arena is full"), (2, "nothing here"), (1, "the arena is full")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        ingest(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), ["arena"]).awaitTermination(60)
        assert [(r.doc_id, r.content) for r in stored_chunks(spark, str(tmp_path / "out")).collect()] == [(1, "the arena is full")]
        if not n:
            spark.createDataFrame([(1, "again the arena"), (3, "an arena")], "doc_id bigint, text string").where("doc_id = 1").write.mode("append").parquet(str(tmp_path / "in"))
