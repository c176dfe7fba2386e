import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textrel.operators import evaluate as ev
from textrel.operators import extract as ex
from textrel.operators import resolve as rs
from textrel.operators import skew as sk
from textrel.operators.model import ModelExtractor, ask, extraction_prompt


def test_similar_pairs_against_brute_force(spark):
    random.seed(4)
    words = {"".join(random.choice("abc ") for _ in range(random.randint(5, 16))) for _ in range(250)}
    words |= {w[:i] + random.choice("xyz") + w[i + random.randint(0, 1) :] for w in list(words)[:120] for i in (random.randrange(len(w)),)}
    df = spark.createDataFrame([(w,) for w in words for _ in range(2)], "w string")
    for threshold in (0.75, 0.85):
        got = {(r.a, r.b) for r in rs.similar_pairs(df, "w", threshold).collect()}
        d = spark.createDataFrame([(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 5], "a string, b string")
        want = {(r.a, r.b) for r in d.where(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= threshold).collect()}
        assert got == want


def test_clusters(spark):
    pairs = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30) if i != 12] + [("q", "r")], "a string, b string")
    got = {r.mention: r.cluster for r in rs.cluster_labels(pairs).collect()}
    assert got["n12"] == "n00" and got["n13"] == "n13" and got["n30"] == "n13" and got["r"] == "q" and len(got) == 33
    forms = rs.canonical_forms(spark.createDataFrame([("Ann", "a"), ("Ann Lee", "a"), ("Bo", "b")], "mention string, cluster string"))
    assert {r.mention: (r.canonical, r.confidence) for r in forms.collect()} == {"Ann": ("Ann Lee", 0.7), "Ann Lee": ("Ann Lee", 0.7), "Bo": ("Bo", 1.0)}
    assert {r.key: r.canonical for r in rs.canonical_map(forms).collect()} == {"ann": "Ann Lee", "ann lee": "Ann Lee", "bo": "Bo"}


def test_nearest_vectors_against_brute_force(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    got = {(r.query_id, r.rank): r.vec_id for r in rs.nearest_vectors(e.where("vec_id % 100 = 0"), e, 5).collect()}
    import numpy as np

    rows = e.collect()
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i, r in enumerate(rows):
        if r.vec_id % 100 == 0:
            order = sorted((-round(float(s), 9), x.vec_id) for s, x in zip(m @ m[i], rows) if x.vec_id != r.vec_id)
            assert [got[r.vec_id, k] for k in range(1, 6)] == [v for _, v in order[:5]]


def test_augmented_join(spark):
    docs = spark.createDataFrame([("north hill gulls", 1), ("bay foxes", 2)], "k string, n int")
    asks = spark.createDataFrame([("north hil gulls",), ("bay foxes",)], "k string")
    got = {(r.k, r.n, r.is_augmented) for r in rs.augment_keys(docs, "k", asks, "k").collect()}
    assert got == {("north hill gulls", 1, False), ("bay foxes", 2, False), ("north hil gulls", 1, True)}


def test_batches_merge_by_place(spark):
    a = spark.sql("SELECT 1 AS k, array(map('a', '1'), map('a', '2')) AS r")
    b = spark.sql("SELECT 1 AS k, array(map('b', 'x', 'a', 'no'), map('b', 'y'), map('b', 'z')) AS r")
    got = {r.position: r.record for r in rs.merge_batches([a, b], "k", "r").collect()}
    assert got == {0: {"a": "1", "b": "x"}, 1: {"a": "2", "b": "y"}, 2: {"b": "z"}}


def test_mentions(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, n string, t string")
    assert rs.mentions_of(rows, "id", {"n": "PERSON", "t": "ORG"}).count() == 4


def test_json_in_prose():
    assert ex.balanced_json('Sure [1]: see {"a": "br]ace \\" }"} ok') == "[1]"
    assert ex.balanced_json('text {"a": "br]ace }"} more') == '{"a": "br]ace }"}'
    assert ex.balanced_json("no { json [ here") is None


def test_response_records(spark):
    df = spark.createDataFrame([('Here: [{"name": "Ann", "age": "n/a", "zz": "q"}, {"name": "[\\"\\", \\"Bo\\"]"}]',), ('{"name": " Cy "}',), ("nothing",), (None,)], "t string")
    got = [r.r for r in df.select(ex.response_records(F.col("t"), ["name", "age"]).alias("r")).collect()]
    assert got == [[{"name": "Ann", "age": None}, {"name": "Bo"}], [{"name": "Cy"}], None, None]


def test_grounding_and_validation(spark):
    df = spark.createDataFrame([("1200", "x", "Ann", "It cost 1,200 dollars, Ann said."), ("9", "[a]", "123", "It cost 1,200 dollars."), ("abc", "It cost", None, "It cost  1,200")], "n string, t string, who string, content string")
    g = df.select(ex.is_grounded(F.col("n"), F.col("content")).alias("g"), ex.is_valid_identity(F.col("who"), F.col("content")).alias("i")).collect()
    assert [tuple(r) for r in g] == [(True, True), (False, False), (False, False)]
    v = [tuple(r) for r in ex.validated(df, {"n": "number", "t": "text"}, "content").select("n", "t").collect()]
    assert v == [("1200", None), ("9", None), (None, "It cost")]


def test_identities(spark):
    docs = spark.createDataFrame([(1, "\nAnn Lee\n\ntext"), (2, ""), (3, "unknown\nx"), (4, "He left. \nx"), (5, "12,5\n"), (6, " ".join("abcdefghij") + "\nx"), (7, None), (8, "Bo Ek Jr.\nx")], "id int, text string")
    got = {r.id: r.reject_reason or r.identity for r in ex.document_identity(docs, "text").collect()}
    assert got == {1: "Ann Lee", 2: "blank", 3: "missing", 4: "sentence", 5: "digits", 6: "too_long", 7: "blank", 8: "Bo Ek Jr."}
    scores = {r.column_name: r.score for r in ex.identity_scores(spark.createDataFrame([("Ann", "1", "x"), ("Bob", "2", "x"), ("Cid", "3", None)], "name string, n string, k string"), ["name", "n", "k"]).collect()}
    assert scores["name"] > scores["k"] > scores["n"]
    votes = spark.createDataFrame([("c", "P"), ("c", "P"), ("c", "O"), ("d", "P")], "c string, l string")
    assert [(r.c, r.l, r.n) for r in ex.dominant_type(votes, "c", "l").collect()] == [("c", "P", 2)]


def test_scores(spark):
    gold = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "k int, s string, n double")
    found = spark.createDataFrame([(1, "A ", 1.05), (3, "z", 0.0), (2, None, None)], "k int, s string, n double")
    pairs = ev.paired_rows(gold, found, ["k"], "s")
    assert pairs.count() == 2
    m = {r.column_name: (r.precision, r.recall) for r in ev.column_metrics(pairs, {"s": ev.string_score(F.col("gold_s"), F.col("found_s")), "n": ev.number_score(F.col("gold_n"), F.col("found_n"), 0.1)}, 3, 3).collect()}
    assert m == {"s": (1 / 3, 1 / 3), "n": (1 / 3, 1 / 3)}
    e = ev.group_errors(gold.groupBy("k").agg(F.sum("n").alias("v")), found.groupBy("k").agg(F.sum("n").alias("v")), ["k"], "v")
    assert {r.k: round(r.error, 3) for r in e.collect()} == {1: 0.65, 2: 1.0, 3: 1.0}
    gold_lists = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'a'), (1, 'b'), (2, NULL) AS t(k, v)")
    found_lists = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'c'), (3, 'x') AS t(k, v)")
    assert {r.k: (r.precision, r.recall) for r in ev.list_scores(gold_lists, found_lists, ["k"], "v", 1.0).collect()} == {1: (0.5, 1 / 3), 2: (1.0, 1.0), 3: (0.0, 0.0)}


def test_names_match_in_levels(spark):
    found = {"José Núñez": ("Jose Nunez", 2), "LEE, Ann": ("Ann Lee", 5), "Bo Ek Jr.": ("bo ek", 2), "Tim van Berg": ("Tim Q. Berg", 3), "Max Paul Horn": ("Paul Otto Horn", 4), "Rob Stone": ("Robert Stone", 6), " Ann Lee ": ("Ann Lee", 1)}
    names = spark.createDataFrame([(n,) for n in [*found, "Nobody Known", None, "  ", "José Núñez"]], "name string")
    gold = spark.createDataFrame([(g,) for g in {g for g, _ in found.values()}] + [("Zed Horn",), (None,)], "name string")
    assert {r.found: (r.gold, r.level) for r in ev.name_matches(gold, names, "name").collect()} == {n.strip(): v for n, v in found.items()}
    rewritten = sorted(r.name or "" for r in ev.rewritten_keys(gold, names, "name").collect())
    assert rewritten == sorted([" Ann Lee ", "Nobody Known", "", "  ", *[g for n, (g, _) in found.items() if n != " Ann Lee "], "Jose Nunez"])


def test_broken_answers_are_mended():
    good = '[{"name": "Ann", "age": "3"}]'
    for broken in ("```json\n" + good + "\n```", '[{"name": "Ann", "age": "3",}]', "[{'name': 'Ann', 'age': '3'}]", '{name: "Ann", age: "3"', '[{"name": "Ann", "age": "3"', 'So: [{"name": "Ann", "age": "3"},'):
        found = json.loads(ex.repaired_json(broken))
        assert (found if isinstance(found, dict) else found[0]) == {"name": "Ann", "age": "3"}, broken
    assert ex.repaired_json("no json") is None and ex.repaired_json("") is None and ex.repaired_json("[}") is None


def test_answers_about_passages(spark):
    answer = '{"passage_1": [{"name": {"value": "Ann", "span": "Ann came"}, "age": 3, "x": 1}], "passage_2": [], "passage_3": [{"name": "n/a"}], "other": 4}'
    rows = ex.passage_records(spark.createDataFrame([(1, answer), (2, "none"), (3, None)], "k int, a string"), "k", "a", ["name", "age"]).collect()
    assert [(r.k, r.passage, r.position, r.record, r.spans) for r in rows] == [(1, 1, 0, {"name": "Ann", "age": "3"}, {"name": "Ann came"}), (1, 3, 0, {"name": None}, {})]


def test_model_extractor(spark):
    """Column batches and chunk groups, a call that fails, an answer that has to be repaired, and cells that the text does not hold."""

    def connect():
        seen = []

        def call(prompt):
            seen.append(prompt)
            if len(seen) == 1:
                raise OSError("busy")
            if prompt.startswith("This should be JSON"):
                return '{"passage_1": [{"age": "7"}], "passage_2": [{"age": "99"}]}'
            if "- age" in prompt:
                return "I cannot"
            return '{"passage_1": [{"name": {"value": "Ann", "span": "Ann"}}], "passage_2": [{"name": "Zed"}]}'

        return call

    chunks = spark.createDataFrame([("a", "Ann is 7"), ("b", "Bo is here")], "chunk_id string, content string").coalesce(1)
    x = ModelExtractor(connect, "player", {"name": "text", "age": "number"}, {"name": ["Ann Lee"]}, column_batch=1, chunk_group=2, delay=0.0)
    found = {r.chunk_id: r.records for r in x(chunks).collect()}
    assert found == {"a": [{"name": "Ann", "age": "7"}], "b": [{"name": "Zed", "age": "99"}]}
    assert {r.chunk_id: r.records for r in ex.grounded_records(x(chunks), chunks).collect()} == {"a": [{"name": "Ann", "age": "7"}], "b": []}
    assert "spell it like one of: Ann Lee" in extraction_prompt("player", {"name": "text"}, ["x"], {"name": ["Ann Lee"]})
    assert ask(lambda p: "never", "p", 2, ["a"], retries=2, delay=0.0) == [[], []]


def test_summaries_and_tables(spark):
    text = "\n".join(["Ann Lee", *[f"Line {i}." for i in range(12)], "She owns a stake in it. The weather is fine! A stake of a company was bought."])
    d = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "word " * 3000 + ". A stake here.")], "k int, t string")
    got = {r.k: r.s for r in d.select("k", ex.summary(F.col("t"), ["stake", "company"]).alias("s")).collect()}
    assert got[1].split("\n") == ["Ann Lee", *[f"Line {i}." for i in range(9)], "She owns a stake in it.", "A stake of a company was bought."]
    assert got[2] == got[3] == "" and len(got[4]) <= 3500
    tables = {"owner": ["stake", "company"], "player": ["points"]}
    assert [r[0] for r in d.orderBy("k").select(ex.table_of(F.col("t"), tables)).collect()] == ["owner", None, None, "owner"]
    gated = ex.document_identity(d.withColumn("table_name", F.lit("player")), "t", vocabulary=tables).where("k = 1").first()
    assert gated.reject_reason == "other_table" and gated.identity is None


def test_resolution_keeps_types_apart(spark):
    m = spark.createDataFrame([("PERSON", "Jonathan Smithson"), ("PERSON", "jonathan smithsen"), ("ORG", "jonathan smithsan"), ("ORG", "Bo"), ("ORG", " "), ("ORG", None)], "semantic_type string, value string")
    got = {(r.semantic_type, r.key): r.canonical for r in rs.resolved_by_type(m, 0.9).collect()}
    assert got == {("PERSON", "jonathan smithson"): "jonathan smithson", ("PERSON", "jonathan smithsen"): "jonathan smithson", ("ORG", "jonathan smithsan"): "jonathan smithsan", ("ORG", "bo"): "bo"}


def test_hot_keys_are_split(spark):
    """One key with a third of the rows, each at its own place."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id")
    window = Window.partitionBy("k").orderBy("id")
    expected = {(r.k, r.id): r.n for r in rows.withColumn("n", F.row_number().over(window)).collect()}
    assert {(r.k, r.id): r.n for r in sk.numbered(rows, ["k"], ["id"], "n").collect()} == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in sk.range_bucketed(rows, ["k"], ["id"]).where("k = 'hot'").groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 2 and max(sizes) <= 6000 / 4 * 1.5


def test_components_of_chains_and_hubs(spark):
    from textrel.operators.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(1, n) for n in range(1000, 3000)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {n: 1 for n in (1, *range(1000, 3000))} | {5: 5, 7: 7, 8: 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
