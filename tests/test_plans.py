import pytest
from pyspark.errors import AnalysisException

from textrel.plans.delta import Delta, Registry, analyze, classify, cost
from textrel.operators.chunks import split_recursive
from textrel.operators.extract import ANCHORS, RULES, RuleExtractor, document_identity, rule_extractor
from textrel.plans import rewrite as rw
from textrel.plans.engine import Engine, NotReady
from textrel.plans.lattice import build, name_variations
from textrel.plans.profile import Predicate, profile
from textrel.plans.rewrite import rewrite_bare_columns
from textrel.plans.types import semantic_type


def test_profile(spark):
    p = profile(spark, "SELECT p.name, COUNT(*) n, MAX(age) FROM player p LEFT JOIN team ON p.team = team.team_name WHERE p.age >= 30 AND (p.nationality = 'French  ' OR NOT p.college = 'x') AND 5 < p.draft_pick AND team.founded_year IS NOT NULL GROUP BY p.name")
    assert p.tables == ["player", "team"] or sorted(p.tables) == ["player", "team"]
    assert {(x.column, x.op, x.value) for x in p.predicates} == {("age", ">=", "30"), ("nationality", "=", "French  "), ("college", "!=", "x"), ("draft_pick", ">", "5"), ("founded_year", "is not null", None)}
    assert p.joins[0].left == ("player", "team") and p.joins[0].right == ("team", "team_name") and p.joins[0].kind == "LeftOuter"
    assert p.group_by == [("player", "name")] and ("max", "", "age") in p.aggregates and "age" in p.unresolved
    q = profile(spark, "SELECT a FROM t WHERE b BETWEEN 1 AND 2 AND c IN ('x', 'y') AND d NOT LIKE '%z' AND e = -3")
    assert {(x.column, x.op, x.value) for x in q.predicates} == {("b", ">=", "1"), ("b", "<=", "2"), ("c", "=", "x"), ("c", "=", "y"), ("d", "not like", "%z"), ("e", "=", "-3")}


@pytest.mark.parametrize("columns, predicates, joins, kind", [(0, 0, 0, Delta.CACHE_HIT), (0, 0, 1, Delta.JOIN_ALIGNMENT), (1, 0, 1, Delta.COLUMN), (0, 1, 0, Delta.ROW), (1, 1, 1, Delta.MIXED)])
def test_decisions(columns, predicates, joins, kind):
    assert classify(bool(columns), bool(predicates), bool(joins)) is kind
    assert cost(Delta.MIXED, 2, 3) == 9.0 and cost(Delta.CACHE_HIT, 0, 0) == 0.1


def test_range_predicates_on_full_columns_are_no_delta(spark):
    r = Registry()
    for c in ("name", "age"):
        r.mark("player", c, "FULL")
    for op in (">=", "<=", "!=", "<", ">"):
        assert analyze(spark, f"SELECT name FROM player WHERE age {op} 30", r).kind is Delta.CACHE_HIT
    assert analyze(spark, "SELECT p.name FROM player p WHERE p.height > 3", r).missing_columns == {"player": ("height",)}
    assert analyze(spark, "SELECT COUNT(x.height) FROM player x GROUP BY x.name", r).kind is Delta.COLUMN


def test_scopes_unite_and_full_stays(spark):
    r = Registry()
    a, b = Predicate("t", "c", "=", "1"), Predicate("t", "c", ">", "5")
    r.mark("t", "c", "PARTIAL", frozenset([a]))
    assert analyze(spark, "SELECT c FROM t WHERE c = 1", r).kind is Delta.CACHE_HIT
    assert analyze(spark, "SELECT c FROM t WHERE c > 5", r).missing_predicates == (b,)
    r.mark("t", "c", "PARTIAL", frozenset([b]))
    assert r.covers(a) and r.covers(b)
    r.mark("t", "c", "FULL")
    r.mark("t", "c", "PARTIAL", frozenset([a]))
    assert r.entries["t", "c"][0] == "FULL"


def test_lattice(spark):
    lattice = build(spark, ["SELECT name FROM disease WHERE city = 'Rome'", "SELECT p.x FROM patient p JOIN disease d ON p.dis = d.name WHERE d.year = 3", "SELECT d.name FROM disease d JOIN patient p ON d.name = p.dis", "SELECT FROM nothing WHERE", "SELECT kind, COUNT(name), SUM(price) FROM drug GROUP BY kind"])
    assert lattice.tables == {"disease", "patient", "drug"} and len(lattice.failed) == 1
    assert len(lattice.joins) == 1 and lattice.columns["disease", "name"].is_join_key
    assert lattice.hints("disease") == {"city": ["Rome"], "year": ["3"]}
    assert lattice.columns["drug", "name"].semantic == "PERSON" and lattice.columns["drug", "price"].semantic == "MONEY"
    assert [f.dataType.typeName() for f in lattice.schema("drug")] == ["string", "string", "double"]


def test_types_and_names():
    expected = {"patient_name": "PERSON", "hospital": "ORG", "admission_date": "DATE", "city": "GPE", "icd_code": "CODE"}
    assert {c: semantic_type(c) for c in expected} == expected
    assert semantic_type("foo") == "OTHER" and semantic_type("foo", summed=True) == "QUANTITY"
    v = name_variations("disease_name")
    assert "disease name" in v and "disease_names" in v and "DiseaseName" in v


def test_bare_columns(spark):
    same = "SELECT a, COUNT(*) FROM t GROUP BY a"
    assert rewrite_bare_columns(spark, same) == same
    assert "min(b) AS b" in rewrite_bare_columns(spark, "SELECT a, b, SUM(c) FROM t GROUP BY a")
    assert "max_by(t.b, struct(c, t.b)) AS b" in rewrite_bare_columns(spark, "SELECT t.a, t.b, MAX(c) AS m FROM t GROUP BY t.a")


def test_engine_aligns_join_keys_without_touching_the_tables(spark):
    a = spark.createDataFrame([("x", "ANN-LEE"), ("y", "Bo")], "k string, who string")
    b = spark.createDataFrame([("Ann Lee", 1), ("ann lee ", 2)], "name string, n int")
    e = Engine(spark).load({"aa": a, "bb": b})
    answer = e.query("SELECT aa.k, bb.n FROM aa JOIN bb ON aa.who = bb.name")
    assert answer.plan.kind is Delta.JOIN_ALIGNMENT and sorted(r.n for r in answer.rows.collect()) == [1, 2]
    assert {r.who for r in e.tables["aa"].collect()} == {"ANN-LEE", "Bo"}
    with pytest.raises(AnalysisException):
        e.query("SELECT city.city_name FROM aa WHERE city.area > 3")


ANN = "Ann Lee (born July 1, 1990) is a professional basketball player for the Red Foxes. In 2010, Ann Lee was selected with the first overall pick by the Red Foxes."


def _docs(spark):
    return spark.createDataFrame([("1", "player", f"Ann Lee\n\n{ANN}"), ("2", "player", "12345\n\nIn 1999, he was selected with the fifth overall pick."), ("3", "player", "Bo Ek\n\nBo Ek averaged 7.5 points, 2.0 rebounds."), ("4", "player", "Bo Ek\n\nNothing here."), ("5", "player", None)], "doc_id string, table_name string, text string")


def test_engine_fills_columns_and_restores(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db")).preprocess(["SELECT name, team FROM player"], _docs(spark))
    assert {r.name: r.team for r in e.query("SELECT name, team FROM player").rows.collect()} == {"Ann Lee": "Red Foxes", "Bo Ek": None, None: None}
    assert e.stats()["full_columns"] == 2 and e.stats()["unassigned_documents"] == 2 and e.ready()
    answer = e.query("SELECT name, birth_date, points, height FROM player")
    assert answer.plan.kind is Delta.COLUMN and {tuple(r) for r in answer.rows.collect()} == {("Ann Lee", "July 1, 1990", None, None), ("Bo Ek", None, "7.5", None), (None, None, None, None)}
    assert e.query("SELECT birth_date, points FROM player").plan.kind is Delta.CACHE_HIT
    assert e.query("SELECT height FROM player").plan.missing_columns == {"player": ("height",)}
    old = Engine.restore(spark, str(tmp_path / "db"))
    assert old.registry.entries == e.registry.entries and old.query("SELECT points FROM player WHERE points > 7").plan.kind is Delta.CACHE_HIT
    assert old.query("SELECT draft_pick FROM player").rows.where("draft_pick IS NOT NULL").count() == 2
    old.reset()
    assert old.stats()["tables"] == 0
    with pytest.raises(NotReady):
        Engine.restore(spark, str(tmp_path / "none"))


def test_engine_reads_a_chunk_once(spark):
    calls = []

    class Counting(RuleExtractor):
        def __call__(self, chunks):
            calls.append(chunks.count())
            return super().__call__(chunks)

    e = Engine(spark, extractors={"player": Counting(RULES["player"])}, unassigned=False)
    e.preprocess(["SELECT name, team FROM player"], _docs(spark).where("doc_id < '3'"))
    e.query("SELECT points, college FROM player")
    e.preprocess(["SELECT name, team, points FROM player"], _docs(spark))
    assert calls == [1, 2] and {r.name: r.points for r in e.query("SELECT name, points FROM player").rows.collect()} == {"Ann Lee": None, "Bo Ek": "7.5"}


def test_engine_over_documents_is_what_a_plain_program_finds(spark, data):
    """Chunks, rules and votes followed step by step; a column delta gives what one synthesis gives."""
    from collections import Counter
    from hashlib import sha256

    import regex

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "table_name", "text").where("table_name = 'player'")
    known = {r.doc_id: r.identity for r in document_identity(docs, "text").collect()}
    rules = {c: regex.compile(p) for c, p in RULES["player"].items()}
    votes = {}
    for d in docs.collect():
        for i, chunk in enumerate(split_recursive(d.text or "")):
            found = {c: m[1] for c, p in rules.items() if (m := p.search(chunk))}
            if found:
                who = known[d.doc_id]
                row = votes.setdefault(who.strip().replace("İ", "i").lower() if who else f"doc:{d.doc_id}", {})
                for c in ("draft_pick", "points", "college"):
                    if c in found:
                        row.setdefault(c, []).append((found[c], sha256(f"{d.doc_id}|{i}".encode()).hexdigest()))
    expected = {c: Counter() for c in ("draft_pick", "points", "college")}
    for row in votes.values():
        for c, vs in row.items():
            n, first = Counter(v for v, _ in vs), {v: min(k for x, k in vs if x == v) for v, _ in vs}
            expected[c][min(n, key=lambda v: (-n[v], first[v], v))] += 1
    one = Engine(spark).preprocess(["SELECT name, points, college, draft_pick FROM player"], docs)
    two = Engine(spark).preprocess(["SELECT name FROM player"], docs)
    for e in (one, two):
        rows = e.query("SELECT points, college, draft_pick FROM player").rows.collect()
        assert len(rows) == len(votes)
        assert {c: Counter(r[c] for r in rows if r[c] is not None) for c in expected} == expected


def test_sieve_passes_all_that_rules_find(spark, data):
    chunks = spark.read.parquet(f"{data}/raw_chunks.parquet").select("chunk_id", "content")
    for t, rules in RULES.items():
        x = rule_extractor(rules, ANCHORS[t])
        assert x(chunks).where("size(records) > 0").join(chunks.where(x.sieve(chunks.content)), "chunk_id", "left_anti").count() == 0


def test_engine_adds_rows(spark):
    docs = spark.createDataFrame([(str(i), "player", f"Pat{'abcdefgh'[i]} Doe\n\nIn {1990 + i}, Pat was selected with the first overall pick. averaged {i}.5 points") for i in range(8)], "doc_id string, table_name string, text string")
    e = Engine(spark).preprocess(["SELECT name, draft_year, points FROM player"], docs)
    e.registry = Registry()
    e.load({"player": e.tables["player"].where("draft_year < '1993'")}, {("player", "draft_year"): frozenset([Predicate("player", "draft_year", "<", "1993")])})
    answer = e.query("SELECT name, draft_year, points FROM player WHERE draft_year >= 1995")
    assert answer.plan.kind is Delta.ROW and {tuple(r)[1:] for r in answer.rows.collect()} == {("1995", "5.5"), ("1996", "6.5"), ("1997", "7.5")}
    assert e.query("SELECT name FROM player WHERE draft_year >= 1995").plan.kind is Delta.CACHE_HIT and e.tables["player"].count() == 6


def test_similar_keys_join_after_equal_ones(spark):
    long = "The Old Harbour Basketball Association"
    a = spark.createDataFrame([("x", "The Old Harbowr Basketball Association"), ("y", "OLD TOWN"), ("z", None)], "k string, who string")
    b = spark.createDataFrame([(long, 1), ("Old Town", 2)], "name string, n int")
    e = Engine(spark).load({"aa": a, "bb": b})
    e.lattice = build(spark, ["SELECT aa.k FROM aa JOIN bb ON aa.who = bb.name", "SELECT aa.k FROM bb JOIN aa ON bb.name = aa.who"])
    assert e.align_workload() == 1
    assert sorted((r.k, r.n) for r in e.query("SELECT aa.k, bb.n FROM aa JOIN bb ON aa.who = bb.name").rows.collect()) == [("x", 1), ("y", 2)]
    e = Engine(spark, similar_keys=False).load({"aa": a, "bb": b})
    assert [r.k for r in e.query("SELECT aa.k, bb.n FROM aa JOIN bb ON aa.who = bb.name").rows.collect()] == ["y"]


def test_identity_and_preflight(spark):
    e = Engine(spark)
    lattice = build(spark, ["SELECT player_name, team FROM player", "SELECT n, price FROM sale", "SELECT city FROM place"])
    assert e._identity_column("player", lattice) == "player_name" and e._identity_column("sale", lattice) is None and e._identity_column("place", lattice) == "city"
    found = {f.check: f.passed for f in e.preflight(["SELECT name, height FROM player", "SELECT FROM nothing WHERE"], _docs(spark))}
    assert found == {"statements": False, "documents": True, "texts of player": True, "extractor of player": True, "columns of player": False, "identity of player": True, "storage": True}
    with pytest.raises(NotReady):
        e.preprocess(["SELECT city_name FROM city"], _docs(spark), check=True)


def test_records_without_identity_are_rows(spark):
    e = Engine(spark)
    e.identity["player"] = None
    e.preprocess(["SELECT points FROM player"], _docs(spark))
    assert sorted(r.points or "" for r in e.query("SELECT points FROM player").rows.collect()) == ["", "", "7.5"]


def test_rewriting(spark):
    assert rw.rewrite_literals("SELECT 'Ann' AS `'ann'` -- 'ann'\nFROM t WHERE a = ' ANN ' AND b = 'O''Neil'", {"ann": "Ann Lee", "o'neil": "Shaq's"}) == "SELECT 'Ann Lee' AS `'ann'` -- 'ann'\nFROM t WHERE a = 'Ann Lee' AND b = 'Shaq''s'"
    q = lambda s: rw.query_type(profile(spark, s))
    assert [q("SELECT COUNT(*) FROM t"), q("SELECT a FROM t JOIN u ON t.x = u.x"), q("SELECT a FROM t WHERE b = 1")] == ["aggregation", "join", "select_filter"]
    keys = lambda s: rw.result_keys(profile(spark, s))
    assert [keys("SELECT a, COUNT(*) FROM t GROUP BY a"), keys("SELECT a FROM t JOIN u ON t.x = u.x"), keys("SELECT a FROM t")] == [["a"], ["t.id", "u.id"], ["id"]]
    assert rw.with_columns(spark, "SELECT a, b FROM t WHERE c = 'from'") == "SELECT a, b, t.id AS `id` FROM t WHERE c = 'from'"
    assert rw.with_columns(spark, "SELECT x.a FROM t x JOIN u ON x.k = u.k") == "SELECT x.a, x.id AS `t.id`, u.id AS `u.id` FROM t x JOIN u ON x.k = u.k"
    for same in ("SELECT id, a FROM t", "SELECT * FROM t", "SELECT COUNT(*) FROM t", "SELECT DISTINCT a FROM t"):
        assert rw.with_columns(spark, same) == same
    assert rw.with_columns(spark, "SELECT a FROM t", "name") == "SELECT a, t.name AS `name` FROM t"
    assert rw.with_qualified_names(spark, "SELECT t.a, u.b AS c FROM t JOIN u ON t.k = u.k") == "SELECT t.a AS `t.a`, u.b AS c FROM t JOIN u ON t.k = u.k"


def test_ctes_and_subqueries_are_profiled(spark):
    p = profile(spark, "WITH b AS (SELECT k, MAX(x) AS m FROM orders WHERE y > 3 GROUP BY k) SELECT m FROM b WHERE m > (SELECT AVG(z) FROM big) AND EXISTS (SELECT 1 FROM far WHERE far.q = 'a')")
    assert sorted(p.tables) == ["big", "far", "orders"] and p.columns["orders"] == {"k", "x", "y"} and p.columns["big"] == {"z"}
    assert {(x.table, x.column, x.value) for x in p.predicates} >= {("orders", "y", "3"), ("far", "q", "a")}
    assert "min(v) AS v" in rewrite_bare_columns(spark, "WITH b AS (SELECT k, v, COUNT(*) AS n FROM t GROUP BY k) SELECT v FROM b")
