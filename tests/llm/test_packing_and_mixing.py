import random

import pytest
from pyspark.sql import functions as F

from textrel.llm.mixing import Source, largest_exact_total, mix_sources, water_fill
from textrel.llm.packing import Tournament, fill_report, pack_documents
from textrel.llm.tokens import token_count


def test_tournament_is_first_fit():
    random.seed(1)
    for _ in range(60):
        cap = random.randint(1, 60)
        tree, plain = Tournament(cap), []
        for _ in range(random.randint(1, 80)):
            size = random.randint(0, cap)
            at = next((i for i, room in enumerate(plain) if room >= size), len(plain))
            if at == len(plain):
                plain.append(cap)
            plain[at] -= size
            assert tree.place(size) == at
    with pytest.raises(ValueError):
        Tournament(5).place(6)


def _packed(spark, sizes, specs, **kw):
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    s = spark.createDataFrame(specs, "spec_name string, capacity_tokens int")
    return d, s, pack_documents(d, s, **kw)


@pytest.mark.parametrize("kw", [{}, {"group_tokens": 700}])
def test_every_token_once(spark, kw):
    random.seed(2)
    sizes = [random.choice([0, None, 3, 17, 50, 51, 100, 101, 999]) for _ in range(300)]
    d, s, packed = _packed(spark, sizes, [("s", 50), ("l", 400)], **kw)
    rows = packed.collect()
    for name, cap in (("s", 50), ("l", 400)):
        room, seen = {}, {}
        for r in (x for x in rows if x.spec_name == name):
            room[r.container_id] = room.get(r.container_id, 0) + r.token_end - r.token_start
            seen.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        assert all(v <= cap for v in room.values())
        for i, n in enumerate(sizes):
            parts = sorted(seen[i])
            assert parts[0][0] == 0 and parts[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-(n or 0) // cap))
    places = {}
    for r in rows:
        places.setdefault((r.spec_name, r.container_id), []).append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert all(0.5 < r.filled <= 1 for r in fill_report(packed, s).collect())


def test_water_filling():
    s = [Source("a", 0.5, 1000, 1), Source("b", 0.3, 100, 2), Source("c", 0.2, 500, 1), Source("d", 0.0, 9, 1)]
    assert water_fill(s, 100) == {"a": 50, "b": 30, "c": 20, "d": 0}
    got = water_fill(s, 1000)
    assert got["b"] == 200 and abs(got["a"] / got["c"] - 2.5) < 1e-9 and abs(sum(got.values()) - 1000) < 1e-6
    assert water_fill(s, 10**6) == {"a": 1000, "b": 200, "c": 500, "d": 0}
    assert abs(largest_exact_total(s) - 200 / 0.3) < 1e-6
    assert largest_exact_total([]) == 0.0 and water_fill([], 5) == {}


def test_mix(spark):
    random.seed(4)
    rows = [(i, random.choice(["a", "a", "a", "b", "c", None, "zz"]), random.randint(0, 200)) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(sizes, targets)
    caps = {"a": 1, "b": 3, "c": 2}
    picked = chosen.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and all(1 <= r.repeats <= caps[r.source] for r in picked)
    share = {r.source: r.actual_share for r in report.collect()}
    assert abs(share["a"] - 0.4 / 0.9) < 0.003 and abs(share["b"] - 0.4 / 0.9) < 0.003 and abs(share["c"] - 0.1 / 0.9) < 0.003 and share["none"] == 0
    again = mix_sources(sizes, targets)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, picked))
    everything = mix_sources(sizes, targets, total=1e12)[1].collect()
    assert {r.source: r.mean_repeats for r in everything} == {"a": 1.0, "b": 3.0, "c": 2.0, "none": None}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a " * 20_000)], "id int, t string")
    got = {r.id: r.n for r in df.select("id", token_count(F.col("t")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 20_000
