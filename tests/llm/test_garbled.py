import random

import numpy as np
import pytest

from textrel.llm.garbled import PairModel, find_garbled, find_lost_marks, has_lost_marks, maximal_segments, pair_counts, repair_text, _codes

CLEAN = ["Jérôme Müller joined São Paulo. Šarūnas Žukauskas ate naïve crème brûlée, wasn’t it – “fine”?", "Тренер сказал: мы победили. Ο σύλλογος ιδρύθηκε. 球队成立于一九八四年；主场位于河边。", "İşıl Çağlar Göktürk, Đorđe Petrović, André Gonçalves, Günther Größe, Élodie Rousseau"] * 60


@pytest.fixture(scope="module")
def model(spark):
    return pair_counts(spark.createDataFrame([(t,) for t in [*CLEAN, None, ""]], "text string"), "text")


def fixed(text, model):
    return repair_text(text, model.information(_codes(text)), model)


def test_counts(model):
    assert model.total == sum(map(len, CLEAN)) + len(CLEAN) - 1 or abs(model.total - sum(map(len, CLEAN))) <= len(CLEAN)


@pytest.mark.parametrize("encoding", ["cp1252", "mac_roman", "cp1251", "koi8-r", "cp437", "cp850", "latin-1"])
@pytest.mark.parametrize("text", ["Günther Müller", "Jérôme Rousseau is here", "Šarūnas Petrović"])
def test_round_trip(model, encoding, text):
    try:
        bad = text.encode().decode(encoding)
    except UnicodeDecodeError:
        pytest.skip("the encoding has no such byte")
    got = fixed(bad, model)
    assert got is not None and got[0] == text and got[1], got


def test_garbled_twice_and_in_capitals(model):
    bad = "Günther Müller".encode().decode("cp1252").encode().decode("cp1252")
    assert fixed(bad, model)[0] == "Günther Müller"
    upper = "Günther Müller was here".encode().decode("cp1252").upper()
    assert fixed(upper, model)[0] == "GÜNTHER MÜLLER WAS HERE"


def test_a_stretch_only(model):
    bad = "Élodie Rousseau met " + "Günther Müller".encode().decode("cp1252") + " and Đorđe Petrović."
    assert fixed(bad, model)[0] == "Élodie Rousseau met Günther Müller and Đorđe Petrović."


def test_single_byte_confusion(model):
    bad = "Jérôme Rousseau".encode("cp1252").decode("cp1251")
    got = fixed(bad, model)
    assert got and got[0] == "Jérôme Rousseau"


@pytest.mark.parametrize("text", ["ÂGE : 31 ANS", "Çà et là.", "Ñandú, Ðorđe, Åsa.", "Ânsia e JOÃO são nomes", "Naïve? Hardly.", "plain", "½ € ™ ° §"])
def test_unusual_is_not_damaged(model, text):
    assert fixed(text, model) is None


def test_lost(model, spark):
    assert fixed("Bo�ko", model)[1] is False
    assert has_lost_marks("Lorvabi?u", False) and has_lost_marks("?ar?nas", True) and has_lost_marks("Fennekovi?", True)
    assert not has_lost_marks("III (?)", True) and not has_lost_marks("Who else?Nobody", False) and not has_lost_marks("Why? because", False)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Bo�ko"), (4, "MÃ¼ller"), (5, "Müller"), (4, "MÃ¼ller"), (6, "x" * 50_000 + " MÃ¼ller")], "id int, v string")
    got = sorted((r.id, r.restored and r.restored[-6:]) for r in find_garbled(df, "v", model).collect())
    assert got == [(3, None), (4, "Müller"), (4, "Müller"), (6, "Müller")]
    with pytest.raises(ValueError):
        find_garbled(df.withColumnRenamed("id", "restored"), "v", model)


def test_lost_at_edges_and_in_passages(model, spark):
    lost = ["?? ?????? ?????? 22,582 ??????? ????? ?????.", "????1961??????????????6,749????????1980?????", "After the series, ?yvind Kermedahl won", "moved Aleksandar Cormikovi? to No. 8", "outside the U.S. ?5???1.9 m", "?yvind won"]
    kept = ["Really?? Yes.", "What a game!?? No", "Why? because", "Who else?Nobody", "?Nobody", "Who would replace Luís? Đorđe", "In 2017? No.", "He asked: who? and left", "Quoi ?? Non", "(?)"]
    df = spark.createDataFrame(list(enumerate([*lost, *kept, None, ""])), "id int, v string")
    assert sorted(r.id for r in find_lost_marks(df, "v").collect()) == list(range(len(lost)))
    assert find_garbled(df, "v", model).count() == 0


def test_planted_damage(spark, data):
    """Sentences of clean documents, every other one damaged by a random wrong decoding."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = pair_counts(docs, "text")
    texts = [t for (d,) in docs.select("text").collect() for t in (d or "").split("\n") if 20 < len(t) < 200 and sum(c > "\x7f" for c in t) > 2]
    rng.shuffle(texts)
    rows, damaged = [], set()
    for i, t in enumerate(texts[:1200]):
        if i % 2:
            encoding = rng.choice(["cp1252", "latin-1", "mac_roman", "cp1251", "cp437"])
            bad = t.encode().decode(encoding, "replace")
            if bad == t:
                continue
            damaged.add(i)
            rows.append((i, bad, t))
        else:
            rows.append((i, t, t))
    found = {r.id: r.restored for r in find_garbled(spark.createDataFrame(rows, "id int, v string, truth string"), "v", model).collect()}
    hits = damaged & set(found)
    assert len(hits) >= 0.97 * len(damaged) and len(hits) >= 0.97 * len(found)
    truth = {i: t for i, _, t in rows}
    assert all(found[i] in (truth[i], None) for i in hits if found[i]) or sum(found[i] == truth[i] for i in hits if found[i]) >= 0.97 * sum(found[i] is not None for i in hits)


def test_segments_against_brute_force():
    random.seed(5)
    for _ in range(200):
        s = [random.choice([-3, -2, -1, 1, 2, 3]) for _ in range(random.randint(1, 12))]
        got = maximal_segments(s)
        best = max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        if best > 0:
            assert max(sum(s[a:b]) for a, b in got) == best
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        for a, b in got:  # every proper prefix and suffix of a maximal segment has a positive sum
            assert all(sum(s[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(s[k:b]) > 0 for k in range(a, b))


def test_unseen_pairs_score_alike():
    m = PairModel(np.zeros(1 << 20, np.float32), np.zeros(1 << 17, np.float32), 1e6)
    v = m.information(_codes("aéb"))
    assert abs(v[0] - np.log(1000 / (1e6 + 1000))) < 1e-3 and abs(v[0] - v[1]) < 1e-6
