import pytest

from textrel.operators.packed import Lexicon, candidate_runs, parse_values, split_packed

DEMONYMS = Lexicon(["American", "Antiguan and Barbudan", "Bissau-Guinean", "French"], dashes=True)
FIRMS = Lexicon(["Hill, Lake & Moor Partners LP", "Ivy and Sons Ventures", "Ann Lee"])


def values(s, lexicon):
    return [v for v, _ in parse_values(s, lexicon)]


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("American", ["American"]),
        ("American; French", ["American", "French"]),
        ("American-French", ["American", "French"]),
        ("Bissau-Guinean–French", ["Bissau-Guinean", "French"]),
        ("American and Antiguan and Barbudan", ["American", "Antiguan and Barbudan"]),
        ("American, and French ;", ["American", "French"]),
        ("American;; French", ["American", "French"]),
        ('["American", "French"]', ["American", "French"]),
        ('"American" / “French”', ["American", "French"]),
        ("'American','French'", ["American", "French"]),
        (" ; , ", []),
        ("American\nFrench\tAmerican", ["American", "French", "American"]),
    ],
)
def test_nationalities(cell, expected):
    assert values(cell, DEMONYMS) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("Ann Lee, Hill, Lake & Moor Partners LP", ["Ann Lee", "Hill, Lake & Moor Partners LP"]),
        ("Ivy and Sons Ventures and Ann Lee (60%)", ["Ivy and Sons Ventures", "Ann Lee"]),
        ("Ann Lee (from 1988, with partners); Bo Ek", ["Ann Lee", "Bo Ek"]),
        ('"Ann Lee (majority; managing)"', ["Ann Lee"]),
        ("Oak, Elm & Ash Capital Inc., Bo Ek", ["Oak, Elm & Ash Capital Inc.", "Bo Ek"]),
        ("Ann Lee || Bo Ek | Cy Fox", ["Ann Lee", "Bo Ek", "Cy Fox"]),
    ],
)
def test_owners(cell, expected):
    assert values(cell, FIRMS) == expected


def test_malformed_quotes_and_brackets_are_flagged():
    assert parse_values('"Ann Lee; Bo Ek', FIRMS) == [("Ann Lee", "quote"), ("Bo Ek", "")]
    assert parse_values("[Ann Lee; Bo Ek", FIRMS)[0] == ("Ann Lee", "bracket")
    assert parse_values("Ann Lee; Bo Ek (since 2", FIRMS)[-1] == ("Bo Ek", "remark")
    assert [v for v, _ in parse_values('"a" b"; c', FIRMS)] == ['a" b', "c"]


def test_long_cells_end():
    cell = "; ".join(f"Name {i}" for i in range(5000))
    assert len(parse_values(cell, FIRMS)) == 5000
    assert len(candidate_runs(", ".join(f"N{i}" for i in range(300)), [2, 5])) <= 2 * 300


def test_full_names_stay_whole_whatever_signs_they_hold(spark):
    """Any separator, any number of them, quotes and brackets."""
    long = "A, B, C, D, E, F, G, H, I, J and K Trust"
    names = ["Hill/Lake Group", "Ann; Bo Trust", "North + South Holdings", long, 'Tim "Q" Fox', "Max", None, "", "Ann; Bo Trust"]
    cells = {1: ("Hill/Lake Group; Ann; Bo  Trust", ["Hill/Lake Group", "Ann; Bo  Trust"]), 2: (f"{long.lower()} & Bo", [long.lower(), "Bo"]), 3: ("North + South Holdings | Max", ["North + South Holdings", "Max"]), 4: ('"Ann; Bo Trust", Tim "Q" Fox (49%) & Zed', ["Ann; Bo Trust", 'Tim "Q" Fox', "Zed"]), 5: ("[Hill/Lake Group, Max]", ["Hill/Lake Group", "Max"])}
    df = spark.createDataFrame([(i, c) for i, (c, _) in cells.items()], "id int, cell string")
    got = {}
    for r in split_packed(df, "cell", lexicon=spark.createDataFrame([(n,) for n in names], "name string")).orderBy("id", "value_pos").collect():
        got.setdefault(r.id, []).append(r.item_value)
        assert r.flag == ""
    assert got == {i: v for i, (_, v) in cells.items()}


def test_split_packed(spark):
    df = spark.createDataFrame([(1, "Ann Lee, Hill, Lake & Moor Partners LP"), (2, "n/a"), (3, None), (1, "Ann Lee, Hill, Lake & Moor Partners LP"), (4, " Bo Ek ")], "id int, cell string")
    names = spark.createDataFrame([("hill, Lake & Moor Partners LP",), (None,), ("Hill,  Lake & Moor Partners LP",)], "name string")
    got = sorted((r.id, r.value_pos, r.item_value, r.n_values) for r in split_packed(df, "cell", lexicon=names).collect())
    assert got == [(1, 1, "Ann Lee", 2)] * 2 + [(1, 2, "Hill, Lake & Moor Partners LP", 2)] * 2 + [(4, 1, "Bo Ek", 1)]
    with pytest.raises(ValueError):
        split_packed(df.withColumnRenamed("id", "flag"), "cell")
