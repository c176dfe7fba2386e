import pytest

from textrel.llm.sentences import Segmenter, abbreviation, collocation, language, learn, sentence_units

TITLES = ["Mr. Cole", "Dr. Hart", "Mr. Dale", "Dr. Marsh", "Mr. Ford"]
LINES = [f"{t} came to the hall at {n} p.m. The gym was full, etc. and loud. He has never left the U.S. She said: “We won. We did.” before the break. Nobody left early. She stayed. The hall was dark. What a night that was!" for n in range(1, 9) for t in TITLES] + [
    f"In 19{n}, the club beat the {w} of the U.S. tour. It drew {n},000 fans." for n in range(10, 60) for w in ("Jets", "Foxes")
]


@pytest.fixture(scope="module")
def cut(spark):
    model = learn(spark.createDataFrame([(t,) for t in [*LINES, None, "", " \n"]], "text string"))
    s = Segmenter(model)
    return lambda text: [text[a:b] for a, b in s.spans(text)]


def test_ratios():
    assert collocation(100, 50, 45, 10_000) > 100 > collocation(100, 50, 1, 10_000)
    assert abbreviation("mr", 40, 40, 300, 4000) > 0.3 > abbreviation("full", 3, 60, 300, 4000)


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Mr. Cole came. He left.", ["Mr. Cole came.", "He left."]),
        ("It is 3.5 miles. The end.", ["It is 3.5 miles.", "The end."]),
        ("He came at 7 p.m. The gym was full.", ["He came at 7 p.m.", "The gym was full."]),
        ("He came at 7 p.m. on Monday.", ["He came at 7 p.m. on Monday."]),
        ("He never left the U.S. The U.S. tour began.", ["He never left the U.S.", "The U.S. tour began."]),
        ("She said: “We won. We did.” The end.", ["She said: “We won. We did.”", "The end."]),
        ("Some (not all. Most.) stayed. He left.", ["Some (not all. Most.) stayed.", "He left."]),
        ("He waited ... and left. What a night!", ["He waited ... and left.", "What a night!"]),
        ("A sentence that runs\nover a line. The end.", ["A sentence that runs\nover a line.", "The end."]),
        ("Ann Lee\n\nHe left.", ["Ann Lee", "He left."]),
        ("Ann Lee\nHe left.", ["Ann Lee", "He left."]),
        ("- Ann, 3.5 ppg\n- Bo, 2.1 ppg\nHe left.", ["- Ann, 3.5 ppg", "- Bo, 2.1 ppg", "He left."]),
        ("球队成立于1984年；主场位于河边。他说：“很难。但我们赢了。”谁能替代他呢？", ["球队成立于1984年；主场位于河边。", "他说：“很难。但我们赢了。”", "谁能替代他呢？"]),
        ("“我们不会放弃。我们会赢。”他说道。他等了一下……然后出手。", ["“我们不会放弃。我们会赢。”他说道。", "他等了一下……然后出手。"]),
        ("वह आया। वह गया।", ["वह आया।", "वह गया।"]),
        ("Wait?! No.", ["Wait?!", "No."]),
        ("one two", ["one two"]),
        ("", []),
        (" \n \n", []),
    ],
)
def test_sentences(cut, text, parts):
    assert cut(text) == parts


def test_all_text_is_in_one_unit(cut):
    import random

    random.seed(6)
    bits = ["Mr. Cole", "\n", "\n\n", ". ", "! ", "“", "”", "(", ")", '"', "。", "中文", "ไทย ครับ", " - x", "U.S.", "3.5", "...", " ", "«", "»", "؟"]
    model_cut = cut
    for _ in range(400):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 40)))
        parts = model_cut(text)
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(p == p.strip() and p for p in parts)


def test_languages():
    assert language("He was the best of all in the world") == "en" and language("球队成立于一年") == "zh" and language("これは本です。球") == "ja"
    assert language("El club del norte gana por dos") == "es" and language("") == "" and language("Ο σύλλογος") == "el"


def test_units_table(spark, cut):
    model = learn(spark.createDataFrame([], "text string"))
    df = spark.createDataFrame([(1, "He left. She stayed."), (2, None), (3, ""), (1, "He left. She stayed."), (4, "y" * 60_000)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.sent_no, r.sent_start, r.sent_end) for r in sentence_units(df, model).collect())
    assert got == [(1, 1, 0, 8)] * 2 + [(1, 2, 9, 20)] * 2 + [(4, 1, 0, 60_000)]


def test_collocations_by_log_likelihood(spark):
    """A type that often ends sentences does not before a word that belongs to it; a name that begins sentences elsewhere is no such word."""
    names = ["He", "She", "They", "Nobody"]
    texts = [f"{a} never left the U.S. {b} stayed at home. {a} was glad. {b} slept." for a in names for b in names for _ in range(8)]
    texts += [f"{a} won the U.S. Open with ease. {a} left." for a in names for _ in range(12)] + [f"{a} came back to the U.S. Walter waited there. Walter slept. Walter stayed." for a in names for _ in range(3)]
    model = learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    cut = lambda text: [text[a:b] for a, b in Segmenter(model).spans(text)]
    assert ("", "u.s", "Open") in model.collocations and not {("", "u.s", w) for w in (*names, "Walter")} & model.collocations
    assert cut("Ann won the U.S. Open again. She left.") == ["Ann won the U.S. Open again.", "She left."]
    assert cut("Ann never left the U.S. Walter waited. She left.") == ["Ann never left the U.S.", "Walter waited.", "She left."]
