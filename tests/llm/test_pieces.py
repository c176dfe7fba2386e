import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textrel.llm.pieces import boundary_table, cut_range, cut_text, split_files, split_texts, stitched


def whole(text, longest, shared, size):
    n, pieces = cut_text(text, longest, shared, size)
    assert n == len(text)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text("abc .,\n。Aé", max_size=700), st.integers(5, 70), st.data())
def test_pieces_of_ranges(text, longest, data):
    shared = data.draw(st.integers(0, longest - 1))
    size = data.draw(st.integers(longest + 34, 400))
    p = whole(text, longest, shared, size)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= longest for a, b in p)
    for (_, b), (c, d) in zip(p, p[1:]):
        assert c == b - shared and d > b


def test_no_crumbs_at_the_end():
    text = "word " * 81 + "end"
    p = whole(text, 200, 0, 4096)
    assert len(p) == 3 and min(b - a for a, b in p) >= 50


def test_natural_ends():
    text = "First sentence here. Second one is here. " * 20 + "\n\n" + "Third paragraph, with a clause, goes on. " * 20
    for a, b in whole(text, 200, 20, 400)[:-1]:
        assert text[b - 1].isspace()


def test_bad_limits():
    with pytest.raises(ValueError):
        cut_range("abc", 0, 3, 5, 5, True, True)


def test_tables_and_files_agree(spark, tmp_path):
    random.seed(1)
    text = "".join(random.choice(["Hello world. ", "Ünïcode täxt, ", "日本語。", "\n\n", "word "]) for _ in range(9000))
    (tmp_path / "a.txt").write_text(text)
    f = sorted(split_files(spark, str(tmp_path / "*.txt"), 500, 50, size=4096).collect(), key=lambda r: r.piece_no)
    assert [r.piece_no for r in f] == list(range(len(f))) and f[0].start == 0 and f[-1].end == len(text)
    assert all(text[r.start : r.end] == r.content and len(r.content) <= 500 for r in f)
    assert all(y.start == x.end - 50 for x, y in zip(f, f[1:]))
    df = spark.createDataFrame([("a", "t", text), ("b", "t", "short"), ("c", "t", None), ("d", "t", ""), ("e", "other", text)], "id string, kind string, text string")
    limits = spark.createDataFrame([("t", 500, 50)], "kind string, max_chars int, overlap_chars int")
    got = split_texts(df, "id", "text", limits, size=4096).collect()
    mine = sorted((r for r in got if r.id == "a"), key=lambda r: r.piece_no)
    assert mine[0].start == 0 and mine[-1].end == len(text) and all(text[r.start : r.end] == r.content for r in mine)
    rest = {r.id: (r.piece_no, r.end, None if r.content is None else len(r.content)) for r in got if r.id != "a"}
    assert rest == {"b": (0, 5, 5), "c": (0, 0, None), "d": (0, 0, 0), "e": (0, len(text), len(text))}
    assert [r.id for r in split_texts(df, "id", "text", limits, size=4096, content=False).where("piece_no = 0 AND n_chars > max_chars").collect()] == ["a"]


def test_broken_bytes_and_spans(spark, tmp_path, monkeypatch):
    """Files with bytes that are no UTF-8, in ranges that cut characters, and sums over several spans of ranges."""
    from textrel.llm import pieces

    monkeypatch.setattr(pieces, "SPAN", 3)
    data = ("Ünï café. ".encode() * 40 + b"\xff\xfe broken \xc3 here. ") * 30
    (tmp_path / "b.bin").write_bytes(data)
    (tmp_path / "c.bin").write_bytes(b"tiny")
    text = re.sub("[\ud800-\udfff]", "\ufffd", data.decode("utf-8", "surrogateescape"))
    rows = split_files(spark, str(tmp_path / "*.bin"), 300, 30, size=1024).collect()
    for name, whole_text in (("b.bin", text), ("c.bin", "tiny")):
        f = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.piece_no)
        assert [r.piece_no for r in f] == list(range(len(f))) and f[0].start == 0 and f[-1].end == len(whole_text)
        assert all(whole_text[r.start : r.end] == r.content and len(r.content) <= 300 for r in f) and all(y.start == x.end - 30 for x, y in zip(f, f[1:]))
    files = spark.read.format("binaryFile").load(str(tmp_path / "b.bin")).select("path", "length")
    t = sorted(stitched(boundary_table(files, 300, 30, 1024)).collect(), key=lambda r: r.range_no)
    assert [r.char_at for r in t] == [sum(x.chars for x in t[:i]) for i in range(len(t))] and len(t) > 9


def test_time_is_linear_in_the_text():
    from time import process_time

    text = "A sentence of some words, and a clause. " * 25_000
    took = []
    for n in (1, 4):
        began = process_time()
        cut_text(text * n, 2000, 200)
        took.append(process_time() - began)
    assert took[1] < 8 * max(took[0], 0.05)
