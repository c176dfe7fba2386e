"""Oversized texts cut into overlapping pieces at natural boundaries, by ranges, without loading a whole file.

A text is read as ranges of a fixed size. A range comes with a halo on both sides: as much before it as two pieces share,
and as much behind it as the longest piece has. In the halo the same boundaries are detected as by its neighbours, so both
sides of an edge agree on the anchor of a range: the best boundary within the first piece length behind its start. A range
is cut from its anchor to the next one (cut_range), which gives a row of the boundary table: the characters of the range and
its pieces as offsets. Running sums over this table give the offsets and numbers of all pieces.

Files: ranges are read and cut by any worker; the boundary table holds the byte offsets of the pieces, is written once, and the
pieces are emitted by reading these bytes. Texts of a column are one value of one row, so their ranges are cut and summed
where the row is (cut_text), with the same functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrel.session import checkpointed

#: Characters (bytes, for files) of a range.
RANGE = 1 << 16
#: Characters on both sides that decide whether there is a boundary.
MARGIN = 32
#: Boundaries from strong to weak: behind a paragraph, a line, a sentence, a clause, a word.
_BOUNDARIES = re.compile(
    r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n\s*)|(?P<s>(?:[.!?…؟।](?:[\"”’»)\]]|(?<=[.!?…])[.!?…])*[^\S\n]+(?=[^\W\d_a-zà-ÿ]|[\"“„«¿¡(\[\d])|[。！？｡]+[”’」』）)]*))|(?P<c>[,;:،؛](?:[\"”’»])?[^\S\n]+|[，、；：])|(?P<w>[^\S\n]+)"
)
_LEVEL = {"p": 5, "l": 4, "s": 3, "c": 2, "w": 1}
#: Ranges of one file whose numbers are summed together.
SPAN = 4096


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where a piece may end (just behind the boundary), in order, with their levels."""
    at, levels = [], []
    for m in _BOUNDARIES.finditer(text):
        if m.start() > 0:
            at.append(m.end())
            levels.append(_LEVEL[m.lastgroup])
    return at, levels


def _best_end(at: list[int], levels: list[int], low: int, high: int, text: str) -> int:
    """The best end in (low, high]: the strongest boundary of the second half, the last one of these; else the last in
    the first half; else ``high``, moved off combining marks."""
    middle = low + (high - low) // 2
    i, j = bisect_right(at, middle), bisect_right(at, high)
    if i < j:
        top = max(levels[i:j])
        return next(at[k] for k in range(j - 1, i - 1, -1) if levels[k] == top)
    k = bisect_right(at, low)
    if k < i:
        return at[i - 1]
    end = high
    while end > low + 1 and end < len(text) and re.match(r"[̀-゙゚ͯ‍︎️ऺ-़ा-्ัิ-ฺ็-๎]", text[end]):
        end -= 1
    return end


def cut(text: str, start: int, stop: int, longest: int, shared: int, first: bool, at: list[int], levels: list[int]) -> list[tuple[int, int]]:
    """Pieces of text[start:stop] as (start, end). All but the very first of a text begin ``shared`` characters early; the very first
    is longer than that where the text is. The last piece adds at least a quarter of its room, if more than one is needed."""
    pieces = []
    i = start
    while i < stop or (first and not pieces):
        opening = first and not pieces
        early = 0 if opening else min(shared, i)
        room = longest - early
        if stop - i <= room:
            end = stop
        else:
            high = min(i + room, max(i + 1, stop - room // 4))
            end = _best_end(at, levels, min(i + shared, high - 1) if opening else i, high, text)
        pieces.append((i - early, end))
        i = end
        if start == stop:
            break
    return pieces


def anchor(text: str, edge: int, longest: int, shared: int, at: list[int], levels: list[int]) -> int:
    """Where the pieces of the range that begins at ``edge`` start. Depends on the characters near the edge only."""
    window = max(1, longest - shared)
    i, j = bisect_right(at, edge), bisect_right(at, min(len(text), edge + window))
    if i < j:
        top = max(levels[i:j])
        return next(at[k] for k in range(i, j) if levels[k] == top)
    return edge


def _check(longest: int, shared: int) -> None:
    if longest < 1 or shared < 0 or shared >= longest:
        raise ValueError(f"pieces of {longest} characters cannot share {shared} with the one before")


def cut_range(text: str, body_at: int, body: int, longest: int, shared: int, is_first: bool, is_last: bool) -> list[tuple[int, int]]:
    """Pieces of one range as offsets from the start of its body. ``text`` is the body with its halos."""
    _check(longest, shared)
    at, levels = boundaries(text)
    begin = body_at if is_first else anchor(text, body_at, longest, shared, at, levels)
    stop = body_at + body if is_last else anchor(text, body_at + body, longest, shared, at, levels)
    return [(a - body_at, b - body_at) for a, b in cut(text, begin, stop, longest, shared, is_first, at, levels)] if begin < stop or is_first else []


def cut_text(text: str, longest: int, shared: int, size: int = RANGE) -> tuple[int, list[tuple[int, int]]]:
    """The characters of a text and its pieces as offsets: the stitched boundary table of its ranges."""
    chars, pieces = 0, []
    for no in range(max(1, -(-len(text) // size))):
        begin = max(0, no * size - shared - MARGIN)
        behind = min(len(text), (no + 1) * size)
        body = behind - no * size
        found = cut_range(text[begin : behind + longest + MARGIN], no * size - begin, body, longest, shared, no == 0, behind == len(text))
        pieces += [(chars + a, chars + b) for a, b in found]
        chars += body
    return chars, pieces


def split_texts(df: DataFrame, item: str, column: str, limits: DataFrame, size: int = RANGE, keep: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """All texts as pieces: item, the columns ``keep``, n_chars (of the text), max_chars, piece_no, start, end (code points, end
    exclusive) and, unless ``content`` is False, content.

    ``limits`` (max_chars, overlap_chars by the columns it shares with ``df``) is a small fixed table. The table is read
    once and nothing is shuffled. Texts within their limit, and those without one, are one piece and never leave the JVM; a
    null text is one piece with null content, an empty one a piece of length 0. A piece ends at the strongest boundary in the
    second half of its room; where a text offers no boundary at all it is cut at the limit. Repeated rows give repeated pieces.
    """
    piece = "struct<piece_no:int,start:bigint,end:bigint" + (",content:string>" if content else ">")

    @F.pandas_udf(f"struct<n:bigint,pieces:array<{piece}>>")
    def cuts(texts: pd.Series, longest: pd.Series, shared: pd.Series) -> pd.DataFrame:
        out = []
        for t, m, s in zip(texts, longest, shared):
            if t is None:
                out.append((0, []))
                continue
            n, found = cut_text(t, int(m), int(s), size)
            out.append((n, [{"piece_no": k, "start": a, "end": b} | ({"content": t[a:b]} if content else {}) for k, (a, b) in enumerate(found)]))
        return pd.DataFrame(out, columns=["n", "pieces"])

    keys = [c for c in limits.columns if c in df.columns]
    names = list(dict.fromkeys([item, *keep]))
    text, n = F.col("_text"), F.coalesce(F.char_length("_text"), F.lit(0)).cast("bigint")
    rows = df.join(F.broadcast(limits), keys, "left").select(*names, F.col(column).alias("_text"), "max_chars", "overlap_chars")
    over = F.coalesce(n > F.col("max_chars"), F.lit(False))
    rows = rows.withColumn("_over", over).withColumn("_cuts", cuts(F.when(F.col("_over"), text), F.coalesce("max_chars", F.lit(1)), F.coalesce("overlap_chars", F.lit(0))))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), n.alias("end"), *([text.alias("content")] if content else [])))
    pieces = F.when(F.col("_over"), F.col("_cuts.pieces")).otherwise(whole.cast(f"array<{piece}>"))
    return rows.select(*names, F.when(F.col("_over"), F.col("_cuts.n")).otherwise(n).alias("n_chars"), "max_chars", F.inline(pieces))


def _opened(path: str):
    """(file system, path) of a file name as Spark gives it. Any store that Arrow knows can be read by ranges."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", path))
    return fs.FileSystem.from_uri(uri)


def _aligned(data: bytes, i: int) -> int:
    """The first place at or behind ``i`` that is no continuation of a UTF-8 character (of at most four bytes)."""
    i = min(max(i, 0), len(data))
    for k in range(4):
        if i + k >= len(data) or data[i + k] & 0xC0 != 0x80:
            return min(i + k, len(data))
    return i


_BOUNDARY_TABLE = "path string, range_no long, chars long, pieces array<struct<from_byte:bigint,to_byte:bigint,from_char:bigint,to_char:bigint>>"


def boundary_table(files: DataFrame, max_chars: int, overlap_chars: int, size: int = RANGE) -> DataFrame:
    """The cut ranges of files (path, length): path, range_no, chars (of the range), pieces (bytes of the file, characters from the
    range's start). Each range is read with its halos only. Broken bytes are a character each."""
    _check(max_chars, overlap_chars)
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / F.lit(size)))
    ranges = files.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))).repartition("path", "range_no")
    left, right = 4 * (overlap_chars + MARGIN), 4 * (max_chars + MARGIN)

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, length, no in b[["path", "length", "range_no"]].itertuples(index=False):
                store, name = _opened(path)
                begin = max(0, no * size - left)
                with store.open_input_file(name) as f:
                    f.seek(begin)
                    data = f.read(no * size - begin + size + right)
                front = _aligned(data, 0) if begin else 0
                a, z = (_aligned(data, no * size - begin) if no else 0), _aligned(data, no * size - begin + size)
                before, body, behind = (x.decode("utf-8", "surrogateescape") for x in (data[front:a], data[a:z], data[z:]))
                text = before + body + behind
                pieces, byte, char = [], begin + front, 0
                at: dict[int, int] = {}
                found = cut_range(text, len(before), len(body), max_chars, overlap_chars, no == 0, (no + 1) * size >= length)
                for place in sorted({len(before) + x for p in found for x in p}):
                    byte, char = byte + len(text[char:place].encode("utf-8", "surrogateescape")), place
                    at[place] = byte
                pieces = [{"from_byte": at[len(before) + i], "to_byte": at[len(before) + j], "from_char": i, "to_char": j} for i, j in found]
                out.append((path, no, len(body), pieces))
            yield pd.DataFrame(out, columns=["path", "range_no", "chars", "pieces"])

    return ranges.mapInPandas(detect, _BOUNDARY_TABLE)


def stitched(table: DataFrame) -> DataFrame:
    """A boundary table with char_at and piece_at of each range: the characters and pieces before it in its file. Sums are taken
    within spans of SPAN ranges, then over the spans, so no task holds all ranges of a giant file."""
    spans = table.withColumn("_span", F.floor(F.col("range_no") / F.lit(SPAN))).withColumn("_n", F.size("pieces"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy("path", "_span").agg(F.sum("chars").alias("_c"), F.sum("_n").alias("_p"))
    over = before("path").orderBy("_span")
    base = sums.select("path", "_span", F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_p").over(over), F.lit(0)).alias("_p0"))
    within = before("path", "_span").orderBy("range_no")
    return spans.join(base, ["path", "_span"]).select("path", "range_no", "chars", "pieces", (F.col("_c0") + F.coalesce(F.sum("chars").over(within), F.lit(0))).alias("char_at"), (F.col("_p0") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("piece_at"))


def split_files(spark: SparkSession, path: str, max_chars: int, overlap_chars: int, size: int = RANGE) -> DataFrame:
    """Pieces of UTF-8 files (a path or pattern on a store that all executors reach): path, piece_no, start, end, content.

    Files are listed with their sizes, not read; their boundary table is written to the checkpoint folder; each piece is then
    read by its bytes. A range begins at the first whole character at or behind its first byte; broken bytes count as a
    character each and become replacement characters. Empty files give no piece (the file source leaves them out).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    table = stitched(checkpointed(boundary_table(files, max_chars, overlap_chars, size))).where(F.size("pieces") > 0)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, pieces, char_at, piece_at in b[["path", "pieces", "char_at", "piece_at"]].itertuples(index=False):
                store, local = _opened(name)
                first, last = min(p["from_byte"] for p in pieces), max(p["to_byte"] for p in pieces)
                with store.open_input_file(local) as f:
                    f.seek(first)
                    data = f.read(last - first)
                for k, p in enumerate(pieces):
                    text = data[p["from_byte"] - first : p["to_byte"] - first].decode("utf-8", "surrogateescape")
                    out.append((name, piece_at + k, char_at + p["from_char"], char_at + p["to_char"], re.sub("[\ud800-\udfff]", "\ufffd", text)))
            yield pd.DataFrame(out, columns=["path", "piece_no", "start", "end", "content"])

    return table.mapInPandas(emit, "path string, piece_no long, start long, end long, content string")
