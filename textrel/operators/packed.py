"""Several values packed in one cell: a parsing expression grammar with ordered alternatives.

    cell      <- blank* item? (separator+ item)* separator* end
    item      <- known remark? / quoted remark? / bracketed / bare remark?
    quoted    <- open (!close any)* close &(blank* remark? (separator / end))     tried for each pair of quotes
    bracketed <- '[' cell ']' &(blank* (separator / end))
    known     <- a value of the lexicon &(blank* remark? (separator / end))
    bare      <- firm &(blank* remark? (separator / end)) / (!separator any)+
    remark    <- '(' (remark / !')' any)* ')'
    separator <- blank* (';' / ',' / '|' / '/' / '&' / '+' / bullet / tab / newline / 'and' / dash after known) blank*

``known`` comes first where the value of a lexicon begins with a quote or bracket. Alternatives are tried in order. A quote whose closing mark is not followed by a separator or the end is no quote
there; the parser moves to the next closing mark, and when none fits it goes back and reads a bare value with the flag
``quote``. A value of the lexicon stays as it is, whatever separators, quotes or brackets it holds; ``firm`` is the pattern of a
partnership's name, for firms that the lexicon does not have.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrel.functions.text import is_missing, squeezed
from textrel.operators.skew import salted_join
from textrel.session import checkpointed

#: Opening and closing quotation marks.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("'", "'"), ("‘", "’"))
SEPARATOR = re.compile(r"[  ]*(?:[;,|/&+•\t\r\n]|(?<=[\s\"”'»)])and(?=[\s\"“'«]))[  ]*", re.I)
DASH = re.compile(r"[  ]*[-–—][  ]*")
#: Words that end the name of a firm, and its legal forms.
FIRM_WORDS = "Partners|Capital|Holdings|Ventures|Group|Trust|Club|Company|Entertainment|Investments|Enterprises|Associates"
LEGAL_FORMS = r"LLC|LP|LLP|Inc\.?|Incorporated|Ltd\.?|Limited|Corp\.?|Co\.?"
_NAME = r"[^\W\d_][\w’'.-]*"
FIRM = re.compile(
    rf"(?:{_NAME},[ ]+)*{_NAME}[ ]+(?:&|and)[ ]+{_NAME}(?:[ ]+(?:&|and)?[ ]*{_NAME}){{0,4}}?[ ]+(?:{FIRM_WORDS})\b(?:,?[ ]+(?:{LEGAL_FORMS})(?=\W|$))?"
)
BLANKS = "  \t\r\n"
#: Words and single signs of a text, blanks left out.
TOKEN = re.compile(r"\w+|[^\w\s]")


def _blank(s: str, i: int) -> int:
    while i < len(s) and s[i] in "  ":
        i += 1
    return i


def _remark(s: str, i: int) -> int | None:
    """End of the remark that starts at ``i``; None if it never closes."""
    depth = 0
    for j in range(i, len(s)):
        depth += (s[j] == "(") - (s[j] == ")")
        if not depth:
            return j + 1
    return None


def _separators(s: str, i: int, dash: bool) -> int:
    """End of the separators at ``i`` (``i`` itself if there is none)."""
    while i < len(s):
        m = SEPARATOR.match(s, i) or (DASH.match(s, i) if dash else None)
        if not m or m.end() == i:
            break
        i = m.end()
    return i


def _ends(s: str, i: int, dash: bool, stop: str) -> bool:
    """True if a value may end at ``i``: blanks and remarks, then a separator or the end."""
    i = _blank(s, i)
    while i < len(s) and s[i] == "(":
        j = _remark(s, i)
        if j is None:
            return True
        i = _blank(s, j)
    return i >= len(s) or s[i] == stop or SEPARATOR.match(s, i) is not None or s[i] in "\t\r\n" or dash and DASH.match(s, i) is not None


class Lexicon:
    """Values that stay whole. Lookup is by first word, longest first, letter case and repeated blanks ignored."""

    def __init__(self, values: Iterable[str], dashes: bool = False):
        self.dashes = dashes
        by_first: dict[str, set[str]] = {}
        for v in values:
            v = " ".join(v.split())
            if v:
                by_first.setdefault(re.match(r"\w*", v).group().lower(), set()).add(v)
        self.patterns = {
            k: [re.compile(r"\s+".join(map(re.escape, v.split(" "))), re.I) for v in sorted(vs, key=lambda x: (-len(x), x))] for k, vs in by_first.items()
        }

    def match(self, s: str, i: int, stop: str) -> int | None:
        """End of the longest value that starts at ``i`` and after which a value may end."""
        first = re.compile(r"\w*").match(s, i).group().lower()
        for p in self.patterns.get(first, ()):
            m = p.match(s, i)
            if m and _ends(s, m.end(), self.dashes, stop):
                return m.end()
        return None


def _item(s: str, i: int, lexicon: Lexicon, stop: str) -> tuple[int, list[tuple[str, str]]]:
    """Parse one item at ``i``: where it ends, and its cleaned values with flags."""
    end = lexicon.match(s, i, stop)
    if end is not None:
        return _after(s, end, [(s[i:end], "")], stop)
    flag = ""
    for opening, closing in QUOTES:
        if s[i] != opening:
            continue
        inside = _blank(s, i + 1)
        end = lexicon.match(s, inside, closing) if inside < len(s) else None
        if end is not None and (j := _blank(s, end)) < len(s) and s[j] == closing and _ends(s, j + 1, lexicon.dashes, stop):
            return _after(s, j + 1, [(s[inside:end], "")], stop)
        j = s.find(closing, i + 1)
        while j >= 0:
            if s[j - 1] != "\\" and _ends(s, j + 1, lexicon.dashes, stop):
                return _after(s, j + 1, [(_clean(s[i + 1 : j]), "")], stop)
            j = s.find(closing, j + 1)
        flag = "quote"
    if s[i] == "[":
        j = s.rfind("]")
        if j > i and _ends(s, j + 1, lexicon.dashes, stop):
            return _after(s, j + 1, parse_values(s[i + 1 : j], lexicon), stop)
        flag = "bracket"
    if flag:
        i += 1
        i = _blank(s, i)
    end = lexicon.match(s, i, stop) if i < len(s) else None
    if end is None:
        m = FIRM.match(s, i)
        if m and _ends(s, m.end(), lexicon.dashes, stop):
            end = m.end()
    if end is None:
        end = i
        while end < len(s) and s[end] != stop:
            if s[end] == "(":
                j = _remark(s, end)
                if j is None:
                    flag = flag or "remark"
                    end = len(s)
                    break
                end = j
            elif s[end] in ";,|/&+•\t\r\n" or s[end] in "  " and (m := SEPARATOR.match(s, end)) and m.group().strip(BLANKS):
                break
            else:
                end += 1
        end = max(end, i)
    return _after(s, end, [(_clean(s[i:end]), flag)], stop)


def _after(s: str, i: int, values: list[tuple[str, str]], stop: str) -> tuple[int, list[tuple[str, str]]]:
    """Skip the remarks behind an item."""
    j = _blank(s, i)
    while j < len(s) and s[j] == "(":
        k = _remark(s, j)
        if k is None:
            return len(s), [(v, f or "remark") for v, f in values]
        i, j = k, _blank(s, k)
    return i, values


def _clean(v: str) -> str:
    """Outer blanks, enclosing quotes and remarks removed; other characters stay as written."""
    v = v.strip(BLANKS)
    changed = True
    while changed and v:
        changed = False
        k = v.find("(")
        if k >= 0:
            j = _remark(v, k)
            w = (v[:k].rstrip(BLANKS) + (v[j:] if j else "")).strip(BLANKS)
            changed, v = w != v, w
        for a, b in QUOTES:
            if len(v) > 1 and v[0] == a and v[-1] == b:
                v, changed = v[1:-1].strip(BLANKS), True
    return v.strip("\"“”„«»").strip(BLANKS) if v[:1] in '"“„«' or v[-1:] in '"”»' else v


def parse_values(s: str, lexicon: Lexicon) -> list[tuple[str, str]]:
    """The values of a cell in written order, each with an error flag ('' if it parsed cleanly). Empty places are left out."""
    text = s.strip(BLANKS)
    if text[:1] == "[" and text[-1:] == "]":
        try:
            listed = json.loads(text)
            if isinstance(listed, list) and all(isinstance(x, str) for x in listed):
                return [(c, "") for x in listed if (c := _clean(x))]
        except ValueError:
            pass
    out: list[tuple[str, str]] = []
    i = _separators(text, _blank(text, 0), False)
    while i < len(text):
        end, values = _item(text, i, lexicon, "")
        out.extend((v, f) for v, f in values if v)
        nxt = _separators(text, _blank(text, end), lexicon.dashes)
        if nxt == i:  # nothing could be read here
            nxt = i + 1
        i = nxt
    return out


def run_key(tokens: list[str]) -> str:
    return " ".join(tokens).lower()


def candidate_runs(s: str, lengths: list[int]) -> list[str]:
    """Keys of the runs of tokens of a cell that could be a value of a lexicon whose values have one of ``lengths`` tokens: the runs
    that begin where a value may begin (at the front, or behind a sign or ``and``)."""
    tokens = TOKEN.findall(s)
    starts = [i for i in range(len(tokens)) if not i or not tokens[i - 1][0].isalnum() or tokens[i - 1].lower() == "and"]
    return sorted({run_key(tokens[i : i + n]) for i in starts for n in lengths if i + n <= len(tokens)})


_PARSED = "array<struct<value_pos:int,item_value:string,flag:string>>"
#: A cell without any of these is one bare value and needs no parser.
_SPECIAL = r"[;,|/&+•\t\r\n\[\]()\"“”„«»'‘’–—-]|\sand\s"
#: A value of a lexicon without any of these is read as one value anyway.
_TEARING = r"(?i)[;,|/&+•\t\r\n\[\]()\"“”„«»]|^['‘]|\sand\s"


def _struct(values: list[tuple[str, str]]) -> list[dict]:
    return [{"value_pos": i, "item_value": v, "flag": f} for i, (v, f) in enumerate(values, 1)]


def split_packed(df: DataFrame, cell: str, lexicon: DataFrame | None = None, small_lexicon: list[str] | None = None, dashes: bool = False) -> DataFrame:
    """One row per value of column ``cell``: the columns of ``df`` plus n_values, value_pos, item_value and flag.

    ``lexicon`` is a one-column DataFrame of values that stay whole; it may be of any size. Those that hold signs (the others
    need no help) are looked up by an equi-join: each run of tokens of a distinct cell that begins where a value may begin and is
    as long as one of them is met by its key, so a value of any number of separators is found; only the hits of a cell travel
    with it. ``small_lexicon`` is a list
    for lexicons of a fixed, small size. ``dashes`` lets a dash behind a value of the lexicon separate values.

    Missing cells and cells of separators only give no row. Plain cells (most of them) never leave the JVM. Repeated
    rows stay repeated. Columns of ``df`` with the name of a result column raise ValueError.
    """
    clash = {"value_pos", "item_value", "flag", "n_values", "_cell", "_items", "_known", "_salt"} & set(df.columns)
    if clash:
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    rows = df.where(~is_missing(F.col(cell)))
    plain = F.array(F.struct(F.lit(1).alias("value_pos"), F.regexp_replace(F.col(cell), r"^[ \u00a0]+|[ \u00a0]+$", "").alias("item_value"), F.lit("").alias("flag")))
    simple = rows.where(~F.col(cell).rlike(_SPECIAL)).withColumn("_items", plain.cast(_PARSED))
    packed = rows.where(F.col(cell).rlike(_SPECIAL))
    small = list(small_lexicon or [])

    if lexicon is None:

        @F.pandas_udf(_PARSED)
        def parsed(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shared = Lexicon(small, dashes)
            for s in cells:
                yield s.map(lambda x: _struct(parse_values(x, shared)))

        packed = packed.withColumn("_items", parsed(F.col(cell)))
    else:

        name = lexicon.columns[0]
        values = lexicon.where(~is_missing(F.col(name)) & F.col(name).rlike(_TEARING + (r"|\s[-–—]|[-–—]\s" if dashes else ""))).select(squeezed(F.col(name)).alias("_value")).distinct()

        @F.pandas_udf("struct<key:string,n:int>")
        def keyed(s: pd.Series) -> pd.DataFrame:
            found = [TOKEN.findall(x) for x in s]
            return pd.DataFrame({"key": [run_key(t) for t in found], "n": [len(t) for t in found]})

        known = checkpointed(values.select("_value", keyed("_value").alias("_k")).select("_value", F.col("_k.key").alias("_run"), F.col("_k.n").alias("_n")))
        lengths = sorted(r[0] for r in known.select("_n").distinct().collect() if r[0])  # as many as the values have different lengths

        @F.pandas_udf("array<string>")
        def runs(s: pd.Series) -> pd.Series:
            return s.map(lambda x: candidate_runs(x, lengths))

        @F.pandas_udf(_PARSED)
        def parsed_with(s: pd.Series, known: pd.Series) -> pd.Series:
            shared = Lexicon(small, dashes)
            return pd.Series([_struct(parse_values(x, Lexicon([*small, *k], dashes) if k is not None and len(k) else shared)) for x, k in zip(s, known)], dtype=object)

        cells = packed.select(F.col(cell).alias("_cell")).distinct()
        if lengths:
            spans = cells.select("_cell", F.explode(runs("_cell")).alias("_run"))
            hits = spans.join(known.select("_run", "_value"), "_run").groupBy("_cell").agg(F.collect_set("_value").alias("_known"))
            cells = cells.join(hits, "_cell", "left")
        else:
            cells = cells.withColumn("_known", F.lit(None).cast("array<string>"))
        cells = cells.select("_cell", parsed_with("_cell", "_known").alias("_items"))
        packed = salted_join(packed.withColumn("_cell", F.col(cell)), cells, ["_cell"], df.columns).drop("_cell")
    items = simple.select(*df.columns, "_items").unionByName(packed.select(*df.columns, "_items"))
    return items.withColumn("n_values", F.size("_items")).select(*df.columns, "n_values", F.inline("_items"))
