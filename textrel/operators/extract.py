"""Rule-based extraction of records from text, validation, and identity.

Extraction is an interface: any function from chunks (chunk_id, content) to (chunk_id, records array<map<string,string>>)
can take the place of the rules. The rules are patterns evaluated by Spark itself, so they prune, push down and need no
Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrel.functions.similarity import surface_forms
from textrel.functions.text import MISSING_MARKERS, is_missing, normalized, normalized_for_match
from textrel.operators.chunks import keyword_pattern, word_windows
from textrel.operators.skew import salted_join

Extractor = Callable[[DataFrame], DataFrame]

_NAME = r"[\p{Lu}][\p{L}’'.-]*(?: (?:of |and |& )?[\p{Lu}][\p{L}’'.-]*)*"
#: Patterns with one group, by table and column.
RULES = {
    "player": {
        "name": r"(?:^|\n)\s*(" + _NAME + r") \(born ",
        "birth_date": r"\(born (\p{L}+ \d{1,2}, \d{4})\)",
        "team": r"professional basketball player for the (" + _NAME + r")\.",
        "draft_pick": r"selected with the (\w+) overall pick",
        "draft_year": r"In (\d{4}), [^.]*? was selected with",
        "college": r"studied at (St\. \p{L}+ College)",
        "points": r"averaged (\d+\.\d+) points",
    },
    "team": {"location": r"play their home games in (" + _NAME + r")\.", "arena_seats": r"holds ([\d,]+) people", "attendance": r"drew ([\d,]+) fans that season"},
    "owner": {"stake": r"bought a (\d+(?:\.\d+)?) percent stake", "price": r"stake for (\$[\d.]+ \w+)", "trade": r"through a company in (\p{Ll}+ \p{Ll}+)"},
}


#: A literal that stands in every text a pattern of the table matches.
ANCHORS = {
    "player": ("(born ", "professional basketball player for the ", "selected with ", "studied at St. ", "averaged "),
    "team": ("play their home games in ", " people", "drew "),
    "owner": (" percent stake", "stake for $", "through a company in "),
}


class RuleExtractor:
    """An extractor of at most one record per chunk; columns whose pattern is not found are left out.

    ``columns`` tells what it can find, ``sieve`` which texts may hold any of it (never fewer), and ``verbatim`` that its values
    stand in the text as they are, so they need no check.
    """

    verbatim = True

    def __init__(self, rules: dict[str, str], anchors: tuple[str, ...] = ()):
        self.rules = rules
        self.columns = tuple(rules)
        self.anchors = anchors

    def sieve(self, content: Column) -> Column:
        hit = F.lit(not self.anchors)
        for a in self.anchors:
            hit = hit | F.contains(content, F.lit(a))
        return hit

    def __call__(self, chunks: DataFrame) -> DataFrame:
        values = [(c, F.regexp_extract("content", p, 1)) for c, p in self.rules.items()]
        cells = [F.when(v != "", F.struct(F.lit(c).alias("key"), v.alias("value"))) for c, v in values]
        found = F.map_from_entries(F.filter(F.array(*cells), lambda x: x.isNotNull()))
        return chunks.select("chunk_id", F.filter(F.array(found), lambda m: F.size(m) > 0).alias("records"))


def rule_extractor(rules: dict[str, str], anchors: tuple[str, ...] = ()) -> RuleExtractor:
    return RuleExtractor(rules, anchors)


def grounded_records(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records (chunk_id, records) without the cells that do not stand in their chunk (is_grounded) and without records of none."""
    both = found.join(chunks.select("chunk_id", "content"), "chunk_id")
    kept = F.transform("records", lambda m: F.map_filter(m, lambda _, v: is_grounded(v, F.col("content"))))
    return both.select("chunk_id", F.filter(kept, lambda m: F.size(m) > 0).alias("records"))


def discovered_attributes(chunks: DataFrame, variations: dict[str, list[str]]) -> DataFrame:
    """Attributes that chunks speak of, by the ways their names are written: chunk_id, attribute. ``variations`` is a schema's."""
    found = F.array(*[F.when(F.col("content").rlike(keyword_pattern(v)), F.lit(c)) for c, v in sorted(variations.items())])
    return chunks.select("chunk_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("attribute"))


def balanced_json(text: str) -> str | None:
    """The first balanced JSON array or object in a text that parses; brackets inside strings do not count."""
    i = 0
    while i < len(text):
        if text[i] not in "[{":
            i += 1
            continue
        depth, quoted, j = 0, False, i
        while j < len(text):
            c = text[j]
            if quoted:
                if c == "\\":
                    j += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    break
            j += 1
        found = text[i : j + 1]
        try:
            json.loads(found)
            return found
        except ValueError:
            i += 1
    return None


def repaired_json(text: str) -> str | None:
    """The JSON of a text, mended where it is broken: fences and trailing commas dropped, single quotes, Python's constants and bare
    keys made JSON, an open string and open brackets closed. None where even that does not parse."""
    found = balanced_json(text)
    if found is not None:
        return found
    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    s = re.sub(r"\s*```.*", "", text[start:], flags=re.S)
    if '"' not in s:
        s = re.sub(r"(?<![^\W\d_])'|'(?![^\W\d_])", '"', s)
    s = re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", s)))
    s = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s)
    stack, quoted, i, end = [], False, 0, len(s)
    while i < len(s):
        c = s[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                end = i + 1
                break
        i += 1
    s = s[:end] + ('"' if quoted else "")
    s = re.sub(r"[,:]\s*$", lambda m: "" if m[0][0] == "," else ": null", s) + "".join(reversed(stack))
    s = re.sub(r",(\s*[\]}])", r"\1", s)
    return balanced_json(s)


@F.pandas_udf(T.StringType())
def json_in_text(s: pd.Series) -> pd.Series:
    """repaired_json on a column; null where there is none."""
    return s.map(lambda t: None if t is None else repaired_json(t))


def passage_records(answers: DataFrame, key: str, response: str, columns: list[str] | None = None) -> DataFrame:
    """Records of answers about several passages, ``{"passage_1": [{column: {"value": v, "span": quote} or v}]}``: key, passage
    (from 1), position, record and spans (maps of text). Keys other than ``columns`` are dropped; unreadable answers give no rows."""
    cells = F.from_json(json_in_text(F.col(response)), "map<string,string>")
    rows = answers.select(key, F.explode(cells).alias("_p", "_v")).withColumn("_records", F.from_json("_v", "array<map<string,string>>")).select(key, F.regexp_extract("_p", r"^passage_(\d+)$", 1).try_cast("int").alias("passage"), F.posexplode("_records").alias("position", "_m"))
    rows = rows.where(F.col("passage").isNotNull() & F.col("_m").isNotNull())
    boxed = lambda v: F.startswith(F.trim(v), F.lit("{")) & F.map_contains_key(F.coalesce(F.from_json(v, "map<string,string>"), F.create_map().cast("map<string,string>")), "value")
    known = F.col("_m") if columns is None else F.map_filter("_m", lambda k, _: k.isin(columns))
    record = F.transform_values(known, lambda _, v: cell_value(F.when(boxed(v), F.get_json_object(v, "$.value")).otherwise(v)))
    spans = F.map_filter(F.transform_values(known, lambda _, v: F.when(boxed(v), F.get_json_object(v, "$.span"))), lambda _, v: F.coalesce(v != "", F.lit(False)))
    return rows.select(key, "passage", "position", record.alias("record"), spans.alias("spans"))


def response_records(response: Column, columns: list[str]) -> Column:
    """Records of a model's answer: one object or a list of them, anywhere in the text; keys other than ``columns`` dropped, cells
    normalized. No readable JSON gives null."""
    found = json_in_text(response)
    wrapped = F.when(F.startswith(found, F.lit("{")), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)
    parsed = F.from_json(wrapped, "array<map<string,string>>")
    known = F.transform(parsed, lambda m: F.map_filter(m, lambda k, v: k.isin(columns)))
    return F.when(found.isNotNull(), F.transform(known, lambda m: F.transform_values(m, lambda k, v: cell_value(v))))


def cell_value(c: Column) -> Column:
    """A cell of a record: of a JSON list the first non-blank element; trimmed; null for blanks and missing markers."""
    listed = F.filter(F.from_json(c, "array<string>"), lambda x: F.trim(x) != "")
    v = F.trim(F.when(F.startswith(F.trim(c), F.lit("[")) & listed.isNotNull(), F.get(listed, 0)).otherwise(c))
    return F.when(F.lower(v).isin(*MISSING_MARKERS), F.lit(None)).otherwise(v)


def is_grounded(value: Column, content: Column) -> Column:
    """Whether a value, or for a number one of its usual forms, stands in the text; letter case, commas and blanks are ignored."""
    plain = F.contains(content, value) | F.contains(normalized_for_match(content), normalized_for_match(value))
    return F.coalesce(value.isNotNull() & (plain | F.exists(surface_forms(value), lambda f: F.contains(content, f))), F.lit(False))


def is_valid_identity(value: Column, content: Column) -> Column:
    """An identity is no placeholder, not only digits, and stands in the text."""
    return ~is_missing(value) & ~value.rlike(r"^[\d\s.,]+$") & is_grounded(value, content)


def validated(records: DataFrame, columns: dict[str, str], content: str, identity: str | None = None) -> DataFrame:
    """Cells that do not hold are nulled: numbers must be castable; text needs two letters, no JSON shape, and grounding in the text.
    The identity is exempt."""

    def checked(name: str, kind: str) -> Column:
        v = F.col(name)
        if name == identity:
            return v
        if kind == "number":
            return F.when(F.regexp_replace(F.trim(v), "[,%]", "").try_cast("double").isNotNull(), v)
        return F.when((F.length(F.trim(v)) >= 2) & ~F.trim(v).rlike(r"^[\[{]") & is_grounded(v, F.col(content)), v)

    return records.withColumns({n: checked(n, k) for n, k in columns.items()})


def refined(df: DataFrame, key: str, order: str, values: str, content: str) -> DataFrame:
    """Updates of one record from consecutive parts of a text: per key and attribute the last grounded value in ``order``.

    ``values`` is a map column; result: key, record.
    """
    cells = df.select(key, order, content, F.explode(values).alias("_a", "_v")).where(is_grounded(F.col("_v"), F.col(content)))
    last = cells.groupBy(key, "_a").agg(F.max_by("_v", F.struct(order, "_v")).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_a", "_v")))).alias("record"))


def refined_by_passages(chunks: DataFrame, extractor: Extractor, words: int = 500) -> DataFrame:
    """Records of chunks (chunk_id, content) read in passages of ``words`` words: chunk_id, record, where the last grounded value of
    each column stays."""
    parts = word_windows(chunks, "chunk_id", "content", words).select(F.col("chunk_id").alias("_chunk"), F.col("chunk_index").alias("_no"), "content", F.concat_ws("#", "chunk_id", "chunk_index").alias("chunk_id"))
    found = extractor(parts.select("chunk_id", "content")).select("chunk_id", F.explode("records").alias("_r"))
    return refined(found.join(parts, "chunk_id").select("_chunk", "_no", "_r", "content"), "_chunk", "_no", "_r", "content").withColumnRenamed("_chunk", "chunk_id")


def heading(text: Column) -> Column:
    """The first non-blank line, trimmed."""
    return F.trim(F.regexp_extract(text, r"^\s*([^\n]+)", 1))


#: Leading lines of a summary, sentences after the first and the second ranking, and its characters.
LEAD_LINES, PRESELECTED, SENTENCES, SUMMARY_CHARS = 10, 40, 12, 3500


def summary(text: Column, terms: list[str]) -> Column:
    """What a document says about the terms of a schema: its first LEAD_LINES lines and the SENTENCES most telling sentences, in
    document order, each once, of at most SUMMARY_CHARS characters.

    Sentences are ranked by how many of the terms they hold; the PRESELECTED best again by the terms per length. Without
    terms in any sentence the leading lines remain. Null gives an empty summary.
    """
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(plain, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda x: x != "")
    words = [t.lower() for t in dict.fromkeys(terms) if t]

    def hits(s: Column) -> Column:
        low = F.lower(s)
        out = F.lit(0)
        for w in words:
            out = out + F.contains(low, F.lit(w)).cast("int")
        return out

    scored = F.filter(F.transform(sentences, lambda s, i: F.struct((-hits(s)).alias("a"), i.alias("i"), s.alias("s"))), lambda x: x.a < 0)
    first = F.slice(F.array_sort(scored), 1, PRESELECTED)
    second = F.slice(F.array_sort(F.transform(first, lambda x: F.struct((x.a / F.sqrt(F.length(x.s) + F.lit(40))).alias("b"), x.i.alias("i"), x.s.alias("s")))), 1, SENTENCES)
    chosen = F.transform(F.array_sort(F.transform(second, lambda x: F.struct(x.i.alias("i"), x.s.alias("s")))), lambda x: x.s)
    both = F.concat(F.slice(lines, 1, LEAD_LINES), chosen)
    keys = F.transform(both, lambda s: normalized(s))
    once = F.filter(F.transform(both, lambda s, i: F.when((F.array_position(keys, F.get(keys, i)) == i + 1) & (F.get(keys, i) != ""), s)), lambda s: s.isNotNull())
    return F.substring(F.array_join(once, "\n"), 1, SUMMARY_CHARS)


def table_of(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The table whose vocabulary a text uses most: the one with most different words in it, ties to the first by name, null where no
    word occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def count(words: list[str]) -> Column:
        n = F.lit(0)
        for w in sorted({w.lower() for w in words}):
            n = n + F.contains(low, F.lit(w)).cast("int")
        return n

    found = F.array(*[F.struct((-count(ws)).alias("n"), F.lit(t).alias("t")) for t, ws in sorted(vocabulary.items())])
    best = F.array_min(found)
    return F.when(best.n < 0, best.t)


def document_identity(documents: DataFrame, text: str, most_words: int = 8, vocabulary: dict[str, list[str]] | None = None, table: str = "table_name") -> DataFrame:
    """Adds identity and reject_reason: the heading where it is a valid identity, else null and why not
    (``blank``, ``missing``, ``digits``, ``sentence``, ``too_long``). With a ``vocabulary`` of words by table, documents whose
    summary speaks of another table than ``table`` says are rejected too (``other_table``)."""
    h = heading(F.col(text))
    reason = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "blank")
        .when(is_missing(h), "missing")
        .when(h.rlike(r"^[\d\s.,]+$"), "digits")
        .when(h.rlike(r"[.!?…。！？।]['\"”’»)]*$") & ~h.rlike(r"\b(Jr|Sr)\.$"), "sentence")
        .when(F.size(F.split(h, r"\s+")) > most_words, "too_long")
    )
    if vocabulary:
        spoken = table_of(summary(F.col(text), [w for ws in vocabulary.values() for w in ws]), vocabulary)
        reason = F.coalesce(reason, F.when(spoken != F.col(table), "other_table"))
    return documents.withColumn("reject_reason", reason).withColumn("identity", F.when(F.col("reject_reason").isNull(), h))


_MENTION = r"(\p{Lu}[\p{L}’'-]+(?: \p{Lu}[\p{L}’'-]+)+)"


def chunk_mentions(chunks: DataFrame) -> DataFrame:
    """The name (two or more capitalised words) that a chunk repeats most: chunk_id, mention, n; ties to the smaller. Chunks without
    names have no row."""
    each = chunks.select("chunk_id", F.explode(F.regexp_extract_all("content", F.lit(_MENTION), F.lit(1))).alias("mention"))
    counts = each.groupBy("chunk_id", "mention").agg(F.count("*").alias("n"))
    return counts.groupBy("chunk_id").agg(F.min_by(F.struct("mention", "n"), F.struct(-F.col("n"), "mention")).alias("_m")).select("chunk_id", "_m.mention", "_m.n")


#: Words that tell the kind of a name, and the kinds an identity may be of.
NAME_KINDS = {"ORG": "Club|Team|College|University|Company|Group|Partners|Holdings|Association|League|Inc|LLC", "GPE": "City|County|State|Republic|Kingdom|Province"}
IDENTITY_TYPES = ("PERSON", "ORG", "GPE")


def dominant_kind(chunks: DataFrame) -> DataFrame:
    """How many chunks repeat a name of each kind most: semantic_type, n. A name with a word of an organisation or a place is one,
    others are persons."""
    m = chunk_mentions(chunks)
    kind = F.lit("PERSON")
    for t, words in NAME_KINDS.items():
        kind = F.when(F.col("mention").rlike(rf"\b(?:{words})\b"), t).otherwise(kind)
    return m.groupBy(kind.alias("semantic_type")).agg(F.count("*").alias("n"))


def identity_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """How well each column would identify rows: column_name, filled, distinct_share, numeric_share, mean_length, score.

    The score multiplies the filled share, the distinct share and the share that is no number, halved for values of fewer
    than three or more than 60 characters on average.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    v = F.when(~is_missing(F.col("value")), F.col("value"))
    s = long.groupBy("column_name").agg(
        F.avg(v.isNotNull().cast("int")).alias("filled"),
        F.try_divide(F.count_distinct(v), F.count(v)).alias("distinct_share"),
        F.avg(F.when(v.isNotNull(), v.try_cast("double").isNotNull().cast("int"))).alias("numeric_share"),
        F.avg(F.length(v)).alias("mean_length"),
    )
    fair = F.when(F.col("mean_length").between(3, 60), 1.0).otherwise(0.5)
    return s.withColumn("score", F.coalesce(F.col("filled") * F.col("distinct_share") * (1 - F.col("numeric_share")) * fair, F.lit(0.0)))


def grouped_by_entity(chunks: DataFrame, identities: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(assigned, unassigned): chunks with the entity of their document, and those whose document has none, with a null entity.
    ``identities`` has doc (unique) and identity."""
    both = salted_join(chunks, identities.select(doc, "identity"), [doc], [c for c in chunks.columns if c != doc][:1], "left")
    return both.where(F.col("identity").isNotNull()), both.where(F.col("identity").isNull())


def dominant_type(votes: DataFrame, key: str, label: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """The most frequent label of each key if it has at least ``least`` votes and ``share`` of them: key, label, n, share."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max_by(F.struct(label, "n"), F.struct("n", label)).alias("_t"), F.sum("n").alias("_all"))
    return top.select(key, F.col(f"_t.{label}").alias(label), F.col("_t.n").alias("n"), (F.col("_t.n") / F.col("_all")).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))
