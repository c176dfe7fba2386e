"""Sentence boundaries in many languages, after statistics learned from the documents themselves.

Learning (unsupervised, per language, over all documents; after Kiss and Strunk, 2006):
- abbreviations: word types whose occurrences with a period are too many for chance, by Dunning's log-likelihood ratio,
  weighed by length and inner periods;
- sentence starters: words that follow a sentence end far more often than chance (log-likelihood ratio) and are rare
  elsewhere in that letter case;
- collocations: words that follow the period of an abbreviation, initial or number type more often than other periods,
  by the same log-likelihood ratio, and hardly ever begin a sentence behind an ordinary word; the period between the two
  does not end a sentence;
- ends: for each of these types, the share of sentence starters behind its period, against the share behind ordinary
  words, tells whether it also ends sentences;
- sentence enders: words most of whose occurrences stand before a period;
- headings: whole lines that repeat;
- for Thai, which ends sentences with a blank only: beginnings and ends of chunks, by how often they stand at the
  beginning and end of a line against beside a blank.
What is kept makes up at least MIN_SHARE of its kind in its language, so the model has at most 1 / MIN_SHARE entries per
kind and language, whatever the number of documents.

Segmenting: headings and list lines are units; quotations and brackets are read as one (their inner ends do not count);
each remaining period, mark or line break is classified with these statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrel.session import checkpointed

MIN_SHARE = 1e-4
MIN_COUNT = 3
ABBREVIATION, STARTER, COLLOCATION = 0.3, 15.0, 7.88
#: Share of starters behind a type's period, relative to ordinary words, from which the period ends the sentence.
ENDS = 0.5
#: Frequent short words by which a language in Latin script is told.
FUNCTION_WORDS = {
    "en": (" the ", " of ", " was "), "es": (" el ", " del ", " por "), "de": (" der ", " die ", " das "), "fr": (" le ", " les ", " à "), "tr": (" bir ", " olup ", "ında "), "lt": (" ir ", " mieste ", " kad "),
    "pt": (" não ", " uma "), "it": (" della ", " che "),
}
SCRIPTS = {"th": "ก-๛", "ja": "ぁ-ヿ", "zh": "一-鿿", "ko": "가-힣", "ar": "ء-ۿ", "hi": "ऄ-ॿ", "el": "Ά-Ͽ", "sr": "Ѐ-ӿ"}
_SCRIPT = {name: re.compile(f"[{span}]") for name, span in SCRIPTS.items()}
_NOT_LATIN = re.compile(f"[{''.join(SCRIPTS.values())}]")
_LIST = re.compile(r"(?:[-*•‣·–—]|\(?\d{1,3}[.)]|\(?[a-z]\))[ \t]+\S")
#: Opening marks with their closing marks, and marks that may not stand between them.
QUOTES = (("„", "“”", "„"), ("“", "”", "“"), ("«", "»", "«"), ("「", "」", "「"), ("『", "』", "『"), ('"', '"', ""))
_PAIRS = {a: (re.compile(f"[{b}{c}]"), b) for a, b, c in (*QUOTES, ("(", ")", "("), ("（", "）", "（"))}
_CLOSERS = "\"”’»)]」』）“"
_EDGE = "\"“”„«»‘’'()[]¿¡「」『』（）,;:–—-"
_MARKS = "".join(q[0] for q in QUOTES) + "(（.!?…。！？｡।॥؟;\\n"
_EVENT = re.compile(f"[{_MARKS}]")
_EVENT_TH = re.compile(f"[{_MARKS} ]")
_RUN = re.compile(r"[.!?…。！？｡।॥؟;]+[\"”’»)\]」』）]*")
_THAI = re.compile("[ก-๛]")
_TERMINAL = ".!?…。！？｡।॥؟;"
_WIDE = "。！？｡।॥"
_CASELESS = re.compile("[֐-ࣿऀ-໿ᄀ-ᇿ぀-鿿가-힣]")
CHUNK = 4  # characters of the beginnings and ends of Thai chunks


def language(text: str, declared: str | None = None) -> str:
    """Language by script (the one of most letters) or by function words; '' if neither tells. A declared language is taken
    if its own script or function words bear it out, which spares the look at the others."""
    d = declared.strip().lower() if declared else ""
    if d in FUNCTION_WORDS:
        if sum(map(text.count, FUNCTION_WORDS[d])) * 120 > len(text):
            return d
    elif d in SCRIPTS and not (d == "zh" and _SCRIPT["ja"].search(text)) and len(_SCRIPT[d].findall(text)) * 3 > len(text):
        return d
    most = 0
    if not text.isascii() and (first := _NOT_LATIN.search(text)):
        names = [n for n, p in _SCRIPT.items() if p.match(first.group()) or p.search(text, first.end())]
        counts = {n: len(_SCRIPT[n].findall(text)) for n in names}
        if "ja" in counts and "zh" in counts:
            counts["ja"] += counts.pop("zh") if counts["ja"] * 6 > counts["zh"] else 0
        best = max(counts, key=counts.get)
        most = counts[best]
        if most * 3 > len(text):
            return best
    if text.count(" the ") * 150 > len(text):
        return "en"
    votes = {k: sum(map(text.count, words)) for k, words in FUNCTION_WORDS.items()}
    top = max(votes, key=votes.get)
    if votes[top]:
        return top
    return best if most else ""


def word_type(word: str) -> str:
    """The type of a word before a period: lower case without edges; numbers by their number of digits."""
    w = word.strip(_EDGE)
    if w[:1].isdigit():
        return f"##{min(len(w), 5)}" if w.isdigit() else "##n"
    return w.lower()


def _parted(counts: Counter, raw: dict[str, Counter]) -> Iterator[tuple[str, str, str, int]]:
    """Rows of counts; words that end with a period count as words, and as types before a period."""
    for (lang, kind, item), n in counts.items():
        yield lang, kind, item, n
    for lang, words in raw.items():
        for w, n in words.items():
            item = w.strip(_EDGE).rstrip("!?…")
            word = item.rstrip(".")
            if 0 < len(word) < 40:
                yield lang, "w", word, n
                if item[-1] == "." and not item.endswith("..") and (t := word_type(word)) and len(t) <= 24:
                    yield lang, "p", t, n


def _lines(text: str) -> list[str]:
    return [s for x in text.split("\n") if (s := x.strip())]


def _count(text: str, lang: str, out: Counter, raw: dict[str, Counter]) -> None:
    """Add the counts of a text: words as they stand to ``raw`` by language, everything else to ``out``."""
    words = text.split()
    raw.setdefault(lang, Counter()).update(words)
    for a, b in [(a, b) for a, b in zip(words, words[1:]) if a[-1] in ".!?؟।॥"]:
        nxt = b.strip(_EDGE).rstrip(".!?…")
        follows = nxt and not nxt[0].islower() and len(nxt) < 40
        if a[-1] != ".":
            if follows and not nxt[0].isdigit():
                out[lang, "s", nxt] += 1
        elif follows and not a.endswith(".."):
            t = word_type(a[:-1])
            if t and len(t) <= 24:
                if len(t) <= 8 or "." in t or t[0] == "#":
                    out[lang, "f", f"{t}\t{nxt}"] += 1
                if len(t) > 3 and "." not in t and t[0] != "#" and not nxt[0].isdigit():
                    out[lang, "s", nxt] += 1
    for line in _lines(text):
        if len(line) <= 60 and line[-1] not in _TERMINAL and line[-1] not in ",;:" + _CLOSERS and not _LIST.match(line):
            out["", "h", line] += 1
    if _THAI.search(text):
        for line in _lines(text):
            if not _THAI.search(line):
                continue
            chunks = line.split(" ")
            out["th", "ls", chunks[0][:CHUNK]] += 1
            out["th", "le", chunks[-1][-CHUNK:]] += 1
            for a, b in zip(chunks, chunks[1:]):
                if a and b:
                    out["th", "bs", b[:CHUNK]] += 1
                    out["th", "be", a[-CHUNK:]] += 1


class Model:
    """What was learned. ends: (language, type) -> relative share of starters behind its period, for abbreviations,
    initials and numbers; collocations: set of (language, type, word behind its period); starters, openers (words that begin sentences now and
    then), enders: sets of (language, word); headings: set of lines; thai: log odds."""

    def __init__(self):
        self.ends: dict[tuple[str, str], float] = {}
        self.collocations: set[tuple[str, str, str]] = set()
        self.starters: set[tuple[str, str]] = set()
        self.openers: set[tuple[str, str]] = set()
        self.enders: set[tuple[str, str]] = set()
        self.headings: set[str] = set()
        self.thai_start: dict[str, float] = {}
        self.thai_end: dict[str, float] = {}


def _log_likelihood(k: float, n: float, p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return k * log(p) + (n - k) * log(1 - p)


def collocation(a: float, b: float, ab: float, n: float) -> float:
    """Log-likelihood ratio of two events that occur a and b times, together ab times, among n."""
    p, p1, p2 = b / n, ab / a, (b - ab) / max(n - a, 1.0)
    return -2 * (_log_likelihood(ab, a, p) + _log_likelihood(b - ab, n - a, p) - _log_likelihood(ab, a, p1) - _log_likelihood(b - ab, n - a, p2))


def abbreviation(word: str, n_with: float, n_all: float, n_periods: float, n_words: float) -> float:
    """How much a type looks like an abbreviation: log-likelihood ratio of its periods, weighed by length, inner periods and
    occurrences without one."""
    without = n_all - n_with
    p = min(n_periods / n_words, 0.98)
    ratio = -2 * (n_with * log(p) + without * log(1 - p) - n_with * log(0.99) - without * log(0.01))
    dots = word.count(".")
    letters = len(word) - dots
    return ratio * exp(-letters) * (dots + 1) * letters ** -min(without, 300.0) if letters else 0.0


def learn(documents: DataFrame, column: str = "text", lang: str | None = None) -> Model:
    """Learn from all texts of a column; ``lang`` names a column of declared languages, which may be wrong or null. Null and empty
    texts teach nothing; no texts give an empty model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(list(_parted(counts, raw)), columns=["lang", "kind", "item", "n"])
            counts.clear()
            raw.clear()
            return rows

        counts: Counter = Counter()
        raw: dict[str, Counter] = {}
        for b in batches:
            for t, d in zip(b["t"], b["d"]):
                if t:
                    _count(t, language(t, d), counts, raw)
            if len(counts) + sum(map(len, raw.values())) > 500_000:
                yield flush()
        yield flush()

    raw = documents.select(F.col(column).alias("t"), _declared(lang).alias("d")).where(F.col("t").isNotNull()).mapInPandas(count, "lang string, kind string, item string, n long")
    totals = checkpointed(raw.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    size = {(r[0], r[1]): float(r[2]) for r in totals.where("kind <> 'h'").groupBy("lang", "kind").agg(F.sum("n")).collect()}  # a row per language and kind
    sizes = F.broadcast(totals.sparkSession.createDataFrame([(*k, v) for k, v in size.items()] or [("", "", 0.0)], "lang string, kind string, size double"))
    kept = totals.join(sizes, ["lang", "kind"]).where((F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * F.col("size")))
    periods = kept.where("kind = 'p'").select("lang", "item", F.col("n").alias("n_with"))
    words = totals.where("kind = 'w'")
    lower = words.groupBy("lang", F.lower("item").alias("item")).agg(F.sum("n").alias("n_all"))
    typed = periods.join(lower, ["lang", "item"], "left").collect()  # at most 1 / MIN_SHARE a language, as are the next
    started = kept.where("kind = 's'").select("lang", "item", F.col("n").alias("n_start")).join(words.select("lang", "item", F.col("n").alias("n_word")), ["lang", "item"]).collect()
    model = Model()
    types = []
    for r in typed:
        n_periods, n_words = size[r["lang"], "p"], size.get((r["lang"], "w"), 1.0)
        n_all = float(max(r["n_all"] or 0, r["n_with"]))
        if len(r["item"]) == 1 or r["item"].startswith("##") or abbreviation(r["item"], r["n_with"], n_all, n_periods, n_words) >= ABBREVIATION:
            types.append((r["lang"], r["item"]))
        if r["n_with"] >= 0.5 * n_all and not r["item"].startswith("##"):
            model.enders.add((r["lang"], r["item"]))
    short = set(types)
    usual: dict[str, float] = {}
    for r in started:
        lang, word, n, n_word = r["lang"], r["item"], r["n_start"], max(r["n_word"], r["n_start"])
        if n >= 0.05 * n_word:
            model.openers.add((lang, word))
        if n < 0.4 * n_word or (lang, word.lower()) in short:  # titles follow titles
            continue
        if collocation(float(n_word), size[lang, "s"], float(n), max(size.get((lang, "w"), 1.0), n_word + 1.0)) >= STARTER:
            model.starters.add((lang, word))
            usual[lang] = usual.get(lang, 0.0) + n / size[lang, "s"]
    make = totals.sparkSession.createDataFrame
    known = F.broadcast(make(types or [("", "")], "lang string, item string"))
    starts = F.broadcast(make([(*k, 1) for k in model.starters] or [("", "", 1)], "lang string, word string, is_start int"))
    f = totals.where("kind = 'f'").select("lang", F.split_part("item", F.lit("\t"), F.lit(1)).alias("item"), F.split_part("item", F.lit("\t"), F.lit(2)).alias("word"), "n")
    behind = f.join(known, ["lang", "item"], "left_semi").join(starts, ["lang", "word"], "left").groupBy("lang", "item").agg(F.sum(F.col("n") * F.coalesce("is_start", F.lit(0))).alias("starts"), F.sum("n").alias("n")).collect()
    model.ends = {k: None for k in types}
    for r in behind:
        if r["n"] >= MIN_COUNT:
            model.ends[r["lang"], r["item"]] = r["starts"] / r["n"] / max(usual.get(r["lang"], 1.0), 0.05)
    behind_type = {(r["lang"], r["item"]): r["n"] for r in behind}
    parts = [F.split_part("item", F.lit("\t"), F.lit(k)).alias(c) for k, c in ((1, "item"), (2, "word"))]
    pairs = kept.where("kind = 'f'").select("lang", *parts, F.col("n").alias("n_both")).join(known, ["lang", "item"], "left_semi")
    begun = totals.where("kind = 's'").select("lang", F.col("item").alias("word"), F.lit(0).alias("n"), F.col("n").alias("begins"))
    behind_any = f.select("lang", "word", "n", F.lit(0).alias("begins")).unionByName(begun).groupBy("lang", "word").agg(F.sum("n").alias("n_word"), F.sum("begins").alias("n_begins"))
    for r in behind_any.join(F.broadcast(pairs), ["lang", "word"]).collect():  # at most 1 / MIN_SHARE a language
        lang, a, b, both, n = r["lang"], behind_type[r["lang"], r["item"]], r["n_word"], r["n_both"], size[r["lang"], "f"]
        if r["n_begins"] < 0.05 * b and both * n > a * b and collocation(float(a), float(b), float(both), n) >= COLLOCATION:
            model.collocations.add((lang, r["item"], r["word"]))
    n_lines = totals.where("kind = 'h'").agg(F.sum("n")).first()[0] or 0
    model.headings = {r[0] for r in totals.where((F.col("kind") == "h") & (F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * n_lines)).select("item").collect()}
    for (_, t), share in list(model.ends.items()):  # for texts whose language is not told
        old = model.ends.get(("", t), 9.0)
        model.ends["", t] = share if old == 9.0 else old if share is None else share if old is None else min(old, share)
    model.collocations |= {("", t, w) for _, t, w in model.collocations}
    model.starters |= {("", w) for _, w in model.starters}
    model.openers |= {("", w) for _, w in model.openers}
    model.enders |= {("", w) for _, w in model.enders}
    thai: dict[str, dict[str, int]] = {k: {r["item"]: r["n"] for r in kept.where((F.col("lang") == "th") & (F.col("kind") == k)).collect()} for k in ("ls", "bs", "le", "be")} if ("th", "ls") in size else {}
    for target, at_line, at_blank in ((model.thai_start, "ls", "bs"), (model.thai_end, "le", "be")) if thai else ():
        overall = 0.4 * size["th", at_line] / max(1.0, size.get(("th", at_blank), 1.0))
        for item in {*thai[at_line], *thai[at_blank]}:
            odds = log((thai[at_line].get(item, 0) + overall) / (thai[at_blank].get(item, 0) + 1.0) / overall)
            target[item] = max(-4.0, min(4.0, odds))
    return model


def _next_letter(text: str, i: int, stop: int) -> tuple[int, str]:
    """Place and character of the next letter or digit at or behind ``i``, past blanks, quotes, brackets and dashes."""
    while i < stop:
        c = text[i]
        if c.isalnum():
            return i, c
        if not (c.isspace() or c in _EDGE or c in _TERMINAL):
            return i, c
        i += 1
    return stop, ""


def _word_at(text: str, i: int) -> str:
    j = i
    n = min(len(text), i + 40)
    while j < n and not text[j].isspace():
        j += 1
    return text[i:j].strip(_EDGE).rstrip(".!?…")


class Segmenter:
    def __init__(self, model: Model):
        self.model = model
        self.thai = False  # whether the text at hand has Thai letters
        self.plain: set[tuple[str, str]] = set()  # types that end a sentence wherever their period stands

    def _period(self, text: str, lang: str, begin: int, p: int, at: int, c: str) -> bool:
        """Whether the single period at ``p`` ends the sentence that began at ``begin``; ``at``, ``c``: the next letter."""
        m = self.model
        before = text[max(begin, p - 26) : p].split()
        word = before[-1] if before else ""
        if not word.strip(_EDGE):
            return True
        t = word_type(word)
        if (lang, t) in self.plain:
            return True
        asked = (lang, t)
        known = asked in m.ends
        if not known and lang and len(t) <= 5 and (m.ends.get(("", t)) or 1.0) < ENDS and ("", t) in m.ends and t[0] != "#":
            known, lang = True, ""  # a short form of another language of these documents
        single = len(t) == 1 and t.isalpha()
        if not known and not single and not ("." in t and t[0] != "#" and len(t) <= 6):
            if len(self.plain) < 100_000:
                self.plain.add(asked)
            return True
        if known and (lang, t, _word_at(text, at)) in m.collocations:
            return False
        share = m.ends.get((lang, t))
        so_far = text[begin:p].split(None, 3)
        if len(so_far) == 1 and len(t) <= 5 and t[0] != "#":
            return False  # no sentence is a short form alone
        if len(so_far) <= 2 and ("", t) in m.ends:
            share = m.ends["", t]  # least of all languages: a sentence this short is unlikely
        starter = (lang, _word_at(text, at)) in m.starters
        if c.isdigit() and not (t[0] == "#"):
            return bool(share and share >= ENDS and not single and t not in ("no", "nr", "p", "pp"))
        if share is None:
            return starter and (not single or word.strip(_EDGE).islower())
        if share >= ENDS:
            return True
        return starter and share >= 0.1

    def spans(self, text: str, declared: str | None = None) -> list[tuple[int, int]]:
        """Units of a text as (start, end), end exclusive, in order; all that is not blank is in exactly one."""
        lang = language(text, declared)
        m = self.model
        self.thai = lang == "th" or not text.isascii() and _THAI.search(text) is not None
        units: list[tuple[int, int]] = []

        def add(a: int, b: int) -> None:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                units.append((a, b))

        # Lines, and the blocks of running text between headings, list lines and blank lines.
        pos, block, seen, fresh = 0, None, False, True
        lines = text.split("\n")
        places = []
        for line in lines:
            places.append((pos, pos + len(line), line.strip()))
            pos += len(line) + 1
        for k, (a, b, s) in enumerate(places):
            if not s:
                if block is not None:
                    self._block(text, lang, block, a, add)
                    block = None
                fresh = True
                continue
            if _LIST.match(s) and (fresh or len(s) < 120) and not (s[0].isdigit() and not fresh):
                if block is not None:
                    self._block(text, lang, block, a, add)
                    block = None
                add(a, b)
                seen, fresh = True, True
                continue
            plain = s[-1] not in _TERMINAL and s[-1] not in ",;:" + _CLOSERS
            if fresh and (plain or not seen and s.endswith(("Jr.", "Sr.")) and len(s.split()) <= 5) and len(s) <= 80:
                after = places[k + 1][2] if k + 1 < len(places) else ""
                lowers = not after or not after[0].islower()
                titled = all(not w[0].islower() or w in ("de", "of", "and", "von", "van", "da", "du", "la", "y") for w in s.split())
                if after and lowers and (s in m.headings or not seen and titled and len(s.split()) <= 8) and not (self.thai and _THAI.search(s)):
                    if block is not None:
                        self._block(text, lang, block, a, add)
                        block = None
                    add(a, b)
                    seen = True
                    continue
            if block is None:
                block = a
            seen = True
            fresh = s[-1] in _TERMINAL or s[-1] in _CLOSERS
        if block is not None:
            self._block(text, lang, block, len(text), add)
        return units

    def _block(self, text: str, lang: str, a: int, b: int, add) -> None:
        """Sentences of running text without blank lines."""
        m = self.model
        begin = a
        while b > a and text[b - 1].isspace():
            b -= 1
        find = (_EVENT_TH if self.thai else _EVENT).search
        i = a
        while e := find(text, i, b):
            i = e.start()
            c0 = text[i]
            kind, j = "t", i + 1
            if c0 == ".":
                nxt = text[j] if j < b else " "
                if nxt.isalnum() and (not nxt.isupper() and nxt < "֐" or not text[i - 1].islower()):
                    i = j  # inside a number, a short form or an address
                    continue
                j = _RUN.match(text, i, b).end()
            elif c0 == "\n":
                kind = "n"
            elif c0 == " ":
                while j < b and text[j] == " ":
                    j += 1
                if j >= b or not (_THAI.match(text[j]) or text[j] == '"' and _THAI.match(text[i - 1])) or not (_THAI.match(text[i - 1]) or text[i - 1].isdigit() or text[i - 1] in '".%'):
                    i = j
                    continue
                kind = "s"
            elif c0 in _PAIRS:
                pattern, closing = _PAIRS[c0]
                close = pattern.search(text, i + 1, b)
                if not close or close.group() not in closing:
                    i += 1
                    continue
                kind, j = "q", close.end()
            elif c0 == ";":
                if not "Ͱ" <= text[i - 1] <= "Ͽ" and text[i - 1] != "»":
                    i += 1
                    continue
                kind = "g"
            else:
                j = _RUN.match(text, i, b).end()
            if j >= b:
                break
            cut = self._cut(text, lang, a, b, begin, kind, i, j)
            if cut is not None and cut > begin:
                add(begin, cut)
                begin = cut
            i = j
        add(begin, b)

    def _cut(self, text: str, lang: str, a: int, b: int, begin: int, kind: str, i: int, j: int) -> int | None:
        """Where the sentence that began at ``begin`` ends, if it does at the event text[i:j]: a quotation (q), a mark (t),
        a Greek question mark (g), a blank beside Thai (s), a line break (n)."""
        m = self.model
        if kind == "q":
            inner = text[j - 2]
            if inner not in _TERMINAL:
                return None
            nxt = text[j]
            k = j
            while k < b and text[k] in " \n":
                k += 1
            if text[k] in ",،、;:，；：–—-.!?。" or text[i] in "(（":
                if text[i] not in "(（" or text[begin:i].strip():
                    return None
            at, c = _next_letter(text, j, b)
            if c.islower():
                return None
            lead = text[begin:i].rstrip()
            if _CASELESS.match(c):
                if not lead.endswith((":", "：")):
                    return None
            elif not nxt.isspace() and nxt.isalnum():
                return None
            cut = j
        elif kind == "t":
            mark = text[i:j].rstrip(_CLOSERS)
            wide = any(x in _WIDE for x in mark)
            if wide:
                if text[j] in "，、；：,":
                    return None
                cut = j
            else:
                at, c = _next_letter(text, j, b)
                if not c or c.islower():
                    return None
                joined = not text[j].isspace()
                if joined:
                    if text[j - 1] == '"' and j - 1 > i and text[j].isalnum():
                        j -= 1  # it opens the next quotation
                    if mark != "." and mark[-1] in "!?؟" and (c.isupper() or _CASELESS.match(c)) or mark == "." and (c.isupper() or _CASELESS.match(c)) and text[i - 1].islower() and (text[max(a, i - 2)].islower() or (lang, _word_at(text, at)) in m.openers):
                        if "-" == text[j] or text[j] in "’'/@_":
                            return None
                    else:
                        return None
                elif text[j:at].strip() and text[j:at].strip()[0] in ",;،،":
                    return None
                if mark == ".":
                    if _THAI.match(text[i - 1]) and text[j] != "\n":
                        return None
                    if not self._period(text, lang, begin, i, at, c):
                        return None
                elif mark[-1] == "…" or mark.endswith(".."):
                    if _CASELESS.match(c) and (lang, _word_at(text, at)) not in m.starters:
                        return None
                cut = j
        elif kind == "g":
            at, c = _next_letter(text, j, b)
            if not c or c.islower() or not text[j].isspace():
                return None
            cut = j
        elif kind == "s":
            if not self._thai(text, a, b, i, j, 0.0):
                return None
            cut = i
        else:  # a line break without a mark before it
            k = i
            while k > begin and text[k - 1] in " \t":
                k -= 1
            if k <= begin:
                return None
            if text[k - 1] in _TERMINAL or text[k - 1] in _CLOSERS:
                return None
            if text[k - 1] in ",;:，、；：–—-(":
                return None
            n = j
            while n < b and text[n] in " \t":
                n += 1
            if _THAI.match(text[k - 1]) or _THAI.match(text[n]):
                if not self._thai(text, a, b, k, n, 1.0):
                    return None
            else:
                at, c = _next_letter(text, n, b)
                if c.islower():
                    return None
                last = text[max(begin, k - 40) : k].split()[-1].strip(_EDGE)
                ender = (lang, last.lower()) in m.enders
                starter = (lang, _word_at(text, at)) in m.starters
                opener = (lang, _word_at(text, at)) in m.openers or _CASELESS.match(c)
                if not (starter or ender and opener and not c.isdigit()):
                    return None
            cut = k
        return cut

    def _thai(self, text: str, a: int, b: int, i: int, j: int, bonus: float) -> bool:
        """Whether the blank text[i:j] beside Thai text parts sentences."""
        m = self.model
        s = text.rfind(" ", max(a, i - 40), i) + 1
        left = text[max(a, s, i - CHUNK) : i].split("\n")[-1]
        e = j
        while e < min(b, j + CHUNK) and not text[e].isspace():
            e += 1
        return m.thai_end.get(left, 0.0) + m.thai_start.get(text[j:e], 0.0) + bonus > 0


def _declared(lang: str | None):
    return F.lit(None).cast("string") if lang is None else F.col(lang)


def sentence_units(documents: DataFrame, model: Model, key: str = "doc_id", column: str = "text", lang: str | None = None) -> DataFrame:
    """One row per sentence: key, sent_no (from 1), sent_start, sent_end (code points, end exclusive).

    Null and blank texts have no sentences. Repeated rows stay repeated. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(shared.value)
        for b in batches:
            units = [segmenter.spans(t, d) if t else [] for t, d in zip(b["_t"], b["_d"])]
            counts = [len(u) for u in units]
            flat = np.array([x for u in units for p in u for x in p], dtype=np.int64).reshape(-1, 2)
            numbers = np.concatenate([np.arange(1, n + 1) for n in counts]) if counts else np.zeros(0)
            yield pd.DataFrame({key: b[key].repeat(counts).to_numpy(), "sent_no": numbers.astype(np.int32), "sent_start": flat[:, 0], "sent_end": flat[:, 1]})

    kind = dict(documents.dtypes)[key]
    rows = documents.where(F.col(column).isNotNull()).select(F.col(key), F.col(column).alias("_t"), _declared(lang).alias("_d"))
    return rows.mapInPandas(cut, f"`{key}` {kind}, sent_no int, sent_start long, sent_end long")
