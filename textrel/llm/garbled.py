"""Text decoded with the wrong character encoding.

1. A reference corpus is counted once: adjacent character pairs (letter case folded) that hold a character beyond ASCII,
   in a table of fixed size, and single characters. The counts give each pair its pointwise mutual information,
   shrunken towards independence, so that a pair the corpus never has scores ``log(PRIOR / (N + PRIOR))``.
2. In a value, pairs are scored by ``-information - CUT``; the maximal-scoring segments (Ruzzo and Tompa, 1999) are the
   improbable runs.
3. Only inside those runs, inverse mappings are tried: the run is encoded with a legacy encoding and decoded as UTF-8,
   again for text garbled twice and for garbled text that changed its letter case since; or, where one single-byte
   encoding was taken for another, decoded with that other one. A mapping is accepted if it raises the information of the pairs by
   MIN_GAIN (MIN_GAIN_SINGLE for the second kind).
4. Replacement characters and C1 controls in a run are damage in any case; what they stood for cannot be known.

Letters that became question marks were lost when text was encoded for a set that lacks them, not by decoding; find_lost_marks
reports those on their own.

The reference should be clean; pairs inside damage would support each other otherwise. The tables sent to the workers
are 2**PAIR_BITS + 2**CHAR_BITS numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS, CHAR_BITS = 20, 17
#: Pseudo-count that pulls pairs towards independence, and the information below which a pair is improbable (nats).
PRIOR, CUT = 1000.0, -2.0
MIN_GAIN, MIN_GAIN_SINGLE = 4.0, 18.0
#: Score of a pair of two ASCII characters: neutral, and low enough to part runs that are some characters away.
ASCII_SCORE = -3.0
#: Characters handled at a time, which bounds the memory of a worker.
SLICE = 1_000_000
#: Encodings that UTF-8 is taken for, by how common that is.
TAKEN_FOR_UTF8 = ("cp1252", "latin-1", "cp1254", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp1253", "cp1257", "cp866", "iso8859-2", "gbk", "big5", "euc_kr", "shift_jis")
#: Single-byte encodings taken for one another, as (read with, meant).
SINGLE = (
    ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("cp1253", "cp1252"),
    ("cp1252", "cp1254"), ("cp1252", "cp1250"), ("cp1252", "cp1257"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1250"), ("mac_roman", "cp1250"), ("mac_roman", "cp1254"), ("mac_roman", "cp1257"), ("cp437", "cp1250"), ("cp437", "cp1254"),
)
_LOST = re.compile("[�\x80-\x9f]")
_FOLD = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000 and len(_l := chr(_c).lower()) == 1 and ord(_l) < 1 << 16:
        _FOLD[_c] = ord(_l)


def _codes(text: str) -> np.ndarray:
    """Case-folded code points."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = a < (1 << 16)
    return np.where(low, _FOLD[a & 0xFFFF], a)


def _pair_cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - PAIR_BITS - 8)).astype(np.int64) & ((1 << PAIR_BITS) - 1)


def _char_cells(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint32((1 << CHAR_BITS) - 1)).astype(np.int64)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about SLICE characters together, with the place of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= SLICE:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class PairModel:
    """Information of character pairs: counts of pairs, of characters, and of all pairs."""

    pairs: np.ndarray
    chars: np.ndarray
    total: float

    def information(self, codes: np.ndarray) -> np.ndarray:
        """Shrunken pointwise mutual information of each adjacent pair; pairs of two ASCII characters get nan."""
        left, right = codes[:-1], codes[1:]
        out = np.full(len(left), np.nan, dtype=np.float32)
        at = np.nonzero((left > 127) | (right > 127))[0]
        if len(at):
            a, b = left[at], right[at]
            n = self.total + PRIOR
            expected = (self.chars[_char_cells(a)] + 1.0) * (self.chars[_char_cells(b)] + 1.0) / n
            out[at] = np.log((self.pairs[_pair_cells(a, b)] + PRIOR / n * expected) / expected)
        return out

    def value(self, text: str) -> float:
        """Sum of the information of the pairs beyond ASCII in ``text``."""
        if len(text) < 2:
            return 0.0
        return float(np.nansum(self.information(_codes(text))))


def pair_counts(corpus: DataFrame, column: str) -> PairModel:
    """Count the pairs and characters of a text column over all its rows. Null and empty texts count nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(1 << PAIR_BITS, dtype=np.int64)
        chars = np.zeros(1 << CHAR_BITS, dtype=np.int64)
        for b in batches:
            for _, texts in _slices([t for t in b["t"] if t]):
                codes = _codes("\n".join(texts))
                chars += np.bincount(_char_cells(codes), minlength=1 << CHAR_BITS)
                left, right = codes[:-1], codes[1:]
                at = np.nonzero((left > 127) | (right > 127))[0]
                if len(at):
                    pairs += np.bincount(_pair_cells(left[at], right[at]), minlength=1 << PAIR_BITS)
        for offset, counts in ((0, pairs), (1 << PAIR_BITS, chars)):
            at = np.nonzero(counts)[0]
            yield pd.DataFrame({"cell": at + offset, "n": counts[at]})

    cells = corpus.select(F.col(column).alias("t")).where(F.col("t").isNotNull()).mapInPandas(count, "cell long, n long")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 2**PAIR_BITS + 2**CHAR_BITS rows
    both = np.zeros((1 << PAIR_BITS) + (1 << CHAR_BITS), dtype=np.float64)
    both[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    pairs, chars = both[: 1 << PAIR_BITS], both[1 << PAIR_BITS :]
    return PairModel(pairs.astype(np.float32), chars.astype(np.float32), float(chars.sum()))


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments of a sequence (Ruzzo and Tompa), as half-open ranges in order."""
    segments: list[tuple[int, int, float, float]] = []  # start, end, total before the start, total at the end
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= left:
                j -= 1
            if j < 0 or segments[j][3] >= total:
                segments.append((start, i + 1, left, total))
                break
            start, left = segments[j][0], segments[j][2]
            del segments[j:]
    return [(a, b) for a, b, _, _ in segments]


def improbable_runs(text: str, information: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the improbable runs of a text that hold a character beyond ASCII."""
    scores = np.where(np.isnan(information), ASCII_SCORE, -information + CUT)
    change = np.nonzero(np.diff(scores > 0))[0] + 1
    starts = np.concatenate(([0], change))
    blocks = np.add.reduceat(scores, starts)
    ends = np.concatenate((change, [len(scores)]))
    runs: list[tuple[int, int]] = []
    for a, b in maximal_segments(blocks.tolist()):
        i, j = int(starts[a]), int(ends[b - 1]) + 1
        while i > 0 and text[i - 1] > "\x7f":
            i -= 1
        while j < len(text) and text[j] > "\x7f":
            j += 1
        if runs and i < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(j, runs[-1][1]))
        else:
            runs.append((i, j))
    return [(i, j) for i, j in runs if not text[i:j].isascii()]


def _as_bytes(run: str, encoding: str) -> bytes | None:
    """The bytes that were taken for ``run``; C1 controls and such stand for themselves where the encoding has no character there."""
    try:
        return run.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in run:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _utf8_inside(data: bytes) -> tuple[str, bool] | None:
    """``data`` with its UTF-8 sequences decoded, and whether nothing else beyond ASCII is left; None without any sequence."""
    if not _UTF8.search(data):
        return None
    for whole in (data, re.sub(rb"([\xc2-\xc5\xce-\xd1]) ", b"\\1\xa0", data)):  # a no-break space may have become a blank
        try:
            return whole.decode("utf-8"), True
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace"), False


def _unfold(run: str) -> str:
    """Lower case, with the signs that upper case had turned into letters."""
    return run.lower().replace("μ", "µ")


@dataclass
class Repair:
    """What became of a run: its text, the encoding it had been read with ('' if not known), and whether it is whole."""

    text: str
    encoding: str
    whole: bool


def repair_run(run: str, before: str, after: str, model: PairModel, depth: int = 2) -> Repair | None:
    """The best accepted inverse mapping of a run, or None. ``before`` and ``after`` are the neighbouring characters."""
    base = model.value(before + run + after)
    best: tuple[float, Repair] | None = None
    variants = [(run, False)] + ([(_unfold(run), True)] if run != _unfold(run) else [])
    for text, changed in variants:
        for encoding in TAKEN_FOR_UTF8:
            data = _as_bytes(text, encoding)
            decoded = data and _utf8_inside(data)
            if not decoded:
                continue
            out, whole = decoded
            if out == text or (not whole and out.count("�") > 0.34 * sum(c > "\x7f" for c in out)):
                continue
            if changed and run.upper() == run:
                out = out.upper()
            gain = model.value(before + out + after) - base + 2.0 * (len(run) - len(out))
            if not whole:
                gain -= 2.0
            if gain >= MIN_GAIN and (best is None or gain > best[0] + 1e-6):
                best = (gain, Repair(out, encoding, whole))
    if best:
        if depth > 1 and not best[1].text.isascii():
            again = repair_run(best[1].text, before, after, model, depth - 1)
            if again and again.encoding in TAKEN_FOR_UTF8:
                return Repair(again.text, f"{best[1].encoding}+{again.encoding}", again.whole and best[1].whole)
        return best[1]
    return _single_byte(run, before, after, model, SINGLE, MIN_GAIN_SINGLE)


def _base(c: str) -> str:
    return {"Ð": "D", "đ": "d", "Đ": "D", "ð": "d"}.get(c) or unicodedata.normalize("NFD", c)[0]


def _single_byte(run: str, before: str, after: str, model: PairModel, mappings: Iterable[tuple[str, str]], least: float) -> Repair | None:
    """Repair of a run in which one single-byte encoding was taken for another.

    All its pairs must be probable afterwards. A change to another form of the same letter is none: such a letter is
    unusual, not damaged.
    """
    if _LOST.search(run) or any(ord(c) > 0x4FF and not 0x2000 <= ord(c) < 0x2600 for c in run):
        return None
    base = model.value(before + run + after)
    best: tuple[float, Repair] | None = None
    for read, meant in mappings:
        try:
            out = run.encode(read).decode(meant)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        changed = [(i, a, c) for i, (a, c) in enumerate(zip(run, out)) if a != c]
        if not changed or not all(c.isalpha() for _, _, c in changed) or all(_base(a) == _base(c) for _, a, c in changed):
            continue
        information = model.information(_codes(before + out + after))
        if len(information) == 0 or np.nanmin(information) < CUT:
            continue
        gain = float(np.nansum(information)) - base
        gain -= 6.0 * sum(c.isupper() and (out[i - 1] if i else before)[-1:].islower() for i, _, c in changed)
        if gain >= least and (best is None or gain > best[0] + 1e-6):
            best = (gain, Repair(out, f"{read}>{meant}", True))
    return best[1] if best else None


def repair_text(text: str, information: np.ndarray, model: PairModel, cache: dict | None = None) -> tuple[str, bool, list[str]] | None:
    """Restored text, whether all of it could be restored, and the encodings; None if no run is damaged."""
    runs = []
    for i, j in improbable_runs(text, information):
        run, before, after = text[i:j], text[max(0, i - 1) : i], text[j : j + 1]
        key = (run, before, after)
        if cache is not None and key in cache:
            fixed = cache[key]
        else:
            fixed = repair_run(run, before, after, model)
            if cache is not None and len(cache) < 20_000:
                cache[key] = fixed
        runs.append((i, j, fixed))
    seen = sorted({tuple(r.encoding.split(">")) for _, _, r in runs if r and ">" in r.encoding})
    parts, last, whole, encodings = [], 0, True, set()
    hit = False
    for i, j, fixed in runs:
        run = text[i:j]
        if fixed is None and seen:  # what holds for one run of a value needs less evidence in the others
            fixed = _single_byte(run, text[max(0, i - 1) : i], text[j : j + 1], model, seen, MIN_GAIN)
        if fixed is None:
            if _LOST.search(run):
                hit, whole = True, False
            continue
        hit = True
        whole &= fixed.whole and not _LOST.search(fixed.text)
        encodings.add(fixed.encoding)
        parts += [text[last:i], fixed.text.upper() if text.isupper() or text[:i].isupper() and text[j:].upper() == text[j:] else fixed.text]
        last = j
    if not hit and _LOST.search(text):
        hit, whole = True, False
    if not hit:
        return None
    return "".join([*parts, text[last:]]), whole, sorted(encodings)


_MARK_IN_WORD = re.compile(r"[^\W\d_]\?+(?=[^\W\d_])(.)")
_MARK_IN_NAME = re.compile(r"[^\W\d_]\?|(?:^|[\s'-])\?+[^\W\d_]")


#: Passages of question marks, which no word or sign they could end stands before, and a mark that begins a word.
_MARK_RUNS = re.compile(r"(?<![^\s\d(.,])\?{4,}|(?<![^\s(])\?{2,}(?=[\s(]*\?{2}|\d)|\d\?{2,}\d|(?<=[\s(\"'«“-])\?[^\W\d_]{2}")
_MARK_BEFORE_WORD = re.compile(r"([^\W\d_])[^\W\d_]+\?+[ \t]+[a-z]{2}")
#: The same for the JVM, where it may let more through.
_MARKS_JVM = r"[a-zA-Z]\?+[a-z]|\?\?|(?:^|[^\p{L}])\?\p{L}|[a-zA-Z]\?+[ \t]+[a-z]"


def has_lost_marks(text: str, names: bool) -> bool:
    """True if a question mark stands for a lost letter. In names: next to a letter. Else: between a letter and a small letter;
    in a run of several that does not follow a word; before the letters of a word that a blank or an opening sign precedes, or
    before a small letter at the beginning; or at the end of a capitalised word within a sentence, where a small word goes on
    (no clean document of sf0.1 has any of these)."""
    if names:
        return _MARK_IN_NAME.search(text) is not None
    if any(m.group(1).islower() for m in _MARK_IN_WORD.finditer(text)) or _MARK_RUNS.search(text):
        return True
    if text[:1] == "?" and text[1:2].islower():
        return True
    return any(m.group(1).isupper() and re.search(r"[^\W\d_],?[ \t]$", text[max(0, m.start() - 3) : m.start()]) for m in _MARK_BEFORE_WORD.finditer(text))


def find_garbled(df: DataFrame, column: str, model: PairModel) -> DataFrame:
    """The damaged rows of ``df``: its columns plus restored (null unless all damage could be undone), partly_restored, encodings.

    Null and empty texts are never damaged. Repeated rows stay repeated. Every character of a text of any length is
    looked at. Columns of ``df`` with the names of the result columns raise ValueError.
    """
    clash = {"restored", "partly_restored", "encodings", "_fix"} & set(df.columns)
    if clash:
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = "struct<restored:string,partly_restored:string,encodings:array<string>>"

    @F.pandas_udf(kind)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for s in batches:
            texts = s.tolist()
            out: list[tuple] = [(None, None, None)] * len(texts)
            for first, part in _slices(texts):
                codes = _codes("\n".join(part))
                information = m.information(codes)
                bounds = np.cumsum([0] + [len(t) + 1 for t in part])
                bad = np.nonzero(information < CUT)[0]
                lost = np.nonzero((codes == 0xFFFD) | ((codes >= 0x80) & (codes < 0xA0)))[0]
                for k in np.unique(np.searchsorted(bounds, np.concatenate((bad, lost)), side="right") - 1):
                    t = part[k]
                    if len(t) < 2:
                        fixed = (t, False, []) if _LOST.search(t) else None
                    else:
                        fixed = repair_text(t, information[bounds[k] : bounds[k + 1] - 2], m, cache)
                    if fixed:
                        out[first + k] = (fixed[0] if fixed[1] and not has_lost_marks(fixed[0], False) else None, fixed[0], fixed[2])
            yield pd.DataFrame(out, columns=["restored", "partly_restored", "encodings"], index=s.index)

    # Other texts hold nothing to restore and stay in the JVM.
    rows = df.where(F.col(column).rlike(r"[^\x00-\x7f]")).withColumn("_fix", fix(F.col(column)))
    return rows.where(F.col("_fix.partly_restored").isNotNull()).select(*df.columns, "_fix.restored", "_fix.partly_restored", "_fix.encodings")


def find_lost_marks(df: DataFrame, column: str, names: bool = False) -> DataFrame:
    """The rows of ``df`` in which question marks stand for letters (has_lost_marks). Null and empty texts have none."""

    @F.pandas_udf("boolean")
    def lost(s: pd.Series) -> pd.Series:
        return s.map(lambda t: has_lost_marks(t, names))

    return df.where(F.col(column).rlike(r"\?" if names else _MARKS_JVM)).where(lost(F.col(column)))
