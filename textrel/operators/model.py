"""Extraction by a language model that the user connects: prompts, calls with retries, and answers read back.

``connect`` is called once per partition on the worker and returns a function from a prompt to an answer; no client is part
of the library. Chunks go to the model in groups, columns in batches, so a group takes ceil(columns / batch) calls.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from textrel.operators.extract import repaired_json

#: Columns and chunks per call, calls until one is given up, and seconds between them.
COLUMN_BATCH, CHUNK_GROUP, RETRIES, DELAY = 10, 1, 3, 2.0


def column_lines(columns: dict[str, str], hints: dict[str, list[str]] | None = None) -> str:
    """A line per column: its type, and the values that queries ask for, towards which answers should be spelled."""
    kinds = {"number": "a number without units or separators", "date": "a date as the text writes it", "list": "all values, parted by ||"}
    out = []
    for c, kind in columns.items():
        asked = (hints or {}).get(c)
        out.append(f"- {c}: {kinds.get(kind, 'a short text')}" + (f" (spell it like one of: {', '.join(asked)}, where it is the same thing)" if asked else ""))
    return "\n".join(out)


def extraction_prompt(table: str, columns: dict[str, str], passages: list[str], hints: dict[str, list[str]] | None = None) -> str:
    """The prompt for a group of passages; the answer has the shape that passage_records and read_answer know."""
    shown = "\n\n".join(f"passage_{i}:\n{p}" for i, p in enumerate(passages, 1))
    return (
        f"Find what the passages say about each {table}. Columns:\n{column_lines(columns, hints)}\n"
        'Answer with JSON only: {"passage_1": [{column: {"value": value, "span": "the words that prove it"}}], ...}. '
        f"Leave out columns that a passage does not state. Do not guess.\n\n{shown}"
    )


def repair_prompt(answer: str) -> str:
    return f"This should be JSON but does not parse. Give the same content as valid JSON only:\n{answer}"


def read_answer(answer: str | None, n: int, columns: list[str]) -> list[list[dict[str, str]]] | None:
    """Records of each of ``n`` passages; None if the answer holds no readable JSON."""
    found = repaired_json(answer or "")
    data = json.loads(found) if found else None
    if not isinstance(data, dict):
        return None
    out = []
    for i in range(1, n + 1):
        records = []
        for r in data.get(f"passage_{i}") or []:
            if isinstance(r, dict):
                cells = {c: v.get("value") if isinstance(v, dict) else v for c, v in r.items() if c in columns}
                records.append({c: v if isinstance(v, str) else json.dumps(v) for c, v in cells.items() if v is not None})
        out.append([r for r in records if r])
    return out


def ask(call: Callable[[str], str], prompt: str, n: int, columns: list[str], retries: int = RETRIES, delay: float = DELAY) -> list[list[dict[str, str]]]:
    """An answer read back: calls that fail are repeated ``retries`` times in all, an unreadable answer is sent back once to be
    repaired. Nothing readable gives empty records."""
    for n_try in range(retries):
        try:
            answer = call(prompt)
            found = read_answer(answer, n, columns)
            return found if found is not None else read_answer(call(repair_prompt(answer)), n, columns) or [[] for _ in range(n)]
        except Exception:  # whatever the user's client raises
            if n_try + 1 < retries:
                time.sleep(delay)
    return [[] for _ in range(n)]


class ModelExtractor:
    """An extractor (see extract.Extractor) that asks a model. ``columns`` maps names to text, number, date or list."""

    verbatim = False

    def __init__(self, connect: Callable[[], Callable[[str], str]], table: str, columns: dict[str, str], hints: dict[str, list[str]] | None = None, column_batch: int = COLUMN_BATCH, chunk_group: int = CHUNK_GROUP, retries: int = RETRIES, delay: float = DELAY):
        self.connect, self.table, self.kinds, self.hints = connect, table, columns, hints
        self.columns = tuple(columns)
        self.column_batch, self.chunk_group, self.retries, self.delay = column_batch, chunk_group, retries, delay

    def __call__(self, chunks: DataFrame) -> DataFrame:
        connect, table, kinds, hints = self.connect, self.table, self.kinds, self.hints
        names, width, group, retries, delay = list(self.columns), self.column_batch, self.chunk_group, self.retries, self.delay

        def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = connect()
            for b in batches:
                ids, texts = b["chunk_id"].tolist(), b["content"].tolist()
                out = []
                for i in range(0, len(ids), group):
                    merged: list[list[dict]] = [[] for _ in ids[i : i + group]]
                    for k in range(0, len(names), width):
                        some = {c: kinds[c] for c in names[k : k + width]}
                        prompt = extraction_prompt(table, some, [t or "" for t in texts[i : i + group]], hints)
                        for rows, found in zip(merged, ask(call, prompt, len(merged), list(some), retries, delay)):
                            for n, r in enumerate(found):  # the n-th records of all column batches are one
                                if n < len(rows):
                                    rows[n] = r | rows[n]
                                else:
                                    rows.append(r)
                    out += zip(ids[i : i + group], merged)
                yield pd.DataFrame(out, columns=["chunk_id", "records"])

        return chunks.select("chunk_id", "content").mapInPandas(extract, "chunk_id string, records array<map<string,string>>")
