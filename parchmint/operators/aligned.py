"""Tables whose columns are aligned by spaces. Lists of lines in; pandas for many documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Lines to learn columns from, and how near a start must be.
LEARN_FROM, NEAR = 5, 5
WORD = re.compile(r"\S+")
ROWS = "doc_id long, row int, header string, value string"


def column_starts(lines: list[str]) -> list[int]:
    """Where columns begin: word starts of the first line, moved halfway to near starts of the next ones, and new ones."""
    starts: list[int] = []
    for k, line in enumerate(lines[:LEARN_FROM]):
        here = [m.start() for m in WORD.finditer(line)]
        if k == 0:
            starts = here
            continue
        fresh = []
        for at in here:
            near = min(range(len(starts)), key=lambda i: abs(starts[i] - at))
            if abs(starts[near] - at) < NEAR:
                starts[near] = (starts[near] + at) // 2
            else:
                fresh.append(at)
        starts = sorted(starts + fresh)
    return starts


def cells(line: str, starts: list[int]) -> list[str]:
    ends = [*starts[1:], len(line)]
    return [line[a:b].strip() if a < len(line) else "" for a, b in zip(starts, ends, strict=True)]


def table(text: str) -> tuple[list[str], list[dict[str, str]]]:
    """Headers, and rows by header; lines of dashes are rules."""
    lines = [line for line in text.split("\n") if line.strip()]
    starts = column_starts(lines)
    headers = [h for h in cells(lines[0], starts) if h] if lines else []
    body = [line for line in lines[1:] if line.strip("-= \t")] if headers else []
    return headers, [dict(zip(headers, cells(line, starts), strict=False)) for line in body]


def with_pipes(text: str, share: float = 0.4, near: int = 5) -> str:
    """A text whose words begin or end at the same places on many lines, with pipes there and dashes under the first line."""
    lines = text.split("\n")
    votes: dict[int, list[int]] = {}
    for line in lines:
        for m in WORD.finditer(line):
            votes.setdefault(m.start(), [0, 0])[0] += 1
            votes.setdefault(m.end(), [0, 0])[1] += 1
    often = sorted(p for p, n in votes.items() for k in n if k >= len(lines) * share)
    bounds: list[int] = []
    at = None
    for p in often:
        if at is None:
            at = p
        elif p - at < near:
            at = (at + p) // 2
        else:
            bounds.append(at)
            at = p
    bounds += [at] if at is not None else []
    if len(lines) < 3 or len(bounds) < 2:
        return text

    def piped(line: str) -> str:
        inside = [b for b in bounds if b <= len(line)]
        return re.sub(r"\|\s+\|", "|", "".join(line[a:b] + " | " for a, b in zip([0, *inside], inside, strict=False)) + line[inside[-1] if inside else 0 :]) if line.strip() else ""

    rows = [piped(line) for line in lines]
    return "\n".join([rows[0], "|".join("-" * len(x.strip()) for x in rows[0].split("|")), *rows[1:]])


# The lines that tell gaps, how wide a gap is, and how far gaps of one column lie apart.
GAP, APART, GROUPED = re.compile(r"(?<=\S)\s{2,}(?=\S)"), 3, 3


def gap_bounds(lines: list[str]) -> list[int]:
    """Where the gaps of the first lines begin, each more than APART beyond the one before."""
    bounds: list[int] = []
    for at in sorted(m.start() for line in lines[:LEARN_FROM] for m in GAP.finditer(line)):
        if not bounds or at > bounds[-1] + APART:
            bounds.append(at)
    return bounds


def organized_table(text: str) -> str:
    """A table organised by its gaps: outer pipes, pipes at the bounds, a rule after the first line; stripped lines without any."""
    lines = text.split("\n")
    bounds = gap_bounds(lines) if len(lines) > 2 else []
    if not bounds:
        return "\n".join(line.strip() for line in lines)

    def row(line: str) -> str:
        inside = [b for b in bounds if b < len(line)]
        parts = [line[a:b].strip() for a, b in zip([0, *inside], [*inside, len(line)], strict=True)]
        return f"| {' | '.join(parts)} |"

    rows = [row(line) if line.strip() else "" for line in lines]
    return "\n".join([rows[0], f"|{' --- |' * (rows[0].count('|') - 1)}" if rows[0].count("|") > 1 else "||", *rows[1:]])


def formatted_table(text: str) -> str:
    """The lines with gaps or tabs as a table: single pipes at the mean places of their gaps, dashes under the first line."""
    rows = [line for line in (x.strip() for x in text.split("\n")) if "\t" in line or re.search(r"\S\s{2,}\S", line)]
    places = sorted(m.start() for line in rows[:LEARN_FROM] for m in re.finditer(r"\s{2,}", line))
    groups: list[list[int]] = []
    for at in places:
        if groups and at - groups[-1][-1] < GROUPED:
            groups[-1].append(at)
        else:
            groups.append([at])
    bounds = [sum(g) // len(g) for g in groups]

    def piped(line: str) -> str:
        out = line
        for b in sorted((b for b in bounds if b < len(line)), reverse=True):
            out = f"{out[:b]} | {out[b:].lstrip()}"
        return out

    rows = [piped(line) for line in rows]
    if len(rows) > 1:
        rows.insert(1, "|".join("-" * len(x.strip()) for x in rows[0].split("|")) if "|" in rows[0] else "-" * len(rows[0]))
    return "\n".join(rows) if rows else text


def delimited_table(text: str) -> tuple[list[str], list[dict[str, str]]]:
    """Headers and rows by header of a table with pipes, or else tabs."""
    sep = "|" if "|" in text else "\t"
    lines = [line for line in text.split("\n") if line.strip()]
    headers = [h.strip() for h in lines[0].split(sep) if h.strip()] if lines else []
    body = [line for line in lines[1:] if line.strip("-= \t")]
    return headers, [dict(zip(headers, (x.strip() for x in line.split(sep)), strict=False)) for line in body]


def any_table(text: str) -> tuple[list[str], list[dict[str, str]]]:
    """A table by its pipes, its tabs, or its gaps, whichever come first."""
    return delimited_table(text) if "|" in text or "\t" in text else table(text)


def tables(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row for each cell that has a header, whatever the table's kind."""
    return _cells(docs, any_table)


def space_tables(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row for each cell that has a header."""
    return _cells(docs, table)


def _cells(docs: DataFrame, read: Callable[[str], tuple[list[str], list[dict[str, str]]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(d, i, h, v) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, row in enumerate(read(t or "")[1]) for h, v in row.items()]
            yield pd.DataFrame(found, columns=["doc_id", "row", "header", "value"])

    return docs.select("doc_id", "text").mapInPandas(run, ROWS)


def rewritten(docs: DataFrame, step: Callable[[str], str], name: str) -> DataFrame:
    """docs (doc_id, text) to (doc_id, name): each text by step, null as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], name: [None if t is None else step(t) for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {name} string")
