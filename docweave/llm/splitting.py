"""Problem 4: splitting oversized items at natural boundaries.

Method: every natural boundary of a text (paragraph, line and sentence ends) has a strength; a sparse table over
(strength, position) answers which cut within a window of permissible lengths is strongest, the rightmost of equals.
Each piece begins `overlap` characters before the cut that ended the last. Where the later half of the window holds no
boundary the earlier half is asked; where that holds none either, the cut is hard, at the limit.

Choosing any boundary in the window never puts the next window's end further left, so a text that natural cuts alone
can keep within the limit is never cut hard.

Null and empty texts and items within the limit give no pieces. A null or empty path heads nothing; a path too long
to leave more room than the overlap is left off. A point between two digits ends no sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 150
PARAGRAPH, LINE, SENTENCE = 3, 2, 1
_ENDS = re.compile(r"\n[^\S\n]*\n+|[\n\r\u0085\u2028\u2029\v\f]|(?<![0-9０-９])[.．]+|[.．]+(?![0-9０-９])|[!?。！？…]+")
_CLOSERS = "\"'”’)]）］」』》〉"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a cut is natural, ascending, and their strengths."""
    at, strength = [], []
    for m in _ENDS.finditer(text):
        end, first = m.end(), m.group()[0]
        if first in "\n\r\u0085\u2028\u2029\v\f":
            power = PARAGRAPH if m.group().count("\n") > 1 else LINE
        else:
            power = SENTENCE
            while end < len(text) and text[end] in _CLOSERS:
                end += 1
        if at and at[-1] == end:
            strength[-1] = max(strength[-1], power)
        else:
            at.append(end)
            strength.append(power)
    return np.array(at, dtype=np.int64), np.array(strength, dtype=np.int64)


class StrongestCut:
    """Sparse table for range maxima: level k holds the best of 2**k boundaries from each on."""

    def __init__(self, at: np.ndarray, strength: np.ndarray):
        self.at = at
        self.levels = [(strength << 40) | at]
        while 2 ** len(self.levels) <= len(at):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def within(self, low: int, high: int) -> int | None:
        """The strongest boundary in (low, high], the rightmost of equals."""
        i, j = np.searchsorted(self.at, [low, high], side="right")
        if i >= j:
            return None
        k = int(j - i).bit_length() - 1
        level = self.levels[k]
        return int(max(level[i], level[j - 2**k]) & ((1 << 40) - 1))


def pieces(text: str, room: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """(start, end) of pieces of at most `room` characters, and whether every cut is natural. Needs room > overlap >= 0."""
    best = StrongestCut(*boundaries(text))
    out, start, natural, n = [], 0, True, len(text)
    while n - start > room:
        limit, least = start + room, start + overlap
        middle = max(least, start + room // 2)
        cut = best.within(middle, limit)
        if cut is None:
            cut = best.within(least, middle)
        if cut is None:
            cut, natural = limit, False
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out, natural


def header_of(path: str | None, limit: int, overlap: int) -> str:
    head = f"[{path}]\n" if path else ""
    return head if limit - len(head) > overlap else ""


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, path, text in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "text"))):
            head = header_of(path, limit, overlap)
            spans, natural = pieces(text, limit - len(head), overlap)
            kind = "natural" if natural else "hard"
            if whole:
                out += [(i, k, s, e, kind, head + text[s:e]) for k, (s, e) in enumerate(spans, 1)]
            else:
                out.append((i, kind))
        if out:
            names = ["id", "piece_no", "start_at", "end_at", "cut_kind", "piece"] if whole else ["id", "cut_kind"]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()) if whole else (pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)


def _oversized(items: DataFrame, limit: int) -> DataFrame:
    head = F.when(F.length("path") > 0, F.length("path") + 3).otherwise(0)
    return items.select("id", "path", "text").where((F.length("text") > 0) & (head + F.length("text") > limit))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """items: id LONG, path STRING, text STRING. The pieces of every item over the limit, each headed by its path."""
    schema = "id long, piece_no int, start_at long, end_at long, cut_kind string, piece string"
    return _oversized(items, limit).mapInArrow(lambda it: _split(it, limit, overlap, True), schema)


def cut_kinds(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id and cut_kind of every item over the limit."""
    return _oversized(items, limit).mapInArrow(lambda it: _split(it, limit, overlap, False), "id long, cut_kind string")
