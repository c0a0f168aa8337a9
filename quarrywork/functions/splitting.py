"""Splitting long texts into overlapping pieces at the coarsest separators that do, as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
LIMIT, OVERLAP, WHOLE = 700, 100, 1200


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator; every character for the empty one."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _windows(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Runs of pieces up to limit; each begins with what of the last one's end fits the overlap."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for piece in pieces:
        if held and size + len(piece) > limit:
            out.append("".join(held).strip())
            while held and (size > overlap or size + len(piece) > limit):
                size -= len(held.pop(0))
        held.append(piece)
        size += len(piece)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < limit:
            short.append(piece)
            continue
        out += _windows(short, limit, overlap)
        short = []
        out += split_text(piece, limit, overlap, finer) if finer else [piece]
    return out + _windows(short, limit, overlap)


def chunks(text: Column, whole: int = WHOLE, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY of pieces; a text of at most whole characters stays one and never goes to Python."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, limit, overlap))

    long = F.when(F.char_length(text) > whole, text)
    return F.when(F.char_length(text) > whole, cut(long)).otherwise(F.array(text))
