"""Sentences and analysis segments. Both depend on what came before in the text, so they are scanned in Arrow batches of rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

# Abbreviations after which a sentence goes on, marks that belong to the sentence before them, and marks that open one.
ABBREVIATIONS = (
    "dr.", "e.g.", "i.e.", "jr.", "mr.", "mrs.", "ms.", "no.", "prof.", "sr.", "st.", "u.k.", "u.s.", "vs.",
)
CLOSERS = ('"', "'", ")", "]", "}", "”", "’")
OPENERS = ('"', "'", "“", "‘", "(", "[")
# Fixed value: tokens by which segments that are joined may exceed the most, at least.
SLACK = 5
# A stop, the marks that belong to it and the blanks after it; initials (letters whose case folding is one of a to z, or a dotless i).
_STOP = re.compile(rf"[.?!][{re.escape(''.join(CLOSERS))}]*\s*")
_INITIALS = re.compile(r"(?:[A-Za-z\u0131\u017f\u212a]\.)*")
_LONGEST = max(map(len, ABBREVIATIONS))
_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")


def sentences(paragraph: str) -> list[str]:
    """Cuts after . ? ! and closing marks before a capital, digit or opening mark; not after abbreviations, initials or inside numbers."""
    found, start = [], 0
    # the last word's start, the end of the initials there, and how far words were looked for
    word, named, seen = 0, _INITIALS.match(paragraph).end(), 0
    for stop in _STOP.finditer(paragraph):
        at, end = stop.span()
        follow = paragraph[end : end + 1]
        if follow and not (follow.isupper() or follow.isdigit() or follow in OPENERS):
            continue
        if paragraph[at] == ".":
            piece = paragraph[seen : at + 1]
            last = piece.rsplit(None, 1)[-1]
            if len(last) < len(piece):
                word = at + 1 - len(last)
                named = _INITIALS.match(paragraph, word).end()
            seen = at + 1
            # case folding shortens no word, so that longer ones are no abbreviations
            abbreviated = seen - word <= _LONGEST and paragraph[word:seen].casefold() in ABBREVIATIONS
            inside_number = follow.isdigit() and paragraph[at - 1 : at].isdigit()
            if abbreviated or at < named or inside_number:
                continue
        found.append(paragraph[start:end].strip())
        start = end
    if tail := paragraph[start:].strip():
        found.append(tail)
    return found


def without_controls(text: str) -> str:
    """Line ends become \\n; control and other C category characters become spaces, but for line ends and tabs."""
    unix = text.replace("\r\n", "\n").replace("\r", "\n")
    if unix.replace("\n", " ").replace("\t", " ").isprintable():
        return unix
    odd = {ord(x): " " for x in set(unix) - {"\n", "\t"} if unicodedata.category(x)[0] == "C"}
    return unix.translate(odd) if odd else unix


def blocks(text: str) -> list[str]:
    return [x for x in (" ".join(p.split()) for p in re.split(r"\n\s*\n+", without_controls(text))) if x]


def token_count(text: str) -> int:
    return len(_TOKEN.findall(text.casefold()))


def runs(sizes: list[int], stays: Callable[[int, int, int], bool], least: int, most: float) -> list[list[int]]:
    """Places of consecutive sizes, gathered in order into runs.

    A size goes into the last run if stays(the run's total, its members, the
    size), else it opens a run. A last run under least goes into the one before
    it if both together are at most most. No place is lost or moved.
    """
    made, totals = [], []
    for place, size in enumerate(sizes):
        if made and stays(totals[-1], len(made[-1]), size):
            made[-1].append(place)
            totals[-1] += size
        else:
            made.append([place])
            totals.append(size)
    if len(made) > 1 and totals[-1] < least and totals[-2] + totals[-1] <= most:
        made[-2:] = [made[-2] + made[-1]]
    return made


def packed(text: str, least: int = 20, most: int = 80) -> list[str]:
    """Segments of at least least tokens where the text allows: long paragraphs are cut at sentences, short ones are joined to what follows."""
    top = most + max(SLACK, least // 2)
    units = []
    for paragraph in blocks(text):
        parts = sentences(paragraph) if token_count(paragraph) > most else [paragraph]
        # a lone short sentence takes the next one along whatever its length
        own = runs([*map(token_count, parts)], lambda total, n, size: total + size <= most or n == 1 and total < least, least, float("inf"))
        units += [" ".join(parts[k] for k in run) for run in own]
    joined = runs([*map(token_count, units)], lambda total, n, size: total < least and total + size <= top, least, top)
    return ["\n\n".join(units[k] for k in run) for run in joined]


#: Bytes of texts that are cut at once, besides a longer one's, and the pieces of a batch that goes back.
CUT_BYTES, PIECES = 1_000_000, 10_000


def _exploded(df: DataFrame, id_col: str, text_col: str, cut) -> DataFrame:
    """id_col, place, text: the pieces of each text. Texts become strings in small slices, so that a task's memory doesn't depend on a batch's texts."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            lo = 0
            while lo < len(sizes):
                hi, size = lo + 1, sizes[lo]
                while hi < len(sizes) and size + sizes[hi] <= CUT_BYTES:
                    size += sizes[hi]
                    hi += 1
                part = batch.slice(lo, hi - lo)
                rows = [(i, k, x) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, x in enumerate(cut(t or ""), 1)]
                for at in range(0, len(rows), PIECES):
                    ids, places, texts = zip(*rows[at : at + PIECES])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=[id_col, "place", "text"])
                lo = hi

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, place long, text string")


def with_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _exploded(df, id_col, text_col, lambda t: [s for p in blocks(t) for s in sentences(p)])


def packed_segments(df: DataFrame, id_col: str, text_col: str, least: int = 20, most: int = 80) -> DataFrame:
    return _exploded(df, id_col, text_col, lambda t: packed(t, least, most))
