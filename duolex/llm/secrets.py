"""Secret scans: fixed patterns, and random strings found by their few characters per token."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .common import slices, small_batches

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Where none of these is, ASSIGN finds nothing.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of at least 16; a maximal run is what an unbounded repeat would match.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: What the token test looks at: runs of so many characters and more.
LEAST = 16
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: A run is random below so many characters a token. Words may be of a language that the vocabulary cuts up; runs of them are so below the second number.
RATIO, WORD_RATIO = 2.0, 1.5
#: Known digests: hexadecimal in either case, by the lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
#: Identifiers.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of one case or with a capital first, joined by signs, at most with a number at the end.
_WORD = "(?:[A-Z]?+[a-z]++|[A-Z]++)(?![A-Za-z])"
WORDS = re.compile(rf"[+/_=-]*+{_WORD}(?:[+/_=-]++{_WORD})*+[+/_=-]*+[0-9]{{0,4}}+[+/_=-]*+")
#: Plain numbers, dates and phone or card numbers.
NUMBER = re.compile(r"[0-9+/_=-]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns; leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def random_spans(text: str, count_tokens) -> list[tuple[int, int, str]]:
    """Runs that take many tokens for their length and are no number, known digest or identifier."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if NUMBER.fullmatch(run) or UUID.fullmatch(run) or len(run) in DIGEST_CHARS and DIGEST.fullmatch(run):
            continue
        if len(run) < (WORD_RATIO if WORDS.fullmatch(run) else RATIO) * count_tokens(run):
            found.append((m.start(), 3, m.end()))
    return found


_ENCODINGS: dict[str, object] = {}


def _counter(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    key = hashlib.md5(repr((len(ranks), pattern)).encode() + b"".join(sorted(ranks)[:1000])).hexdigest()
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = _ENCODINGS[key].encode_ordinary
    return lambda run: len(encode(run))


def find_secrets(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's spans that may be secrets.

    Returns id_col, spans array<struct<kind, start, stop>> by start and then
    kind as KINDS lists them, in code points, end exclusive. A row for each
    input row; a null or empty text has no spans. The fixed patterns' spans are
    always kept; kind random is the token test's. No shuffle; the vocabulary is
    read on the driver and its size doesn't depend on the data.
    """
    small_batches(df.sparkSession)
    source = df.select(id_col, text_col)
    shared = source.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value, pattern)
        for part, texts in slices(batches):
            spans = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(base_spans(x) + random_spans(x, count))] for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], names=[id_col, "spans"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,stop:int>>")
