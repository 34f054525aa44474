"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte is written as one character, visible ASCII as itself and any other
byte b as chr(256 + b); each token of the vocabulary is the string of its bytes'
characters, scored by its negative rank.
sentencepiece then merges the pair of the best score, leftmost first, which is
the order of the rank file. Its normaliser is the identity: no prefix, no
white-space rule, no character map.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches

#: Entries of each of the two generations of a worker's cache of pre-tokens.
CACHE = 80_000
#: How bytes that aren't visible ASCII are written.
CHARS = {b: 256 + b for b in range(256) if not 33 <= b < 127}
#: Pre-tokens of at most so many characters are cached.
CACHED_CHARS = 40
#: The pattern for which pre-tokens of Latin-1 texts are found by an equal pattern without property classes (fixed value).
LATIN_FORM = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(CHARS)


def newer_characters(ranks: dict[bytes, int], pattern: str) -> str:
    """Letters and numbers of this machine's regex tables that tiktoken, which has older ones, takes for neither."""
    import regex
    import tiktoken

    tokens = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
    word = regex.compile(r"[\p{L}\p{N}]")
    odd = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and word.match(c)]
    return "".join(c for c in odd if 256 not in probe.encode_ordinary(f"{c}'s"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes and str by length, float as four bytes, int and bool as varint."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return _varint(number << 3 | 2) + _varint(len(raw)) + raw
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks' order; the last piece is the unknown one and is never used."""
    tokens = sorted(ranks, key=ranks.get)
    missing = {bytes([b]) for b in range(256)} - ranks.keys()
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
    pieces = b"".join(_field(1, _field(1, mapped(x)) + _field(2, float(-ranks[x]))) for x in tokens)
    pieces += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos and pad: -1
    normaliser = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes and decodes in a worker. Ids are ranks."""

    def __init__(self, model: bytes, ranks: list[tuple[bytes, int]], pattern: str, newer: str = ""):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.newer = regex.compile(f"[{newer}]") if newer else None
        # the classes of the pattern within Latin-1, where the built-in engine is the faster one
        known = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
        self.split_latin = None
        if pattern == LATIN_FORM:
            own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(known.values())}]").replace(r"(?!\S)", f"(?![^{known[r'\s']}])")
            for k, v in known.items():
                own = own.replace(k, f"[{v}]")
            self.split_latin = re.compile(own).findall
        self.whole = {token: struct.pack("<i", rank) for token, rank in ranks}
        self.order = np.array([rank for _, rank in ranks], np.int32)
        self.place = np.zeros(self.order.max() + 1, np.int64)
        self.place[self.order] = np.arange(len(ranks))
        self.sizes = np.array([len(token) for token, _ in ranks], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(token for token, _ in ranks), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.split_latin is not None and (text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)):
            return self.split_latin(text)
        if self.newer is not None and self.newer.search(text):
            return [text[m.start() : m.end()] for m in self.spans(self.newer.sub("\ue000", text))]
        return self.split(text)

    def learn(self, pre_tokens: list[str]) -> None:
        """Puts pre-tokens into the cache, as their ids' bytes: those that are a token as they are, and the others as the model merges them."""
        rest, words = [], []
        for x in pre_tokens:
            raw = x.encode("utf-8", "replace")
            if (one := self.whole.get(raw)) is not None:
                self.cache[x] = one
            else:
                rest.append(x)
                words.append(x.replace(" ", "\u0120") if x.isascii() and x.isprintable() else raw.decode("latin-1").translate(CHARS))
        ids = self.pieces.encode(words, num_threads=1)
        ends = np.cumsum([0, *map(len, ids)]) * 4
        flat = self.order[np.fromiter(chain.from_iterable(ids), np.int64, ends[-1] // 4)].tobytes()
        self.cache.update((x, flat[i:j]) for x, i, j in zip(rest, ends.tolist(), ends[1:].tolist()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        found = [self.pre_tokens(x) for x in texts]
        seen = set().union(*found)
        fresh, older = [], self.older
        for x in seen.difference(self.cache):
            if (known := older.get(x)) is not None:
                self.cache[x] = known
            else:
                fresh.append(x)
        self.learn(fresh)
        get = self.cache.__getitem__
        ids = [np.frombuffer(b"".join(map(get, x)), np.int32) for x in found]
        for x in seen:
            if len(x) > CACHED_CHARS:
                del self.cache[x]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        places = self.place[ids]
        sizes = self.sizes[places]
        shift = np.repeat(self.starts[places] - (np.cumsum(sizes) - sizes), sizes)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


_CODERS: dict[str, Coder] = {}


def coder(model: bytes, ranks: list[tuple[bytes, int]], pattern: str, newer: str) -> Coder:
    """The worker's coder, kept for its next tasks."""
    key = hashlib.md5(model + pattern.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(model, ranks, pattern, newer)
    return _CODERS[key]


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ids and the bytes that they decode to.

    Returns id_col, ids array<int>, decoded binary: a row for each input row in
    any order, repeated rows and null ids included. A null or empty text has no
    ids. Texts are encoded whole, each match of the pattern separately, without
    special tokens. The vocabulary (a rank file of some 50,000 lines) is read
    on the driver and travels with the function; its size doesn't depend on the
    data. There is no shuffle, and memory is bounded by a slice of rows or the
    longest text.
    """
    ranks = read_ranks(vocabulary)
    model, pairs = serialise(ranks), sorted(ranks.items(), key=lambda x: x[1])
    small_batches(df.sparkSession)
    source = df.select(id_col, text_col)
    shared = source.sparkSession.sparkContext.broadcast((model, pairs, pattern, newer_characters(ranks, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        for part, texts in slices(batches):
            ids = own.encode(texts)
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array([own.decode(x) for x in ids], pa.binary())],
                names=[id_col, "ids", "decoded"],
            )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
