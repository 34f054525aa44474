"""Texts as audio: lossless 8-bit WAV, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches

#: Bytes of payload come in multiples of this.
UNIT = 576
#: Samples in a Fourier frame, and from one frame's start to the next. UNIT is a multiple of both, so no sample is left out.
FRAME, HOP = 288, 144
#: Samples a second that the header states.
RATE = 8000
#: Frames that are transformed at once; bounds memory whatever the length.
BLOCK = 4096
#: Band edges in Fourier bins (the lowest bins hold the mean); a frame has at most one peak in each band.
EDGES = (2, 16, 36, 80, 145)
#: A peak has at least so many times its frame's mean magnitude.
LOUD = 1.5
#: A peak is paired with the peaks of so many following frames.
FAN = 2

WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, then bytes 255 up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The 8-bit mono samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("only 8-bit mono is read")
        return w.readframes(w.getnframes())


def spectra(samples: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the short-time Fourier transform: number of the first frame, magnitudes (frames, FRAME // 2 + 1)."""
    data = np.frombuffer(samples, np.uint8)
    frames = max(0, (len(data) - FRAME) // HOP + 1)
    for first in range(0, frames, BLOCK):
        n = min(BLOCK, frames - first)
        part = data[first * HOP : (first + n - 1) * HOP + FRAME].astype(np.float32) - np.float32(128)
        framed = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * WINDOW
        yield first, np.abs(np.fft.rfft(framed, axis=1))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time (frame number) and frequency (bin) of the spectral peaks, by time and then frequency."""
    times, bins = [], []
    for first, size in spectra(samples):
        least = LOUD * size[:, EDGES[0] :].mean(axis=1)
        best = np.stack([lo + size[:, lo:hi].argmax(axis=1) for lo, hi in zip(EDGES, EDGES[1:])], axis=1)
        kept = np.take_along_axis(size, best, axis=1) >= least[:, None]
        row, _ = np.nonzero(kept)
        times.append(row + first)
        bins.append(best[kept])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs of peaks as sorted 64-bit numbers: time << 32 | bin << 18 | later bin << 4 | frames between.

    Each peak is paired with those of the FAN frames after it.
    """
    times, bins = peaks(samples)
    if not len(times):
        return np.zeros(0, np.int64)
    start = np.searchsorted(times, times, side="right")
    stop = np.searchsorted(times, times + FAN, side="right")
    count = stop - start
    one = np.repeat(np.arange(len(times)), count)
    two = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    return np.sort(times[one] << 32 | bins[one] << 18 | bins[two] << 4 | times[two] - times[one])


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text as a WAV file with what is read back from it.

    Returns id_col, n_bytes long (of the text as UTF-8), media binary (the
    file), samples binary (read back by the wave module), frames int, codes
    array<bigint> (the fingerprint). A row for each input row; a null text is an
    empty one, an empty text is UNIT bytes 255. Equal texts give equal values.
    No shuffle; memory is bounded by a slice of rows or the longest text.
    """
    small_batches(df.sparkSession)
    source = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            media = [write_wav(payload(x)) for x in texts]
            samples = [read_wav(x) for x in media]
            codes = [fingerprint(x) for x in samples]
            ends = np.cumsum([0, *map(len, codes)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x.encode("utf-8", "replace")) for x in texts], pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array(samples, pa.binary()),
                    pa.array([(len(x) - FRAME) // HOP + 1 for x in samples], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes))),
                ],
                names=[id_col, "n_bytes", "media", "samples", "frames", "codes"],
            )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary, samples binary, frames int, codes array<bigint>")
