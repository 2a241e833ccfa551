"""Media columns: texts kept as 8-bit WAV, read back by ``wave``; STFT peak-pair fingerprints.

A payload is the UTF-8 text followed by bytes 255 up to a positive multiple of ``FRAME``. A null
text counts as empty, so its payload is one frame of 255. Equal texts give equal media and
fingerprints. Each row stands alone: no shuffle, memory bounded by one step or one long text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STEP, encoded, lists, steps

#: Samples of a window; half of it is the hop. Payloads are padded to multiples of it.
FRAME = 576
RATE = 8000
#: Bins at which the spectrum is cut into bands; each band gives one peak.
BANDS = (1, 16, 64, 144, 289)
#: Frames ahead in which an anchor looks for partners.
AHEAD = 2  # and 0: the anchor's own frame


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc id, n_bytes (unpadded), media (WAV bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            texts = encoded(part.column(1))
            media = [to_wav(t + b"\xff" * ((-len(t)) % FRAME or (0 if t else FRAME))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprint(payloads: list[bytes]) -> list[np.ndarray]:
    """Of each payload, its codes ``time << 32 | bin << 20 | other bin << 8 | frames between``, in order."""
    x = np.frombuffer(b"".join(payloads), np.uint8)
    hop = FRAME // 2
    ends = np.cumsum([len(p) // hop for p in payloads])
    starts = np.concatenate([[0], ends[:-1]])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    window = np.hanning(FRAME).astype(np.float32)
    peaks, loud = [], []
    for at in range(0, len(frames), 2048):  # bounds memory for a long text
        part = frames[at : at + 2048].astype(np.float32)
        s = np.abs(np.fft.rfft((part - 128) * window))
        best = [s[:, lo:hi].argmax(1) + lo for lo, hi in zip(BANDS, BANDS[1:], strict=False)]
        peaks.append(np.stack(best, 1))
        loud.append(np.take_along_axis(s, peaks[-1], 1))
    peak, loud = np.concatenate(peaks), np.concatenate(loud)
    out = []
    for a, b in zip(starts, ends, strict=True):
        p, v = peak[a : b - 1], loud[a : b - 1]
        anchor = np.take_along_axis(p, v.argmax(1)[:, None], 1)[:, 0].astype(np.int64)
        codes = []
        for gap in range(min(AHEAD, len(p) - 1) + 1):
            t = np.arange(len(p) - gap, dtype=np.int64)
            codes.append(((t << 32) | (anchor[: len(t)] << 20) | gap)[:, None] | (p[gap:].astype(np.int64) << 8))
        out.append(np.sort(np.concatenate(codes, axis=None)))
    return out


def media_features(df: DataFrame) -> DataFrame:
    """Reads ``media`` back and adds what it holds: digests and ``fingerprints`` (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "media", STEP // 2):
            media = part.column(2).to_pylist()
            payload = [from_wav(m) for m in media]
            prints = fingerprint(payload)
            digest = [f"{len(p) // (FRAME // 2) - 1}:{len(f)}:{hashlib.blake2b(f.tobytes(), digest_size=16).hexdigest()}" for p, f in zip(payload, prints, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(p) for p in payload], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                    pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(digest),
                    lists(np.concatenate(prints), [len(f) for f in prints]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprints"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprints array<long>"
    return df.mapInArrow(run, schema)
