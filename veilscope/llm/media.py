"""Media columns: texts stored as WAV, read back, and fingerprinted by pairs of spectral peaks.

``encode_wav`` stores each payload as unsigned 8-bit mono samples through the ``wave`` module, ``landmarks`` takes a
short-time Fourier transform of the stored samples, keeps the strongest bin of each band that stands out in time,
and pairs each such peak with those that follow. A pair is coded as ``band bins and distance`` with the time of its
first peak, so that a fingerprint is two parallel arrays (``times``, ``codes``), ordered by time.

Cases: a null or empty text is one block of blanks; equal texts give equal files and fingerprints; a text of any
length is read whole (frames are transformed block by block); an empty table gives an empty table; columns of the
input other than the key and the text are not touched and cannot clash, as both are renamed on entry.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_slices, stored

BLOCK = 192
RATE = 8000
FRAME, HOP = 192, 96
#: Bins of the bands in each of which a frame may have one peak (fixed values).
BANDS = ((1, 12), (12, 36), (36, 97))
FOLLOWERS, MAX_GAP = 3, 31
_FRAMES_AT_ONCE = 4096


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def decode_wav(stored_bytes: bytes) -> bytes:
    with wave.open(io.BytesIO(stored_bytes), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return f.readframes(f.getnframes())


def _band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its magnitude for each frame and band; the last frame is filled up with silence."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    full = np.zeros((n - 1) * HOP + FRAME, np.float32)
    full[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(full, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    bins, mags = np.empty((n, len(BANDS)), np.int32), np.empty((n, len(BANDS)), np.float32)
    for at in range(0, n, _FRAMES_AT_ONCE):
        spectrum = np.abs(np.fft.rfft(frames[at : at + _FRAMES_AT_ONCE] * window, axis=1))
        for b, (lo, hi) in enumerate(BANDS):
            top = spectrum[:, lo:hi].argmax(1)
            bins[at : at + len(top), b] = top + lo
            mags[at : at + len(top), b] = spectrum[np.arange(len(top)), top + lo]
    return bins, np.round(mags, 2)


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs; ``samples`` are centred amplitudes."""
    bins, mags = _band_peaks(samples)
    edge = np.full((1, mags.shape[1]), -1, np.float32)
    before, after = np.vstack([edge, mags[:-1]]), np.vstack([mags[1:], edge])
    when, band = np.nonzero((mags > before) & (mags >= after) & (mags > 0))
    which = bins[when, band]
    times, codes = [], []
    for step in range(1, FOLLOWERS + 1):
        gap = when[step:] - when[:-step]
        near = gap <= MAX_GAP
        times.append(when[:-step][near])
        codes.append((which[:-step][near] << 12 | which[step:][near] << 5 | gap[near]).astype(np.int64))
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def describe(stored_bytes: bytes) -> dict:
    """What the stored bytes hold: payload digests and the fingerprint."""
    payload = decode_wav(stored_bytes)
    times, codes = landmarks(np.frombuffer(payload, np.uint8).astype(np.float32) - 128)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(stored_bytes),
        "media_sha256": hashlib.sha256(stored_bytes).hexdigest(),
        "times": times,
        "codes": codes,
    }


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_bytes`` and ``media`` (a WAV file) for each row."""
    kind = df.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("key", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(rows: dict[str, list]) -> dict[str, list]:
        pairs = [payload_of(t) for t in rows["text"]]
        return {"key": rows["key"], "n_bytes": [n for _, n in pairs], "media": [encode_wav(p) for p, _ in pairs]}

    return map_slices(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), encode, schema, 256)


def fingerprints(media: DataFrame) -> DataFrame:
    """Digests and fingerprint of a table from ``to_media``.

    The fingerprint is the arrays ``times`` and ``codes``; ``feature`` sums it up as ``pairs:checksum:most frequent
    codes``."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("key", to_arrow_type(media.schema["key"].dataType)), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def read(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        out["key"], out["n_bytes"] = rows["key"], rows["n_bytes"]
        for stored_bytes in rows["media"]:
            d = describe(stored_bytes)
            codes, counts = np.unique(d["codes"], return_counts=True)
            top = codes[np.lexsort((codes, -counts))[:4]]
            d["feature"] = f"{len(d['times'])}:{zlib.crc32(d['times'].tobytes() + d['codes'].tobytes()):08x}:" + ",".join(map(str, top))
            for name in out.keys() & d.keys():
                out[name].append(d[name])
        return out

    return map_slices(media, read, schema, 256)


def media_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the media column as a table in the shared folder, read it back and fingerprint what was read."""
    return fingerprints(stored(to_media(df, key, text), "media")).withColumnRenamed("key", key)
