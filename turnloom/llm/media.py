"""Media columns: texts as grayscale PNG images in binary columns, and cosine-transform hashes of the images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: Payloads are multiples of this, images WIDTH wide.
UNIT, WIDTH = 576, 96

SIGNATURE = b"\x89PNG\r\n\x1a\n"

#: Images that leave a task together.
ROWS = 500


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """8-bit grayscale, rows of filter type 0, or 2 (differences to the row above) where that has the smaller sum."""
    height, width = samples.shape
    above = np.concatenate((np.zeros((1, width), np.uint8), samples[:-1]))
    up = samples - above
    size = lambda x: np.minimum(x, 256 - x.astype(np.int32)).sum(1)
    use = size(up) < size(samples)
    rows = np.concatenate((np.where(use, 2, 0).astype(np.uint8)[:, None], np.where(use[:, None], up, samples)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undoes the five filters for one byte a sample."""
    kinds, body = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    if (kinds > 2).any():
        return _by_diagonals(kinds, body)
    out = body.copy()
    sub = np.flatnonzero(kinds == 1)
    out[sub] = np.cumsum(body[sub], axis=1, dtype=np.uint64).astype(np.uint8)
    # neighbouring rows of type 2 add up from the row above them
    cut = np.flatnonzero(np.diff(kinds == 2)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
        if kinds[s] == 2:
            total = np.cumsum(body[s:e], axis=0, dtype=np.uint64)
            out[s:e] = (total + (out[s - 1] if s else 0)).astype(np.uint8)
    return out


def _by_diagonals(kinds: np.ndarray, body: np.ndarray) -> np.ndarray:
    """All samples whose row and column add up to one number depend on smaller ones only, so they are undone together."""
    height, width = body.shape
    out = np.zeros((height + 1, width + 1), np.int16)
    for k in range(height + width - 1):
        y = np.arange(max(0, k - width + 1), min(height, k + 1))
        x = k - y
        left, above, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y]
        toward = left + above - corner
        far = np.abs(np.stack((toward - left, toward - above, toward - corner)))
        nearest = np.choose(far.argmin(0), (left, above, corner))  # of equally near ones the first
        out[y + 1, x + 1] = (body[y, x] + np.choose(kind, (np.zeros_like(left), left, above, (left + above) // 2, nearest))) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit grayscale PNG without interlacing. Raises ValueError where a checksum or the form is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("cut short")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grayscale image")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(rows) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(rows.reshape(head[1], head[0] + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


def _shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Means over n stripes of rows, or repeated rows where there are fewer."""
    m = len(x)
    edges = np.arange(n + 1) * m // n
    total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)))
    begin, end = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    return (total[end] - total[begin]) / (end - begin)[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 image lie above their median (the mean left out)."""
    small = _shrunk(_shrunk(samples, 32).T, 32).T
    low = np.round(_cosines(32, 8) @ small @ _cosines(32, 8).T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            texts = texts_of(part.column(1))
            media = [encode_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            back = [decode_png(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary()), pa.array([b.tobytes() for b in back], pa.binary()), pa.array(list(map(cosine_hash, back)), pa.binary())],
                names=["id", "n_bytes", "media", "payload", "feature"],
            )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a PNG in a binary column, reads that back and computes features of what was read.

    The payload is the text's UTF-8 bytes with bytes 255 up to a positive multiple of 576; null is an empty text.
    Returns id_col, n_bytes (unpadded), media (the PNG), payload (as read back), feature (8 bytes: a cosine-transform
    hash). Equal texts have equal values; repeated rows and null ids are kept. A long text is one image; an empty table
    has an empty result. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = own.schema["id"].dataType.simpleString()
    return arrow_map(own, _images, f"id {kind}, n_bytes long, media binary, payload binary, feature binary").withColumnRenamed("id", id_col)
