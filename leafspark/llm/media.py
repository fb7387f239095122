"""Media columns: texts' bytes as lossless WebP images, stored, read back, and features of the pixels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column
from .webp import MAX_SIDE, PALETTE, SUBTRACT_GREEN, decode, encode

#: Pixels of a row, and so the unit of a payload.
WIDTH = 192
GREY, OPAQUE = np.uint32(0x10101), np.uint32(0xFF000000)


def to_image(payload: bytes) -> np.ndarray:
    """A payload (a multiple of WIDTH bytes) as a grey image, a byte a pixel. Images have MAX_SIDE rows at most, so
    longer payloads get wider rows; pixels that fill up the last one are transparent."""
    rows = len(payload) // WIDTH
    wide = WIDTH * -(-rows // MAX_SIDE)
    out = np.zeros(-(-len(payload) // wide) * wide, np.uint32)
    out[: len(payload)] = np.frombuffer(payload, np.uint8) * GREY | OPAQUE
    return out.reshape(-1, wide)


def from_image(pixels: np.ndarray) -> bytes:
    flat = pixels.ravel()
    return (flat[: int(np.count_nonzero(flat >> np.uint32(24)))] & np.uint32(255)).astype(np.uint8).tobytes()


def store(payload: bytes) -> bytes:
    """A palette where several pixels go into one, grey as green alone elsewhere; either is lossless."""
    used = np.count_nonzero(np.bincount(np.frombuffer(payload, np.uint8), minlength=256))
    return encode(to_image(payload), transforms=(PALETTE,) if used <= 16 else (SUBTRACT_GREEN,))


def feature(pixels: np.ndarray) -> str:
    """Size, sum of the grey values, and shares (of 1000, rounded down) of eight bands of grey."""
    grey = pixels.ravel() & np.uint32(255)
    bands = np.bincount(grey >> np.uint32(5), minlength=8) * 1000 // max(1, grey.size)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{int(grey.sum(dtype=np.int64))};{'.'.join(map(str, bands.tolist()))}"


RESULT = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _row(text: bytes | None) -> tuple:
    text = text or b""
    media = store(text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH)))
    pixels = decode(media)
    back = from_image(pixels)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)


def stored(text: Column) -> Column:
    """A binary column of WebP files; a null text counts as empty."""
    return struct_column(lambda texts: [[store((t or b"") + b" " * (-len(t or b"") % WIDTH or (0 if t else WIDTH))) for t in texts]], "media binary", text)["media"]


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of RESULT for every row: each text's bytes are padded with blanks to a positive multiple of
    WIDTH, stored as a WebP image, and all values but n_bytes come from the stored bytes. A null text counts as empty."""
    work = lambda texts: [list(x) for x in zip(*map(_row, texts))] or [[]] * 7
    return docs.select("doc_id", struct_column(work, RESULT, F.col("text")).alias("_r")).select("doc_id", "_r.*")
