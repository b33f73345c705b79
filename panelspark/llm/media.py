"""Media columns: byte payloads as PNG images in binary columns, and perceptual hashes of them.

An image is 8-bit RGB, 64 pixels wide: 192 bytes a row.  ``encode_media`` stores a text's UTF-8 bytes,
filled with spaces to a positive multiple of 192; ``media_features`` reads the stored bytes back through a
strict decoder (signature, chunk order, CRC of every chunk, zlib's own checksum, sizes, all five row filters)
and hashes the low frequencies of a cosine transform.

Both are narrow passes: no shuffle, memory bounded by one Arrow batch, nothing that depends on other rows.
Null text counts as empty; an empty text is one row of spaces.  Equal payloads give equal bytes and hashes.
Columns of the input other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, texts_of

WIDTH = 64
CHANNELS = 3
ROW = WIDTH * CHANNELS
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Row filters that a writer chooses from: none, Sub and Up, which a reader undoes by sums over whole rows and columns.
ADAPTIVE = (0, 1, 2)
_IHDR = struct.Struct(">IIBBBBB")


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of one image row."""
    rows = max(1, -(-len(data) // ROW))
    return data.ljust(rows * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _filtered(rows: np.ndarray, kinds: tuple[int, ...]) -> list[np.ndarray]:
    """The rows after each of the row filters ``kinds``."""
    x = rows.astype(np.int16)
    left, up, corner = (np.zeros_like(x) for _ in range(3))
    left[:, CHANNELS:] = x[:, :-CHANNELS]
    up[1:] = x[:-1]
    corner[1:, CHANNELS:] = x[:-1, :-CHANNELS]
    guess = {0: lambda: 0, 1: lambda: left, 2: lambda: up, 3: lambda: (left + up) >> 1, 4: lambda: _paeth(left, up, corner)}
    return [(x - guess[kind]()).astype(np.uint8) for kind in kinds]


def encode_png(payload: bytes, filter_type: int | None = None, level: int = 6) -> bytes:
    """A PNG of ``payload``, whose length is a positive multiple of 192.

    Unless ``filter_type`` names one for all rows, each row gets that of the filters ADAPTIVE whose differences, taken
    as signed bytes, have the least sum (ties: the first).
    """
    if not payload or len(payload) % ROW:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    if filter_type is None:
        made = np.stack(_filtered(rows, ADAPTIVE))
        which = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        lines[:, 0] = np.array(ADAPTIVE, np.uint8)[which]
        lines[:, 1:] = made[which, np.arange(len(rows))]
    else:
        lines[:, 0] = filter_type
        lines[:, 1:] = _filtered(rows, (filter_type,))[0]
    header = _IHDR.pack(WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    kinds, rows = lines[:, 0], lines[:, 1:]
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    if kinds.max() > 2:
        return _diagonals(kinds, rows, bpp)
    out = rows.copy()
    sub = kinds == 1
    if sub.any():
        pixels = rows[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.add.accumulate(pixels, axis=1, dtype=np.uint8).reshape(len(pixels), -1)
    up = kinds == 2
    if up.any():
        # sums down the columns, less what lies above the last row that doesn't refer to the one over it
        sums = np.add.accumulate(out, axis=0, dtype=np.uint8)
        start = np.maximum.accumulate(np.where(up, 0, np.arange(len(kinds))))
        before = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), sums])[start]
        out[up] = (sums - before)[up]
    return out


def _diagonals(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """All five filters: pixels of a diagonal need those of the two diagonals before alone, so each is one step."""
    height, width = len(rows), rows.shape[1] // bpp
    pixels = rows.reshape(height, width, bpp).astype(np.int16)
    out = np.zeros((height + 1, width + 1, bpp), np.int16)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, _paeth(left, up, corner)], 0)
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit RGB PNG as (height, width, 3); ValueError for anything damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kinds, header, data = 8, [], None, []
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(media):
            raise ValueError("cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        kinds.append(kind)
        if kind == b"IHDR":
            header = _IHDR.unpack(body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if header is None or kinds[0] != b"IHDR" or kinds[-1] != b"IEND" or not data:
        raise ValueError("chunks are missing")
    width, height, *form = header
    if form != [8, 2, 0, 0, 0]:
        raise ValueError("only 8-bit RGB without interlacing")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * CHANNELS + 1):
        raise ValueError("wrong size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * CHANNELS + 1)
    return np.ascontiguousarray(_unfilter(lines, CHANNELS)).reshape(height, width, CHANNELS)


@lru_cache(maxsize=256)
def _cosines(n: int, k: int = 8) -> np.ndarray:
    return np.cos(np.pi / (2 * n) * np.outer(np.arange(k), 2 * np.arange(n) + 1))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the luma lie above their median (the constant one aside)."""
    luma = samples.astype(np.int32) @ np.array([77, 150, 29], np.int32) >> 8
    low = _cosines(luma.shape[0]) @ luma @ _cosines(luma.shape[1]).T
    low = np.round(low.reshape(-1), 6)
    return np.packbits(np.concatenate([[False], low[1:] > np.median(low[1:])])).tobytes()


def _encode(filter_type: int | None, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                data = b"" if text.as_py() is None else text.as_buffer().to_pybytes()
                sizes.append(len(data))
                media.append(encode_png(pad(data), filter_type, level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_type: int | None = None, level: int = 6) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (PNG bytes): one row per input row."""
    return texts_of(df, id_col, text_col).mapInArrow(_encode(filter_type, level), "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc, size, cell in zip(*(batch.column(c) for c in range(3)), strict=True):
            media = cell.as_py()
            if media is None:
                values = (None,) * 6
            else:
                samples = decode_png(media)
                payload = samples.tobytes()
                values = (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), cosine_hash(samples))
            for row, value in zip(rows, (doc.as_py(), size.as_py(), *values), strict=True):
                row.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)


def media_features(df: DataFrame) -> DataFrame:
    """Reads ``media`` back: payload size, digests and the cosine hash (binary); nulls for null media."""
    need(df, "doc_id", "n_bytes", "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)
