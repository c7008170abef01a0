"""Media columns: texts as PNG images in binary columns, and cosine-transform hashes of them.

A PNG is written and read here with zlib chunks, every chunk's checksum tested and the
five row filters undone in numpy. The hash keeps the signs of the 8 x 8 lowest
frequencies of a 24 x 24 box-averaged thumbnail against their median.

Defined cases: null text is empty; a payload is padded with bytes 255 to a positive
multiple of 576; equal texts give equal values; a null image gives null samples and hash;
a damaged image raises ValueError; of a very long text the payload, the image and a
block of rows are in memory at once; columns of the input named as added ones (in any
case) are replaced.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

#: Samples in a row; a payload's rows are full.
WIDTH = 576
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
THUMB, LOW = 24, 8
#: Rows that are filtered, unfiltered or averaged together.
BLOCK_ROWS = 2048


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(image: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: of no filter, Sub and Up, the one with the least sum of absolute differences. ``above`` is the row before them."""
    height, width = image.shape
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[0] -= above
    up[1:] -= image[:-1]
    options = np.stack([image, sub, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    out = np.empty((height, width + 1), dtype=np.uint8)
    out[:, 0] = kind
    out[:, 1:] = options[kind, np.arange(height)]
    return out


def unfilter_rows(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """Undoes filters 0 to 4 of 8-bit greyscale rows. ``above`` is the row before them, zeros for the first."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    above = np.zeros(out.shape[1], dtype=np.uint8) if above is None else above
    for y, kind in enumerate(kinds.tolist()):
        row = out[y]
        if kind == SUB:
            np.cumsum(row, dtype=np.uint8, out=row)
        elif kind == UP:
            row += above
        elif kind == AVERAGE:
            left = 0
            for x, (v, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                row[x] = left = (v + (left + b) // 2) & 255
        elif kind == PAETH:
            left = corner = 0
            for x, (v, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                p = left + b - corner
                nearest = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                row[x] = left = (v + nearest) & 255
                corner = b
        elif kind != NONE:
            raise ValueError(f"unknown row filter {kind}")
        above = row
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale 8-bit PNG whose samples are the payload."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    packer, body, above = zlib.compressobj(level), [], np.zeros(width, dtype=np.uint8)
    for top in range(0, len(image), BLOCK_ROWS):
        block = image[top : top + BLOCK_ROWS]
        body.append(packer.compress(filter_rows(block, above)))
        above = block[-1]
    body.append(packer.flush())
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", b"".join(body)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height, width) of a greyscale 8-bit PNG, after testing every chunk's checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a complete greyscale 8-bit PNG")
    width, height = header[:2]
    out, above, got, left = np.empty((height, width), dtype=np.uint8), None, 0, b""
    unpacker, feed = zlib.decompressobj(), b"".join(body)
    while feed or not unpacker.eof:
        data = left + unpacker.decompress(feed, BLOCK_ROWS * (width + 1))
        feed, n = unpacker.unconsumed_tail, len(data) // (width + 1)
        if not n and not feed:
            break
        if got + n > height:
            raise ValueError("wrong number of samples")
        if n:
            block = unfilter_rows(np.frombuffer(data, np.uint8, n * (width + 1)).reshape(n, width + 1), above)
            out[got : got + n], above, got = block, block[-1], got + n
        left = data[n * (width + 1) :]
    if got != height or left or not unpacker.eof:
        raise ValueError("wrong number of samples")
    return out


def _boxes(length: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(THUMB) * length // THUMB
    return start, np.maximum(start + 1, (np.arange(THUMB) + 1) * length // THUMB)


_COSINES = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(THUMB)[None] + 1) / (2 * THUMB))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits in 8 bytes."""
    (y0, y1), (x0, x1) = _boxes(image.shape[0]), _boxes(image.shape[1])
    total = np.zeros((THUMB, THUMB), dtype=np.int64)
    for top in range(0, len(image), BLOCK_ROWS):
        block = image[top : top + BLOCK_ROWS]
        run = np.zeros((len(block), image.shape[1] + 1), dtype=np.int64)
        block.cumsum(axis=1, dtype=np.int64, out=run[:, 1:])
        columns = run[:, x1] - run[:, x0]
        for k, (a, b) in enumerate(zip((y0 - top).clip(0), (y1 - top).clip(0, len(block)), strict=True)):
            if a < b:
                total[k] += columns[a:b].sum(axis=0)
    thumb = total / np.outer(y1 - y0, x1 - x0)
    low = np.round(_COSINES @ thumb @ _COSINES.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, text: str = "text", level: int = 6) -> DataFrame:
    """Replaces ``text`` by a binary column ``media`` and its unpadded ``n_bytes``."""

    def run(texts):
        payloads = [payload_of(t) for t in texts]
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return [[encode_png(p, level=level) for p in payloads], sizes]

    return append_columns(docs, text, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], run).drop(text)


def load(stored: DataFrame, media: str = "media") -> DataFrame:
    """Reads ``media`` back: appends ``payload`` (its samples) and ``phash`` (binary)."""

    def run(images):
        decoded = [None if x is None else decode_png(x) for x in images]
        return [[None if x is None else x.tobytes() for x in decoded], [None if x is None else cosine_hash(x) for x in decoded]]

    return append_columns(stored, media, [T.StructField("payload", T.BinaryType()), T.StructField("phash", T.BinaryType())], run)


def digest(loaded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return loaded.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("phash")).alias("feature"),
    )
