import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hornweave.llm import media
from pyspark.sql import functions as F

from .helpers import documents, frame

SCHEMA = "doc_id long, text string"


def padded(raw):
    """The contract's payload, byte by byte."""
    out = list(raw)
    while not out or len(out) % 576:
        out.append(255)
    return bytes(out)


def samples(png):
    """A plain reader of greyscale 8-bit PNG with the filters None, Sub and Up, by single samples."""
    at, body = 8, b""
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        content = png[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + content) == struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", content)
            assert rest == [8, 0, 0, 0, 0]
        body += content if kind == b"IDAT" else b""
        at += 12 + size
    data, rows = zlib.decompress(body), []
    for y in range(height):
        line, row = data[y * (width + 1) : (y + 1) * (width + 1)], []
        for x in range(width):
            before = [0, row[x - 1] if x else 0, rows[-1][x] if rows else 0][line[0]]
            row.append((line[1 + x] + before) % 256)
        rows.append(row)
    return rows


def feature(rows):
    """Signs of the 8 x 8 lowest cosine frequencies of a 24 x 24 box average, against their median."""
    height, width = len(rows), len(rows[0])
    box = lambda k, n: range(k * n // 24, max(k * n // 24 + 1, (k + 1) * n // 24))
    mean = [[sum(rows[y][x] for y in box(i, height) for x in box(j, width)) / (len(box(i, height)) * len(box(j, width))) for j in range(24)] for i in range(24)]
    wave = [[math.cos(math.pi * u * (2 * i + 1) / 48) for i in range(24)] for u in range(8)]
    low = [round(sum(wave[u][i] * mean[i][j] * wave[v][j] for i in range(24) for j in range(24)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join(str(int(x > middle)) for x in low), 2):016x}"


def brute(text, stored):
    raw = (text or "").encode()
    p = padded(raw)
    rows = samples(stored)
    assert bytes(v for r in rows for v in r) == p
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(rows)


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t, *_ in documents() if len(t or "") < 9000] + [(300, "ab" * 288), (301, "é" * 4000)]
    stored = media.store(frame(spark, rows, SCHEMA))
    image = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    out = media.digest(media.load(stored)).collect()
    assert len(out) == len(rows)
    want = {(i, *brute(t, image[i, len((t or "").encode())])) for i, t in rows}
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in out} == want
    same = [r for r in out if r.doc_id == 1]
    assert len(same) == 3 and len({(r.media_sha256, r.feature) for r in same}) == 1


def test_long_texts_go_block_by_block(spark, monkeypatch):
    text = "".join(chr(97 + k * k % 26) for k in range(300_000))
    payload = padded(text.encode())
    whole = media.encode_png(payload)
    hashed = media.cosine_hash(media.decode_png(whole))
    monkeypatch.setattr(media, "BLOCK_ROWS", 7)
    png = media.encode_png(payload)
    image = media.decode_png(png)
    assert image.tobytes() == media.decode_png(whole).tobytes() == payload and media.cosine_hash(image) == hashed
    out = media.digest(media.load(media.store(frame(spark, [(1, text * 20)], SCHEMA)))).first()
    assert out.payload_sha256 == hashlib.sha256(padded((text * 20).encode())).hexdigest()


def test_standard_reader_accepts_it(spark):
    """The Java library's reader gives the same samples."""
    for payload in (bytes(range(256)) * 9, padded("hello wörld".encode()), padded(("some text\n" * 900).encode())):
        png = media.encode_png(payload)
        jvm = spark.sparkContext._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png)))
        raster = image.getRaster()
        assert (raster.getWidth(), raster.getNumBands()) == (576, 1)
        assert [raster.getSample(x, y, 0) for y in (0, raster.getHeight() - 1) for x in range(0, 576, 5)] == [payload[y * 576 + x] for y in (0, len(payload) // 576 - 1) for x in range(0, 576, 5)]
        assert media.decode_png(png).tobytes() == payload


def test_every_filter_is_undone():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (10, 7)).astype(int)
    rows = np.zeros((10, 8), dtype=np.uint8)
    for y in range(10):
        kind = rows[y, 0] = y % 5
        for x in range(7):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x + 1] = (image[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfilter_rows(rows) == image).all()
    above = image[4].astype(np.uint8)
    assert (media.unfilter_rows(rows[5:], above) == image[5:]).all()


def test_damage_is_noticed():
    png = media.encode_png(padded(b"hello"))
    for bad in (png[:60] + bytes([png[60] ^ 1]) + png[61:], png[:-12], b"x" + png):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    two = media.encode_png(padded(b"x" * 1000))
    header = lambda h: struct.pack(">IIBBBBB", 576, h, 8, 0, 0, 0, 0)
    for height in (1, 3):
        with pytest.raises(ValueError, match="number of samples"):
            media.decode_png(two[:8] + media._chunk(b"IHDR", header(height)) + two[33:])


def test_hash_is_robust_to_brightness():
    image = np.add.outer(np.arange(48), 2 * np.arange(60)).astype(np.uint8)
    assert media.cosine_hash(image) == media.cosine_hash(image + np.uint8(9))


def test_null_images_clashing_columns_and_empty_table(spark):
    docs = frame(spark, [(1, "a", "x", 2)], "doc_id long, text string, MEDIA string, phash int")
    stored = media.store(docs)
    assert stored.columns == ["doc_id", "phash", "media", "n_bytes"]
    loaded = media.load(stored.unionByName(stored.withColumn("media", F.lit(None).cast("binary")).withColumn("doc_id", F.lit(2).cast("long"))))
    assert loaded.columns == ["doc_id", "media", "n_bytes", "payload", "phash"]
    assert {r.doc_id: r.payload and len(r.payload) for r in loaded.collect()} == {1: 576, 2: None}
    assert media.load(media.store(frame(spark, [], SCHEMA))).count() == 0
