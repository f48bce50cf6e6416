"""PNG: exact round trips, every filter, broken files."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import media


def filtered(rows, kind, channels):
    """Filter rows by the standard's definition, sample by sample."""
    h, w = rows.shape
    out = np.zeros((h, w + 1), np.uint8)
    for y in range(h):
        out[y, 0] = kind[y]
        for x in range(w):
            a = int(rows[y, x - channels]) if x >= channels else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - channels]) if y and x >= channels else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x + 1] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, best][kind[y]]) % 256
    return out


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (0, 1, 2), (3,), (4,), (0, 1, 2, 3, 4)])
def test_filters(channels, kinds):
    rng = np.random.default_rng(channels)
    rows = rng.integers(0, 256, (9, 7 * channels), dtype=np.uint8)
    kind = [kinds[i % len(kinds)] for i in range(9)]
    color = next(c for c, n in media.CHANNELS.items() if n == channels)
    raw = zlib.compress(filtered(rows, kind, channels).tobytes())
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, color, 0, 0, 0)) + media._chunk(b"IDAT", raw[:5]) + media._chunk(b"IDAT", raw[5:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png).reshape(9, -1) == rows).all()
    image = rows.reshape(9, 7, channels)
    assert (media.decode_png(media.encode_png(image)) == image).all()


def test_broken_files():
    png = media.encode_png(media.to_samples(b"some text " * 30))
    for bad in (png[:-3], b"x" + png[1:], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:33] + png[-12:], png[:-12]):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bad)


def test_texts(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long and wide " * 30000, "a"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.media_features(media.kept(media.store_texts(df), "test")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert media.store_texts(df.limit(0)).count() == 0


def test_hash_survives_small_changes():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:120, 0:64]
    image = (128 + 100 * np.sin(x / 9) * np.cos(y / 17)).astype(np.uint8)
    noisy = np.clip(image + rng.integers(-4, 5, image.shape), 0, 255).astype(np.uint8)
    other = (128 + 100 * np.sin(x / 3 + 1) * np.cos(y / 5)).astype(np.uint8)
    bits = [int.from_bytes(media.cosine_hash(i)) for i in (image, noisy, other)]
    assert (bits[0] ^ bits[1]).bit_count() <= 14 < (bits[0] ^ bits[2]).bit_count()


def test_a_stretch_of_a_batch_at_a_time(spark, monkeypatch):
    """Both Python steps give out a batch in small parts, in order, however many rows Spark hands over at once."""
    monkeypatch.setattr(media, "STRETCH", 100)
    parts = 7
    df = spark.createDataFrame([(i, "ab " * 20) for i in range(2 * parts)], "doc_id long, text string").coalesce(1)
    sizes = []

    class Given:  # stands for a frame whose rows are one batch
        def __init__(self, df):
            self.schema, self.table = df.schema, df.toArrow()

        def mapInArrow(self, run, schema):
            sizes.append([b.num_rows for b in run(iter(self.table.combine_chunks().to_batches()))])
            return df

    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: Given(self).mapInArrow(run, schema))
    media.store_texts(df)
    media.media_features(df.select("doc_id", F.lit(media.encode_png(media.to_samples(b"ab " * 20))).alias("media")))
    assert sizes[0] == [2] * parts
    assert len(sizes[1]) > 1 and sum(sizes[1]) == 2 * parts
