"""Media columns: bytes as PNG images in a binary column, checked and decoded again, with a visual hash.

A payload is a grey 8-bit image of 64 samples a row. The encoder filters each row with the predictor that
leaves the smallest sum of differences (none, left or up), deflates, and writes chunks with checksums. The
decoder tests every checksum, inflates, and undoes all five filters with numpy: runs of the plain ones by
sums, mixed images along diagonals, on which no sample depends on another.

Defined cases: a null text is empty; an empty text is one block of zeros. Equal texts give equal results;
repeated rows, null ids and extra columns make no difference.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.llm.common import kept, stretches, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Samples of a pixel by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
CHUNK = 1 << 20
HASH_SIDE, GRID = 8, 32
#: Bytes of texts, or of images, that are Python objects at once; a longer one ends its stretch.
STRETCH = 1 << 19
#: What the decoded images give.
FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "feature": "binary"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """PNG of rows × columns grey samples, or rows × columns × channels."""
    h, w = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    color = next(c for c, n in CHANNELS.items() if n == channels)
    rows = np.ascontiguousarray(samples, np.uint8).reshape(h, w * channels)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    up[1:] = rows[:-1]
    tries = np.stack([rows, rows - left, rows - up])
    size = np.minimum(tries, 0 - tries).sum(axis=2, dtype=np.int64)
    kind = size.argmin(axis=0)
    raw = np.empty((h, w * channels + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, tries[kind, np.arange(h)]
    data = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of every chunk; a wrong checksum or length is an error."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png):
            raise ValueError("chunk is cut off")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + size


def unfilter(raw: np.ndarray, kind: np.ndarray, channels: int) -> np.ndarray:
    """Samples of filtered rows; ``kind`` is each row's filter, 0 to 4."""
    h, w = raw.shape
    if kind.max(initial=0) <= 2:
        out = raw.copy()
        left = kind == 1
        if left.any():
            pixels = raw[left].reshape(-1, w // channels, channels)
            out[left] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(-1, w)
        ups = np.flatnonzero(kind == 2)
        for run in np.split(ups, np.flatnonzero(np.diff(ups) != 1) + 1) if len(ups) else ():
            base = out[run[0] - 1] if run[0] else np.zeros(w, np.uint8)
            out[run] = np.cumsum(out[run], axis=0, dtype=np.uint8) + base
        return out
    px = raw.reshape(h, w // channels, channels).astype(np.int16)
    out = np.zeros((h + 1, w // channels + 1, channels), np.int16)
    for d in range(h + w // channels - 1):
        y = np.arange(max(0, d - w // channels + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        k = kind[y][:, None]
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) // 2, paeth], 0)
        out[y + 1, x + 1] = (px[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, w).astype(np.uint8)


def decode_png(png: bytes) -> np.ndarray:
    """Rows × columns × channels of an 8-bit PNG without interlacing."""
    head, data, ended = None, [], False
    for kind, part in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("a chunk is missing")
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or color not in CHANNELS or interlaced:
        raise ValueError("only 8-bit images without palette and interlacing")
    channels = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != h * (w * channels + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(h, w * channels + 1)
    if raw[:, 0].max(initial=0) > 4:
        raise ValueError("unknown filter")
    return unfilter(raw[:, 1:], raw[:, 0], channels).reshape(h, w, channels)


_K = np.arange(GRID)
#: The lowest cosine waves over the grid, constant one included.
WAVES = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(HASH_SIDE)[:, None] / (2 * GRID))


def _edges(n: int) -> np.ndarray:
    return np.minimum(np.arange(GRID) * n // GRID, n - 1)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest cosine coefficients of the image, averaged to a grid, are above
    their median; the constant one counts as 0."""
    grey = samples.mean(axis=2, dtype=np.float64) if samples.ndim == 3 else samples.astype(np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= GRID:
            at = _edges(n)
            counts = np.diff(np.append(at, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            grey = np.add.reduceat(grey, at, axis=axis) / counts
        else:
            grey = grey.take(_edges(n), axis=axis)
    waves = np.round(WAVES @ grey @ WAVES.T, 6).ravel()
    waves[0] = 0.0
    return np.packbits(waves > np.median(waves[1:])).tobytes()


def to_samples(payload: bytes) -> np.ndarray:
    """The payload, filled with zeros to a positive multiple of a row, as an image of such rows."""
    rows = max(1, -(-len(payload) // WIDTH))
    return np.frombuffer(payload.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def store_texts(docs: DataFrame, level: int = 3) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (s for batch in batches for s in stretches(batch, "text", STRETCH)):
            payloads = [t or b"" for t in given.column("text").to_pylist()]
            made = [pa.array([len(p) for p in payloads], pa.int64()), pa.array([encode_png(to_samples(p), level) for p in payloads], pa.binary())]
            yield pa.RecordBatch.from_arrays([given.column("doc_id"), *made], ["doc_id", "n_bytes", "media"])

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(stored: DataFrame, media: str = "media") -> DataFrame:
    """Add what the decoded images give: payload_bytes, payload_sha256, tail_crc32 and the cosine hash ``feature`` (binary)."""

    def read(png: bytes) -> tuple[int, str, int, bytes]:
        samples = decode_png(png)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (s for batch in batches for s in stretches(batch, media, STRETCH)):
            own = zip(*(read(png) for png in given.column(media).to_pylist()))
            made = [pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.string(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*given.columns, *made], [*given.schema.names, *FEATURES])

    schema = StructType(list(stored.schema.fields))
    for name, kind in FEATURES.items():
        schema = schema.add(name, kind)
    return stored.mapInArrow(run, schema)


def op7_media(spark: SparkSession, folder: str) -> DataFrame:
    stored = kept(store_texts(table(spark, folder, "documents")), "media")
    return media_features(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )
