"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images to NPY tiles with hashes.

Decoded: Netpbm P1 to P6 with 8-bit samples, and uncompressed BMP of 8, 24 or 32 bits (32 also by bit fields of whole
bytes). Images are arrays of height x width x channels of uint8. Resizing averages over boxes with fractional edges;
sums come from an integral image that is built strip by strip and kept only at the rows and columns that the boxes
need. A strip holds ``_STRIP`` samples (or one row), whatever the width, so memory is bounded by a strip and the medium.

Defined cases: a null medium, one that can't be decoded (no such format, cut off, with samples above their maximum or
numbers beyond 64 bits) and an image without pixels give null columns, and no medium is an error; repeated rows give
equal values; an empty table gives an empty result; columns of the input that are named like new ones give way to
them. For texts: a null text is an empty one, a text of any length is stored whole.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import extended, written

#: Samples of an image that are summed up at once.
_STRIP = 1 << 20
#: What a medium that can't be decoded raises.
_BROKEN = (ValueError, IndexError, OverflowError, struct.error)


def encode_pgm(samples: bytes, width: int) -> bytes:
    """Binary greymap (P5) of 8-bit samples, which are a multiple of ``width``."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers after a Netpbm magic, comments left out, and where the one white space after them ends."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    numbers, at = _header(data, 2 if kind in (1, 4) else 3)
    width, height, most = [*numbers, 1][:3]
    if width * height >= 1 << 40:
        raise ValueError("no medium holds so many pixels")
    channels = 3 if kind in (3, 6) else 1
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples")
    size = width * height * channels
    if kind == 1:
        values = np.frombuffer(data[at - 1 :].translate(None, b" \t\r\n\v\f"), np.uint8)[:size] - 48
        most = 1
    elif kind in (2, 3):
        values = np.array(data[at - 1 :].split()[:size], np.int64)
    elif kind == 4:
        values = np.unpackbits(np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8, size, at)
    if len(values) != size or (size and (values.min() < 0 or values.max() > most)):
        raise ValueError("samples are missing or above their maximum")
    if kind in (1, 4):
        values = 255 * (1 - values)
    elif most != 255:
        values = values.astype(np.int64) * 255 // most
    return values.astype(np.uint8, copy=False).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    (start,), (head, width, height, _, bits, packed) = struct.unpack_from("<I", data, 10), struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("only uncompressed 8, 24 or 32 bits")
    if packed == 3 and bits != 32 or width < 0 or width * abs(height) >= 1 << 40:
        raise ValueError("bit fields are for 32 bits, and sizes are positive")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if colours > 256 or (rows.size and rows.max() >= colours):
            raise ValueError("a colour that the palette doesn't have")
        image = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[rows][:, :, 2::-1]
    else:
        bytes_of = [2, 1, 0]
        if packed == 3:  # masks of red, green and blue follow the first 40 bytes of the header
            masks = struct.unpack_from("<3I", data, 54)
            bytes_of = [{0xFF << 8 * i: i for i in range(4)}.get(m, -1) for m in masks]
            if -1 in bytes_of:
                raise ValueError("a bit field must be a whole byte")
        image = rows.reshape(abs(height), width, bits // 8)[:, :, bytes_of]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels of uint8."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(size: int, boxes: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional parts of the boxes' edges."""
    at = np.arange(boxes + 1) * size
    return at // boxes, (at % boxes) / boxes


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over height x width boxes, rounded half up, by an integral image."""
    rows, columns, channels = image.shape
    (y, fy), (x, fx) = _edges(rows, height), _edges(columns, width)
    total, sums = np.zeros((width + 1, channels)), np.empty((height + 1, width + 1, channels))
    step = max(1, _STRIP // max(1, columns * channels))
    for at in range(0, rows, step):
        strip = image[at : at + step].astype(np.int64)
        across = np.concatenate([np.zeros((len(strip), 1, channels), np.int64), strip.cumsum(1)], axis=1)
        line = across[:, x] + fx[:, None] * (across[:, np.minimum(x + 1, columns)] - across[:, x])
        down = np.concatenate([total[None], total + line.cumsum(0)])  # integral image at rows at .. at + len(strip)
        here = np.flatnonzero((y >= at) & ((y < at + len(strip)) | (at + len(strip) >= rows)))
        low, high = y[here] - at, np.minimum(y[here] - at + 1, len(strip))
        sums[here] = down[low] + fy[here, None, None] * (down[high] - down[low])
        total = down[-1]
    boxes = np.diff(np.diff(sums, axis=0), axis=1) / (rows / height * columns / width)
    return np.floor(np.clip(boxes, 0, 255) + 0.5).astype(np.uint8)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side x side bits: whether a box of the grey image is brighter than its left neighbour."""
    small = area_resize(image, side, side + 1).astype(np.int64).sum(2)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0))
    return out.getvalue()


def media_features(media: DataFrame, column: str = "media", side: int = 16) -> DataFrame:
    """``media`` with width, height, channels int, samples binary (decoded, row by row), tile binary (NPY) and dhash."""
    new = {"width": "integer", "height": "integer", "channels": "integer", "samples": "binary", "tile": "binary", "dhash": "string"}
    media = media.drop(*[c for c in media.columns if c.lower() in new])
    at = [c.lower() for c in media.columns].index(column.lower())
    schema = extended(media, new)
    types = {"integer": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data) if data else None
        except _BROKEN:
            image = None
        if image is None or not image.size:
            return (None,) * len(new)
        rows, columns, channels = image.shape
        return columns, rows, channels, image.tobytes(), npy(area_resize(image, side, side)), difference_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [one(x.as_py()) for x in part.column(at)]
                arrays = [pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new])

    return media.mapInArrow(run, schema)


UNIT, WIDTH = 576, 24


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a greymap of the text's bytes, padded with 255 to whole units) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                media = [encode_pgm(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\xff"), WIDTH) for t in texts]
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def text_media(docs: DataFrame, side: int = 16) -> DataFrame:
    """Every text stored as a greymap, read back and described: the digest columns of ``docs`` (doc_id, text).

    The greymaps are written to a table of the shared folder; from there they are read, decoded and resized, and their
    NPY tiles and hashes are a second table.
    """
    stored = written(stored_texts(docs), "media")
    read = media_features(stored, side=side)
    checks = read.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), "tile")
    tiles = written(checks, "tiles")
    return tiles.select(*[c for c in tiles.columns if c != "tile"], F.crc32("tile").alias("tile_crc32"))
