"""Media columns: Netpbm and BMP decoding, area resize, NPY tiles, difference hashes.

``decode`` turns the bytes of a PBM/PGM/PPM (plain or raw) or an uncompressed BMP
into a ``(height, width, channels)`` array. ``area_resize`` averages over the exact
source area of each target pixel, read off an integral image at the target's cuts.
``tile`` writes an array in NPY format; ``difference_hash`` compares neighbours of a
9 x 8 grey tile.

Edge cases: null or empty texts become one row of 64 blank pixels; very long texts are
one high image, summed in bands; neighbours that tie are not darker; samples of 16 bits
are brought to 8 in tiles; repeated rows give repeated results; an empty table gives an
empty result; further columns of the input are ignored. Broken images raise ``ValueError`` in ``decode``; ``media_columns``
gives null columns for them.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm.common import arrow_map, texts

PIXELS_PER_ROW = 64
PAYLOAD_UNIT = 3 * PIXELS_PER_ROW
TILE = 8

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode(media: bytes) -> np.ndarray:
    """Netpbm or BMP bytes as ``(height, width, channels)``."""
    if media[:1] == b"P" and media[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(media)
    if media[:2] == b"BM":
        return _bmp(media)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(media: bytes) -> np.ndarray:
    kind = int(media[1:2])
    at, header = 2, []
    while len(header) < (2 if kind in (1, 4) else 3):
        found = _TOKEN.match(media, at)
        if not found:
            raise ValueError("short Netpbm header")
        header.append(int(found[1]))
        at = found.end()
    width, height = header[:2]
    most = header[2] if len(header) == 3 else 1
    channels = 3 if kind in (3, 6) else 1
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("bad Netpbm header")
    count = width * height * channels
    if kind == 1:
        body = re.sub(rb"#[^\n\r]*", b"", media[at:])
        bits = np.frombuffer(bytes(x for x in body if x in b"01"), np.uint8)[:count] - 48
        samples = 1 - bits
    elif kind in (2, 3):
        body = re.sub(rb"#[^\n\r]*", b"", media[at:])
        samples = np.array(body.split()[:count], dtype=np.int64).astype(np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(media, np.uint8, offset=at + 1)[: stride * height]
        if rows.size < stride * height:
            raise ValueError("short Netpbm body")
        samples = 1 - np.unpackbits(rows.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        unit = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        if len(media) - at - 1 < count * unit.itemsize:
            raise ValueError("short Netpbm body")
        samples = np.frombuffer(media, unit, count, at + 1)
    if samples.size < count:
        raise ValueError("short Netpbm body")
    return samples.reshape(height, width, channels)


def _bmp(media: bytes) -> np.ndarray:
    if len(media) < 54:
        raise ValueError("short BMP header")
    (start,) = struct.unpack_from("<I", media, 10)
    header, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", media, 14)
    if packing or depth not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("unsupported BMP")
    rows = abs(height)
    stride = (width * depth + 31) // 32 * 4
    body = np.frombuffer(media, np.uint8, offset=start)[: stride * rows]
    if body.size < stride * rows:
        raise ValueError("short BMP body")
    body = body.reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if depth >= 24:
        step = depth // 8
        return body[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    entries = np.frombuffer(media[14 + header : start], np.uint8)
    palette = entries[: len(entries) // 4 * 4].reshape(-1, 4)[:, 2::-1]
    if depth == 8:
        index = body[:, :width]
    elif depth == 4:
        index = np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(body, axis=1)[:, :width]
    if index.size and int(index.max()) >= len(palette):
        raise ValueError("BMP palette too short")
    return palette[index]


def encode_ppm(image: np.ndarray) -> bytes:
    """An 8-bit RGB array as raw PPM."""
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit RGB array as a 24-bit BMP."""
    height, width, _ = image.shape
    pad = -3 * width % 4
    body = np.pad(image[::-1, :, ::-1].reshape(height, 3 * width), ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each of ``height x width`` target pixels.

    The integral image is linear inside a source pixel, so only its values at the
    target's cuts are needed: bands of rows are summed up to each cut, the part of
    the row that a cut goes through is added, and columns follow the same way."""
    rows, columns, channels = image.shape
    cuts = np.arange(height + 1) * rows / height
    whole = np.minimum(cuts.astype(np.int64), rows)
    upto = np.zeros((height + 1, columns, channels))
    for k in range(1, height + 1):
        upto[k] = upto[k - 1] + image[whole[k - 1] : whole[k]].sum(axis=0, dtype=np.int64)
    part = cuts - whole
    upto += part[:, None, None] * image[np.minimum(whole, rows - 1)]
    integral = np.concatenate([np.zeros((height + 1, 1, channels)), np.cumsum(upto, axis=1)], axis=1)
    cuts = np.arange(width + 1) * columns / width
    whole = np.minimum(cuts.astype(np.int64), columns - 1)
    at = integral[:, whole] + (cuts - whole)[None, :, None] * (integral[:, whole + 1] - integral[:, whole])
    return np.diff(np.diff(at, axis=0), axis=1) / (rows / height * columns / width)


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The area-resized 8-bit tile as an NPY file."""
    small = np.rint(area_resize(image, side, side) / (257 if image.dtype.itemsize == 2 else 1)).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, small, version=(1, 0))
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 grey areas is darker than its
    right neighbour."""
    grey = np.rint(area_resize(image, 8, 9).sum(axis=2) * 1024).astype(np.int64)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def media_columns(df: DataFrame, media: str = "media", key: str = "id") -> DataFrame:
    """``key, height, width, channels, tile_npy, feature`` of a binary column; nulls
    where the bytes are null or no whole image."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "height", "width", "channels", "tile_npy", "feature")}
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                image = decode(raw or b"")
                row = (k, *image.shape, tile(image), difference_hash(image))
            except ValueError:
                row = (k, None, None, None, None, None)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(key, media), work, f"{key} {kind}, height int, width int, channels int, tile_npy binary, feature string")


def stored_texts(documents: DataFrame) -> DataFrame:
    """Each whole text as an image of 64 RGB pixels a row, padded with blanks to whole
    rows, stored as PPM, read back, checked and described."""

    def work(batch: pa.RecordBatch) -> dict:
        names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature tile_npy".split()
        out: dict[str, list] = {k: [] for k in names}
        for k, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            padded = max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT
            samples = np.frombuffer(raw.ljust(padded, b" "), np.uint8).reshape(-1, PIXELS_PER_ROW, 3)
            media = encode_ppm(samples)
            image = decode(media)
            back = image.tobytes()
            row = (k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile(image))
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return out

    return arrow_map(
        documents.select("doc_id", "text"), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"
    )
