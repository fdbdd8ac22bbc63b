"""Media columns: Netpbm and BMP pictures decoded to numpy arrays.

Pictures are resized by areas from integral images, which are exact for any
ratio, described by a difference hash, and cut to tiles that are stored in NPY
form. Everything works on one row at a time, so memory is that of one picture.

Null bytes, bytes of no known form and malformed pictures (no pixels, samples
above the maximum, a palette or rows that are too short) give a null picture:
``decode`` raises ValueError, the column functions return nulls. Samples whose
maximum is not 255 or 65535 are scaled to that range. Pictures need not be a
multiple of the tile size: border tiles are smaller. A picture of one pixel has a
hash. Null and empty texts are stored as one row of spaces; repeated rows give
repeated rows, and a table without rows none. Texts of any length are stored
whole. Columns other than the key and the text or media are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import map_rows

ROW = 192


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the two magic bytes, with comments skipped, and the offset past one white space."""
    values, at = [], 2
    while len(values) < fields:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*+(\d+)").match(data, at)
        if m is None or len(m[1]) > 9:
            raise ValueError("not a Netpbm header")
        values.append(int(m[1]))
        at = m.end()
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); samples have 8 bits, or 16 if their maximum is above 255."""
    kind = data[1:2]
    bits, plain, channels = kind in b"14", kind in b"123", 3 if kind in b"36" else 1
    (width, height, *rest), at = _header(data, 2 if bits else 3)
    most, n = rest[0] if rest else 1, width * height * channels
    if n == 0 or not 0 < most < 65536:
        raise ValueError("no pixels, or no such maximum")
    bytes_of = 0.125 if bits and not plain else 2 if most > 255 and not plain else 1
    if len(data) - at + 1 < n * bytes_of:  # a plain sample takes a byte at least
        raise ValueError("short picture")
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[at - 1 :])
        values = (re.findall(rb"[01]", body) if bits else body.split())[:n]
        if not all(v.isdigit() and len(v) < 10 for v in values):
            raise ValueError("not a number")
        samples = np.array(values, dtype="i8")
    elif bits:
        stride = (width + 7) // 8
        if len(data) < at + stride * height:
            raise ValueError("short picture")
        packed = np.frombuffer(data, "u1", stride * height, at).reshape(height, stride)
        samples = np.unpackbits(packed, axis=1)[:, :width].astype("i8").ravel()
    else:
        samples = np.frombuffer(data[at:], "u1" if most < 256 else ">u2", n)
    if len(samples) < n:
        raise ValueError("short picture")
    if samples.max() > most:
        raise ValueError("a sample above the maximum")
    full = 65535 if most > 255 else 255
    if bits:
        samples = np.where(samples == 1, 0, 255)
    elif most != full:
        samples = (samples.astype("i8") * full + most // 2) // most
    return samples.astype("u2" if most > 255 else "u1").reshape(height, width, channels)


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The 8-bit samples that a mask takes from 32-bit pixels."""
    if mask == 0:
        raise ValueError("an empty mask")
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((pixels & np.uint32(mask)) >> np.uint32(low)).astype("u8") * np.uint64(255) + np.uint64(most // 2)) // np.uint64(most)).astype("u1")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24-bit and 32-bit BMP, masks included, as RGB."""
    offset, size, width, height, _, depth, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or depth not in (8, 24, 32) or (packing == 3 and depth != 32) or size < 40:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * depth // 8 + 3) // 4 * 4
    if width < 1 or rows < 1 or len(data) < offset + rows * stride:
        raise ValueError("short picture")
    body = np.frombuffer(data[offset : offset + rows * stride], "u1").reshape(rows, stride)[:, : width * depth // 8]
    body = body[::-1] if height > 0 else body
    if depth == 8:
        colours = np.frombuffer(data[14 + size : max(14 + size, offset)], "u1")
        colours = colours[: len(colours) // 4 * 4].reshape(-1, 4)
        if body.max() >= len(colours):
            raise ValueError("a pixel outside the palette")
        return colours[body][:, :, 2::-1].copy()
    if packing == 3:
        if len(data) < 66:
            raise ValueError("no masks")
        pixels = np.ascontiguousarray(body).view("<u4")
        return np.stack([_masked(pixels, m) for m in struct.unpack_from("<III", data, 54)], axis=2)
    return body.reshape(rows, width, depth // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM" and len(data) >= 54:
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in [b"1", b"2", b"3", b"4", b"5", b"6"]:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width = samples.shape[:2]
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def grey(picture: np.ndarray) -> np.ndarray:
    if picture.shape[2] == 1:
        return picture[:, :, 0].astype("f8")
    return picture[:, :, :3].astype("f8") @ np.array([299.0, 587.0, 114.0]) / 1000


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each target pixel, with fractional borders, from an integral image."""
    h, w = plane.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(plane, axis=0), axis=1, out=total[1:, 1:])

    def along(values: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(values) - 1, n + 1)
        low = np.minimum(edges.astype(int), len(values) - 2)
        part = (edges - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    corners = along(along(total, height).T, width).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (h / height * w / width)


def difference_hash(picture: np.ndarray) -> str:
    """64 bits as hexadecimal digits: is a cell of the 8 x 9 picture darker than its right neighbour?"""
    small = np.round(area_resize(grey(picture), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(picture: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile."""
    out = []
    for top in range(0, picture.shape[0], side):
        for left in range(0, picture.shape[1], side):
            f = io.BytesIO()
            np.save(f, np.ascontiguousarray(picture[top : top + side, left : left + side]), allow_pickle=False)
            out.append((top // side, left // side, f.getvalue()))
    return out


def tiles(df: DataFrame, column: str = "media", key: str = "doc_id", side: int = 64) -> DataFrame:
    """A row for each tile: key, height, width, dhash, tile_row, tile_column, npy. Unreadable media give one row of nulls.

    Write the result with ``.write.parquet``; numpy.load reads the ``npy`` values.
    """

    def make():
        def one(k, data):
            try:
                picture = decode(bytes(data or b""))
            except ValueError:
                return [(k, None, None, None, None, None, None)]
            shape, code = picture.shape[:2], difference_hash(picture)
            return [(k, *shape, code, r, c, t) for r, c, t in npy_tiles(picture, side)]

        return one

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, height int, width int, dhash string, tile_row int, tile_column int, npy binary"
    return map_rows(df.select(F.col(key), F.col(column)), make, schema, many=True)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW), len(raw)


def text_pictures(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ``media``: each whole text as a PPM, 64 pixels of three samples a row, padded with spaces."""

    def make():
        def one(k, t):
            return k, encode_ppm(np.frombuffer(payload_of(t)[0], "u1").reshape(-1, 64, 3))

        return one

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, media binary")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text as a PPM, decodes what is stored, and describes it; see the columns below."""

    def make():
        def one(k, t):
            payload, n = payload_of(t)
            media = encode_ppm(np.frombuffer(payload, "u1").reshape(-1, 64, 3))
            picture = decode(media)
            back = picture.tobytes()
            parts = hashlib.sha256()
            for _, _, tile in npy_tiles(picture, 64):
                parts.update(tile)
            sha = hashlib.sha256(back).hexdigest(), hashlib.sha256(media).hexdigest()
            return k, n, len(back), sha[0], zlib.crc32(back[-16:]), len(media), sha[1], difference_hash(picture), parts.hexdigest()

        return one

    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tiles_sha256 string"
    )
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)
