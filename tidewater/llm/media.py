"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import documents, stored

#: Width and height of a tile, and so the bytes of its samples.
SIDE = 24
UNIT = SIDE * SIDE
BAND = 1 << 15


def netpbm(gray: np.ndarray) -> bytes:
    """A binary PGM file of a two-dimensional uint8 array."""
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def bmp(gray: np.ndarray) -> bytes:
    """An 8-bit BMP file with a gray palette: rows from the bottom up, each padded to 4 bytes."""
    high, wide = gray.shape
    rows = np.zeros((high, -(-wide // 4) * 4), np.uint8)
    rows[:, :wide] = gray[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    start = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, wide, high, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _header(blob: bytes, count: int) -> tuple[list[int], int]:
    """The first numbers of a Netpbm file after its magic, and where they end."""
    found, at = [], 2
    while len(found) < count:
        while blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at)
            continue
        end = at
        while blob[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        found.append(int(blob[at:end]))
        at = end
    return found, at + 1


def _decode_netpbm(blob: bytes) -> np.ndarray:
    kind = int(blob[1:2])
    (wide, high, *rest), at = _header(blob, 2 if kind in (1, 4) else 3)
    most, bands = (rest or [1])[0], 3 if kind in (3, 6) else 1
    count = wide * high * bands
    if kind == 1:
        flat = (np.frombuffer(blob[at:].translate(None, b" \t\r\n\v\f"), np.uint8)[:count] == 48).astype(np.uint8) * 255
    elif kind == 4:
        rows = np.frombuffer(blob, np.uint8, high * -(-wide // 8), at).reshape(high, -1)
        flat = (1 - np.unpackbits(rows, axis=1)[:, :wide].reshape(-1)) * np.uint8(255)
    elif kind in (2, 3):
        flat = np.array(blob[at:].split()[:count], np.int64)
    else:
        flat = np.frombuffer(blob, ">u2" if most > 255 else np.uint8, count, at)
    if len(flat) != count:
        raise ValueError("short Netpbm file")
    if kind not in (1, 4) and most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    shape = (high, wide, 3) if bands == 3 else (high, wide)
    return flat.astype(np.uint8).reshape(shape)


def _decode_bmp(blob: bytes) -> np.ndarray:
    start, size, wide, high, _, bits, packed = struct.unpack_from("<10xIIiiHHI", blob)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("this kind of BMP file isn't read")
    down, high = high < 0, abs(high)
    rows = np.frombuffer(blob, np.uint8, high * (-(-wide * bits // 32) * 4), start).reshape(high, -1)
    if bits >= 24:
        pixels = rows[:, : wide * bits // 8].reshape(high, wide, -1)[:, :, 2::-1]
    else:
        used = np.unpackbits(rows, axis=1).reshape(high, -1, bits)[:, :wide]
        index = (used * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2) if bits < 8 else rows[:, :wide]
        palette = np.frombuffer(blob, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        gray = (palette == palette[:, :1]).all()
        pixels = palette[index, 0] if gray else palette[index]
    return np.ascontiguousarray(pixels if down else pixels[::-1])


def decode(blob: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or BMP file as uint8 samples: two dimensions for gray, three for colour."""
    if blob[:2] == b"BM":
        return _decode_bmp(blob)
    if blob[:1] == b"P" and blob[1:2] in b"123456":
        return _decode_netpbm(blob)
    raise ValueError("neither Netpbm nor BMP")


def gray(image: np.ndarray) -> np.ndarray:
    """One sample for each pixel: the rounded mean of the bands."""
    return image if image.ndim == 2 else ((image.astype(np.uint16).sum(axis=2) + 1) // image.shape[2]).astype(np.uint8)


def area_resize(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over high x wide areas of a gray image, from its integral image taken at the areas' corners.

    The integral image is summed in bands of rows, so memory does not grow with the image's height.
    """
    ys, xs = np.linspace(0, image.shape[0], high + 1), np.linspace(0, image.shape[1], wide + 1)
    corners, carry, left = np.zeros((high + 1, wide + 1)), np.zeros(image.shape[1] + 1), np.floor(xs).astype(int)
    right = np.minimum(left + 1, image.shape[1])
    for top in range(0, image.shape[0], BAND):
        band = image[top : top + BAND]
        table = np.zeros((len(band) + 1, image.shape[1] + 1), np.float64)
        table[0] = carry
        np.cumsum(np.cumsum(band, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
        table[1:] += carry
        carry = table[-1].copy()
        inside = (ys > top) & (ys <= top + len(band))
        y = ys[inside] - top
        up = np.floor(y).astype(int)
        rows = table[up] + (table[np.minimum(up + 1, len(band))] - table[up]) * (y - up)[:, None]
        corners[inside] = rows[:, left] + (rows[:, right] - rows[:, left]) * (xs - left)
    area = np.diff(ys)[:, None] * np.diff(xs)
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each area of an 8 x 9 grid is darker than its right neighbour."""
    small = np.round(area_resize(gray(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tiles(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A gray image cut into side x side tiles in reading order, filled with 255 at its edges."""
    high, wide = (-(-n // side) * side for n in image.shape)
    if (high, wide) != image.shape:
        image = np.pad(image, ((0, high - image.shape[0]), (0, wide - image.shape[1])), constant_values=255)
    return np.ascontiguousarray(image.reshape(high // side, side, wide // side, side).swapaxes(1, 2).reshape(-1, side, side))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, array, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(blob: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(blob), allow_pickle=False)


def text_image(text: str) -> bytes:
    """A text's UTF-8 bytes, filled up with 255 to whole tiles, as an image 24 samples wide: BMP for an odd number of tiles, else PGM."""
    raw = text.encode("utf-8", "surrogatepass")
    count = max(1, -(-len(raw) // UNIT))
    image = np.frombuffer(raw.ljust(count * UNIT, b"\xff"), np.uint8).reshape(-1, SIDE)
    return bmp(image) if count % 2 else netpbm(image)


def _bounded(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bounded(batches):
        images = [decode(text_image(x)) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([x for x in map(npy, map(tiles, images))], pa.binary())], ["doc_id", "media"])


#: What is read back from the stored media.
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in _bounded(batches):
        rows = []
        for doc_id, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            array = from_npy(blob)
            image = array.reshape(-1, SIDE)
            payload = image.tobytes()
            rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), difference_hash(image), len(array)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media (NPY tiles) of every text, in a scratch table. Null texts are empty, and an empty text is one tile of 255."""
    return stored(documents(docs).mapInArrow(_write, "doc_id long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Sizes, digests and difference hash of each stored text. UTF-8 never holds a byte 255, so n_bytes is what stands before the filling. Repeated rows stay."""
    return media.select("doc_id", "media").mapInArrow(_read, FEATURES)
