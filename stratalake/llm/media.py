"""Media columns: Netpbm and BMP pictures as numpy arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalake.llm.common import ready, rows, texts

WIDTH = 64


def decode(data: bytes) -> np.ndarray:
    """Binary or plain Netpbm (P2, P3, P5, P6; 8 or 16 bits) or uncompressed BMP (8-bit grey or palette, 24, 32 bits)
    as an array of height x width (grey) or height x width x 3. Anything else raises ValueError: other formats, pictures
    without pixels, sample values above the stated range, and sizes that need more bytes than there are, which are told
    from the header before anything is allocated. Bytes after the last sample are ignored."""
    if data[:2] == b"BM":
        return _bmp(data)
    head = re.match(rb"(P[2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("neither Netpbm nor BMP")
    w, h, top = (int(x[:20]) for x in head.groups()[1:])
    planes = 3 if head[1] in (b"P3", b"P6") else 1
    if not 0 < top < 65536 or not w or not h:
        raise ValueError("sample range or size")
    count, width, body = w * h * planes, 1 if top < 256 else 2, len(data) - head.end()
    if head[1] in (b"P2", b"P3"):
        if 2 * count - 1 > body:  # a digit for each sample and a space between any two
            raise ValueError("too few samples")
        found = data[head.end() :].split(None, count)[:count]
        if len(found) < count or not all(x.isdigit() and len(x) < 10 for x in found):
            raise ValueError("too few samples, or none")
        flat = np.array(found, np.int64)
    else:
        if count * width > body:
            raise ValueError("too few samples")
        flat = np.frombuffer(data, np.uint8 if width == 1 else ">u2", count, head.end())
    if flat.max() > top:
        raise ValueError("sample range")
    return flat.astype(np.uint8 if width == 1 else np.uint16, copy=False).reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if len(data) < 54 or packed or bits not in (8, 24, 32) or w <= 0 or not h or size < 40:
        raise ValueError("BMP kind")
    line = (w * bits + 31) // 32 * 4
    if start < 14 + size or start + line * abs(h) > len(data):
        raise ValueError("too few samples")
    grid = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    grid = grid[::-1] if h > 0 else grid
    if bits > 8:
        return grid.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    colours = int.from_bytes(data[46:50], "little") or 256
    if colours > 256 or 14 + size + 4 * colours > start or grid.max() >= colours:
        raise ValueError("palette")
    palette = np.zeros((256, 3), np.uint8)
    palette[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = palette[grid]
    return out[:, :, 0] if (palette == palette[:, :1]).all() else out


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def encode_bmp(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    line = (w + 3) // 4 * 4
    body = np.zeros((h, line), np.uint8)
    body[:, :w] = grey[::-1]
    le = lambda x, n: int(x).to_bytes(n, "little")
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    return (b"BM" + le(1078 + body.size, 4) + bytes(4) + le(1078, 4) + le(40, 4) + le(w, 4) + le(h, 4) + le(1, 2) + le(8, 2)
            + bytes(4) + le(body.size, 4) + bytes(8) + le(256, 4) + bytes(4) + palette.tobytes() + body.tobytes())


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of the area that each target cell covers, from the integral image; parts of pixels count in proportion."""
    grey = image.mean(axis=2) if image.ndim == 3 else image

    def along(total: np.ndarray, cells: int, axis: int) -> np.ndarray:
        edges = np.linspace(0, total.shape[axis] - 1, cells + 1)
        low = np.minimum(edges.astype(np.int64), total.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
        return np.diff(at, axis=axis)

    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    integral[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)
    return along(along(integral, h, 0), w, 1) * (h * w) / (grey.shape[0] * grey.shape[1])


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int = 16) -> bytes:
    """An NPY file of side x side 8-bit means."""
    return npy(np.clip(np.round(area_resize(image, side, side)), 0, 255).astype(np.uint8))


def media_columns(pictures: DataFrame, data: str = "data", side: int = 16) -> DataFrame:
    """Adds height, width, tile (NPY bytes) and dhash to rows with a binary column of Netpbm or BMP files, a row for each
    row. Null, empty or undecodable data gives nulls there, equal data equal values; an empty table stays empty. Columns
    of those names must not exist already (in any case): that is an error at once."""
    from pyspark.sql import types as T

    ready(pictures.sparkSession)
    if clash := {"height", "width", "tile", "dhash"} & {c.lower() for c in pictures.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*pictures.schema, *(T.StructField(n, k) for n, k in (("height", T.IntegerType()), ("width", T.IntegerType()), ("tile", T.BinaryType()), ("dhash", T.StringType())))])

    def one(raw: bytes | None) -> tuple:
        try:
            image = decode(raw or b"")
            return (*image.shape[:2], tile(image, side), difference_hash(image))
        except ValueError:
            return (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = list(zip(*(one(x) for (x,) in rows(b, data)))) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.record_batch([*b.columns, *(pa.array(c, k) for c, k in zip(new, kinds))], [*b.schema.names, "height", "width", "tile", "dhash"])

    return pictures.mapInArrow(run, schema)


def store_text(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and a PGM picture 64 samples wide that holds them, zero-filled to whole lines (one at least)."""
    raw = (text or "").encode("utf-8", "replace")
    lines = max(1, -(-len(raw) // WIDTH))
    return len(raw), encode_pgm(np.frombuffer(raw.ljust(lines * WIDTH, b"\0"), np.uint8).reshape(lines, WIDTH))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text kept losslessly as a PGM picture (null: as the empty text), a row for each row.

    Texts of any length are one picture each; repeated rows give equal ones, ids may be null, an empty table gives none,
    and other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, media = zip(*(store_text(t) for (t,) in rows(b, "text"))) if b.num_rows else ((), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of stored pictures, a row for each, from their decoded samples alone: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference hash, then the 4 x 4 means as hex),
    tile_sha256 (of the 16 x 16 NPY tile)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, stored in rows(b, "doc_id", "n_bytes", "media"):
                image = decode(stored)
                payload = image.tobytes()
                means = np.round(area_resize(image, 4, 4)).astype(np.uint8).tobytes().hex()
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored),
                            hashlib.sha256(stored).hexdigest(), f"{difference_hash(image)}:{means}", hashlib.sha256(tile(image)).hexdigest()))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
