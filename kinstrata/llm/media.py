"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, slices, small_batches, table

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for height x width, P6 for height x width x 3; 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with maxval up to 255 (or one bit), as uint8: height x width, or height x width x 3. Samples are kept as stored; bit 1 is 0 (black), bit 0 is 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    if len(head) == 3 and not 0 < head[2] < 256:
        raise ValueError("only 8-bit samples are read")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        flat = np.array(values[: w * h * depth], dtype=object).astype(np.int64)
    elif kind == b"P4":
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)
        flat = bits[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    if len(flat) != w * h * depth:
        raise ValueError("a Netpbm file ends early")
    if kind in (b"P1", b"P4"):
        flat = np.where(flat == 1, 0, 255)
    pixels = flat.astype(np.uint8)
    return pixels.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, bottom-up or top-down, as uint8 height x width x 3 (RGB)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size, w, h, _, bits, how = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if how not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0:
        raise ValueError("this kind of BMP is not read")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        pixels = body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        colours = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(body, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1]) if bits < 8 else body
        pixels = colours[index[:, :w]]
    return np.ascontiguousarray(pixels if h < 0 else pixels[::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int, band: int = 1 << 20) -> np.ndarray:
    """Mean over each cell of a height x width grid, with fractions of pixels at its borders, from integral images.

    The image is read in bands of about ``band`` samples; a band's integral image starts with the last line of the one before.
    """
    h, w = pixels.shape[:2]
    if not h or not w:
        return np.zeros((height, width))
    x = np.linspace(0, w, width + 1)
    x0 = np.minimum(x.astype(np.int64), w - 1)
    y = np.linspace(0, h, height + 1)
    y0 = np.minimum(y.astype(np.int64), h - 1)
    low, high = np.zeros((height + 1, w + 1)), np.zeros((height + 1, w + 1))  # the integral image's lines y0 and y0 + 1
    rows, last = max(1, band // w), np.zeros(w + 1)
    for at in range(0, h, rows):
        part = pixels[at : at + rows].astype(np.float64)
        part = part @ np.array([0.299, 0.587, 0.114]) if part.ndim == 3 else part
        lines = np.zeros((len(part) + 1, w + 1))
        lines[1:, 1:] = part.cumsum(0).cumsum(1)
        lines += last
        for into, line in ((low, y0), (high, y0 + 1)):
            mine = (line >= at) & (line <= at + len(part))
            into[mine] = lines[line[mine] - at]
        last = lines[-1].copy()
    edges = low + (high - low) * (y - y0)[:, None]
    grid = edges[:, x0] * (1 - (x - x0)) + edges[:, x0 + 1] * (x - x0)
    return np.diff(np.diff(grid, axis=0), axis=1) / (h / height * w / width)


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """size*size bits as hex: each cell against its right neighbour in a size x (size+1) area-resized image."""
    cells = np.round(area_resize(pixels, size, size + 1), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, tile: int = 256) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of tiles of at most tile x tile pixels, which cover the image once."""
    for y in range(0, max(1, pixels.shape[0]), tile):
        for x in range(0, max(1, pixels.shape[1]), tile):
            np.save(out := io.BytesIO(), pixels[y : y + tile, x : x + tile], allow_pickle=False)
            yield y // tile, x // tile, out.getvalue()


_TILES = "path string, height int, width int, channels int, hash string, row int, col int, npy binary, error string"


def media_tiles(media: DataFrame, key: str = "path", content: str = "content", tile: int = 256) -> DataFrame:
    """Rows (path, height, width, channels, hash, row, col, npy, error) of each image's tiles.

    Null or unreadable content gives one row with nulls and the error's text. Other columns are ignored, repeated rows are
    images of their own, and an empty table gives an empty result. An image is held whole in its task.
    """
    small_batches(media.sparkSession)

    def run(batches):
        names = ["path", "height", "width", "channels", "hash", "row", "col", "npy", "error"]
        schema = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("hash", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    pixels = decode(data or b"")
                    head = [path, *pixels.shape[:2], pixels.shape[2] if pixels.ndim == 3 else 1, difference_hash(pixels)]
                    rows = [dict(zip(names, [*head, *t, None], strict=True)) for t in npy_tiles(pixels, tile)]
                except (ValueError, struct.error, IndexError) as e:
                    rows = [dict.fromkeys(names) | {"path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, _TILES)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as an 8-bit P5 image 64 samples wide.

    Null texts are empty (64 padding bytes). Null and repeated doc_ids stay; a very long text is one image; other columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [encode_netpbm(np.frombuffer(b + bytes(max(WIDTH, -(-len(b) // WIDTH) * WIDTH) - len(b)), np.uint8).reshape(-1, WIDTH)) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode each stored image, cut it to NPY tiles, and take payload and features from the tiles as read back. Rows stay as they are, nulls and repeats too."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                pixels = decode(data)
                back = np.concatenate([np.load(io.BytesIO(t)) for _, _, t in npy_tiles(pixels, 4096)])
                payload = back.tobytes()
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(back)))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FEATURES.split(", ")])

    return media.mapInArrow(run, _FEATURES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return media_features(text_media(table(spark, sf_dir, "documents")))


def media_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths and digests of op7_media, which SQL can express."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


MEDIA_DIGESTS_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS size, raw FROM b),
q AS (SELECT doc_id, n, size, CASE WHEN size > n THEN raw || repeat('\x00'::BLOB, size - n) ELSE raw END AS payload FROM p),
m AS (SELECT *, encode('P5' || chr(10) || '64 ' || size // 64 || chr(10) || '255' || chr(10)) || payload AS media FROM q)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(media) AS media_bytes, sha256(media) AS media_sha256 FROM m
"""
