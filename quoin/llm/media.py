"""Media columns: texts' bytes as PNG images, read back chunk by chunk, with cosine-transform hashes.

The payload, padded with zero bytes to rows of 64, is an 8-bit grey image 64 wide. Writing takes for each row the
one of PNG's five filters that leaves the fewest different bytes, of equals the one with the least sum of absolute
values: rows of text mostly stay as they are, smooth and repeating ones are filtered. Reading checks the signature, each
chunk's crc32, the order of chunks and the stream's length, inflates and unfilters with numpy. Images higher than
`band` rows are filtered a band at a time.

Undoing a filter needs the bytes to the left, above and between them, so bytes are set free along diagonals: with those
of one, all of the next are known. A step takes a diagonal of many images of about one height at once.

The feature is the image's low frequencies: means over a 32 x 32 grid, a type-II cosine transform, and one bit
for each of the lowest 8 x 8 coefficients without the first: above their median or not.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quoin.llm.common import DOCUMENTS, pick, read

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
GRID, LOW = 32, 8


def payload_of(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of the width, and their number before that."""
    raw = (text or "").encode()
    return raw + bytes(max(width, -(-len(raw) // width) * width) - len(raw)), len(raw)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c)).astype(np.uint8)


def _filtered(image: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Each row with its filter number before it."""
    up = np.vstack([above[None], image[:-1]])
    left, up_left = (np.pad(x[:, :-1], ((0, 0), (1, 0))) for x in (image, up))
    mean = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    options = np.stack([image, image - left, image - up, image - mean, image - _paeth(left, up, up_left)])
    # rows come in order of (different bytes, sum of absolute values, filter)
    values = np.sort(options, axis=2)
    different = (values[:, :, 1:] != values[:, :, :-1]).sum(axis=2, dtype=np.int32)
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32)
    best = (different << 16 | cost).argmin(axis=0)
    rows = options[best, np.arange(len(image))]
    return np.hstack([best[:, None].astype(np.uint8), rows])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(payload: bytes, width: int = WIDTH, level: int = 6, band: int = 4096) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))]
    deflate, above = zlib.compressobj(level), np.zeros(width, np.uint8)
    for i in range(0, len(image), band):
        part = image[i : i + band]
        if data := deflate.compress(_filtered(part, above).tobytes()):
            out.append(_chunk(b"IDAT", data))
        above = part[-1]
    return b"".join([*out, _chunk(b"IDAT", deflate.flush()), _chunk(b"IEND", b"")])


def read_png(raw: bytes) -> np.ndarray:
    """The image of an 8-bit grey, not interlaced PNG. Anything that is not whole and right raises ValueError."""
    return unfiltered([filtered_rows(raw)])[0]


def filtered_rows(raw: bytes) -> np.ndarray:
    """The image's rows as they are stored, each with its filter before it, after all checks."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, inflate, rows, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(raw):
        if ended or at + 12 + int.from_bytes(raw[at : at + 4]) > len(raw):
            raise ValueError("cut short or data after the end")
        (n,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        data, crc = raw[at + 8 : at + 8 + n], raw[at + 8 + n : at + 12 + n]
        if crc != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (size is None):
            raise ValueError("header out of place")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("header of another length")
            *size, depth, colour, packing, filters, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, packing, filters, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit grey without interlace")
        elif kind == b"IDAT":
            try:
                rows.append(inflate.decompress(data))
            except zlib.error as e:
                raise ValueError(f"image data: {e}") from e
            if inflate.unused_data:
                raise ValueError("image data go on after their end")
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    pixels = b"".join([*rows, inflate.flush()])
    if not ended or not inflate.eof or len(pixels) != size[1] * (size[0] + 1):
        raise ValueError("image data cut short")
    rows = np.frombuffer(pixels, np.uint8).reshape(size[1], size[0] + 1)
    if rows.size and rows[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return rows


def unfiltered(images: list[np.ndarray], together: int = 1 << 16) -> list[np.ndarray]:
    """The images of stored rows. Images that use none but filters 0 and 2 are undone as a whole, as no byte of theirs needs
    its left neighbour; others go in groups of about `together` bytes of equal width, the heights near each other."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(images)
    hard = []
    for i, rows in enumerate(images):
        if np.isin(rows[:, 0], (0, 2)).all():
            out[i] = _undo_up(rows)
        else:
            hard.append(i)
    hard.sort(key=lambda i: (images[i].shape[1], len(images[i])))
    while hard:
        width = images[hard[0]].shape[1]
        same = sum(images[i].shape[1] == width for i in hard)
        most = max(1, min(same, together // (images[hard[0]].size or 1)))
        for i, image in zip(hard[:most], _undo_diagonals([images[i] for i in hard[:most]]), strict=True):
            out[i] = image
        hard = hard[most:]
    return out


def _undo_up(rows: np.ndarray) -> np.ndarray:
    """Runs of rows with filter 2 are running sums modulo 256 on the row before them."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    new = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if kinds.size else np.zeros(0, np.int64)
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(rows)], strict=False):
        if kinds[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
    return out


def _undo_diagonals(images: list[np.ndarray]) -> list[np.ndarray]:
    """Byte (r, c) is on diagonal r + c: it needs bytes of the two diagonals before alone. Rows past an image's end have
    filter 0, as have margins above and to the left, all zero."""
    high, width = max(map(len, images)), images[0].shape[1] - 1
    kinds = np.zeros((len(images), high), np.uint8)
    data = np.zeros((len(images), high + width, width), np.uint8)  # skewed: (r + c, c)
    columns = np.arange(width)
    for image, kind, skewed in zip(images, kinds, data, strict=True):
        kind[: len(image)] = image[:, 0]
        skewed[np.arange(len(image))[:, None] + columns, columns] = image[:, 1:]
    before = older = np.zeros((len(images), width + 1), np.int16)  # by column + 1
    for d in range(high + width - 1):
        c = columns[max(0, d - high + 1) : d + 1]
        kind = kinds[:, d - c]
        left, up, corner = before[:, c], before[:, c + 1], older[:, c]
        up, corner = (np.where(d > c, x, 0) for x in (up, corner))  # nothing is above the first row
        p = left + up - corner
        to_left, to_up, to_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kind, (np.int16(0), left, up, (left + up) >> 1, paeth))
        now = np.zeros_like(before)
        now[:, c + 1] = (data[:, d, c] + guess) & 255
        data[:, d, c] = now[:, c + 1]
        older, before = before, now
    return [skewed[np.arange(len(image))[:, None] + columns, columns] for image, skewed in zip(images, data, strict=True)]


@lru_cache
def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(low), np.arange(n) + 0.5))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex. Images lower than the grid repeat rows; each grid row is the mean of its image rows."""
    h = len(image)
    edges = np.arange(GRID) * h // GRID
    ends = np.maximum(edges + 1, np.arange(1, GRID + 1) * h // GRID)
    sums = np.concatenate([np.zeros((1, GRID), np.int64), np.cumsum(image.reshape(h, GRID, -1).sum(axis=2, dtype=np.int64), axis=0)])
    grid = (sums[ends] - sums[edges]) / ((ends - edges)[:, None] * (image.shape[1] // GRID))
    c = _cosines(GRID, LOW)
    low = np.rint((c @ grid @ c.T) * 1024).astype(np.int64).reshape(-1)  # rounded: ties stay ties
    bits = low > np.median(low[1:])
    bits[0] = low[0] > 0
    return np.packbits(bits).tobytes().hex()


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a binary column of PNG files. Null texts count as empty, one row of zeros; texts of any
    length are one image each. Repeated rows repeat their image; an empty table gives none; only doc_id and text are
    looked at, of columns with one name the first."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                loads = [payload_of(t) for t in part.column(1).to_pylist()]
                media = pa.array([write_png(x) for x, _ in loads], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in loads], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return pick(docs, DOCUMENTS).mapInArrow(write, "doc_id bigint, n_bytes bigint, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give when read back; a null medium gives nulls, a damaged one raises. Repeated rows repeat, an
    image of any height is read whole, and an empty table gives no rows."""

    def told(raw: bytes, image: np.ndarray) -> tuple:
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), cosine_hash(image)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                raws = b.column(2).to_pylist()
                images = iter(unfiltered([filtered_rows(raw) for raw in raws if raw is not None]))
                found = list(zip(*((None,) * 6 if raw is None else told(raw, next(images)) for raw in raws), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return pick(media, {"doc_id": "bigint", "n_bytes": "bigint", "media": "binary"}).mapInArrow(read_all, SCHEMA)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's PNG is written and read back. Null and empty texts are a row of zeros, texts of any length go in
    whole, a band at a time. Repeated rows give repeated rows and equal texts equal values, so there are no ties to
    break; an empty table gives none."""
    return features(to_media(read(spark, sf_dir, "documents")))
