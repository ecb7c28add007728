"""Media columns: lossless PNG images of bytes, read back with checks, and low-frequency cosine hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
PAD = 255
#: Bytes after which a task hands a batch on.
FLUSH = 8 << 20
_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_SIDE) + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(data: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of ``data`` padded with 255; each row takes the filter of least absolute sum; the length is kept as text."""
    rows = max(1, -(-len(data) // width))
    image = np.full(rows * width, PAD, np.uint8)
    image[: len(data)] = np.frombuffer(data, np.uint8)
    image = image.reshape(rows, width)
    left = image.copy()
    left[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    tried = np.stack([image, left, up])
    best = np.abs(tried.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    lines = np.empty((rows, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(rows)]
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, image = lines[:, 0], lines[:, 1:].copy()
    sub = kinds == 1
    image[sub] = np.cumsum(image[sub], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds > 1):
        row, above = image[y], image[y - 1] if y else np.zeros(image.shape[1], np.uint8)
        if kinds[y] == 2:
            row += above
        elif kinds[y] in (3, 4):
            left = corner = 0
            for x, b in enumerate(above.tolist()):
                guess = (left + b) // 2 if kinds[y] == 3 else _paeth(left, b, corner)
                left = row[x] = (int(row[x]) + guess) & 255
                corner = b
        else:
            raise ValueError(f"unknown PNG filter {kinds[y]}")
    return image


def png_decode(media: bytes) -> tuple[np.ndarray, int]:
    """The rows of an 8-bit grey PNG and the length kept in it; a wrong checksum or layout raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, length = 8, [], None, None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(media) < at + 12 + size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            length = int(body[8:])
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], head[0] + 1)
    return _unfilter(lines), head[0] * head[1] if length is None else length


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: signs of the 8 x 8 lowest cosine coefficients of the 32 x 32 area means against their median."""
    means = image.astype(np.float64)
    for axis in (0, 1):
        size = means.shape[axis]
        edges = np.arange(_SIDE + 1) * size // _SIDE
        if size >= _SIDE:
            means = np.add.reduceat(means, edges[:-1], axis) / np.expand_dims(np.diff(edges), 1 - axis)
        else:
            means = means.take(edges[:-1], axis)
    low = (_COSINES @ means @ _COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _mapped(df: DataFrame, source: str, keep: list[str], outputs: str, function) -> DataFrame:
    """``keep`` plus new columns that ``function`` makes of each value (bytes or None) of the binary column ``source``."""
    small_batches(df.sparkSession)
    plain = df.select(*keep, source)
    names = [x.split()[0] for x in outputs.split(",")]
    schema = plain.select(*keep).schema
    for x in outputs.split(","):
        schema = schema.add(*x.split())

    def run(batches):
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in outputs.split(",")]
        for batch in batches:
            values, start, rows, size = batch.column(len(keep)), 0, [], 0
            for i in range(len(values)):
                rows.append(function(values[i].as_buffer().to_pybytes() if values[i].is_valid else None))
                size += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
                if size >= FLUSH or i == len(values) - 1:
                    new = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(j) for j in range(len(keep))] + new, [*keep, *names])
                    start, rows, size = i + 1, [], 0

    return plain.mapInArrow(run, schema)


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``media``: a PNG of the text's UTF-8, null as empty; an empty text is one row of 255.

    A column ``media`` of ``docs`` is replaced; all others are carried along.
    """
    (raw,) = free_names(docs, ["media_raw"])
    keep = [c for c in docs.columns if c.lower() != "media"]
    return _mapped(docs.withColumn(raw, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")), raw, keep, "media binary", lambda x: (png_encode(x),))


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``payload`` (all bytes read back), ``n_bytes`` (of them not padding), ``feature`` (cosine hash) and ``error``.

    Null media gives nulls. Media that is no whole image of this form gives nulls and what is wrong with it in ``error``, so one damaged row does not end the job.
    """

    def read(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None
        try:
            image, length = png_decode(media)
        except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
            return None, None, None, f"{type(e).__name__}: {e}"
        return image.tobytes(), length, cosine_hash(image), None

    keep = [c for c in df.columns if c.lower() not in ("payload", "n_bytes", "feature", "error", media_col.lower())]
    (copy,) = free_names(df, ["media_copy"])
    return _mapped(df.withColumn(copy, F.col(media_col)), copy, [*keep, media_col], "payload binary,n_bytes long,feature string,error string", read)


def query(spark, sf_dir):
    from .common import documents

    read = read_media(with_media(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
