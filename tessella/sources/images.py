"""Pixels: decoding, PNG encoding, orientation, reduction.

PNG files, which may have 16 bits, are decoded here; JPEG, TIFF, BMP and GIF files by Spark's image source on the executors.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _same_path(column):
    """A path as both sources give it: one slash after the scheme where there is no host."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def pixel_rows(spark: SparkSession, paths: str | list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, ...) with ``content`` (a PNG file) or decoded rows ``raw`` of ``rows`` x ``columns`` x ``bands`` samples.

    A file that the image source can't decode has neither.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    png = files.where(F.substring("content", 1, 4) == F.lit(b"\x89PNG")).select(_same_path(F.col("path")).alias("path"), "content", *(F.lit(None).cast(t).alias(n) for n, t in _DECODED))
    other = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,tif,tiff,TIF,TIFF,bmp,gif}").load(paths).select("image.*")
    raw = other.select(_same_path(F.col("origin")).alias("path"), F.lit(None).cast("binary").alias("content"), F.when(F.col("height") > 0, F.col("data")).alias("raw"), F.col("height").alias("rows"), F.col("width").alias("columns"), F.col("nChannels").alias("bands"))
    named = wanted.withColumn("path", _same_path(F.col("path")))
    return named.join(png.unionByName(raw), "path")


_DECODED = (("raw", "binary"), ("rows", "int"), ("columns", "int"), ("bands", "int"))


def decoded(content: bytes | None, raw: bytes | None, rows: int, columns: int, bands: int, orientation: int = 1) -> np.ndarray:
    """The upright pixels of a row of ``pixel_rows``: 8 or 16 bits, one to four channels, colours red first."""
    if content is not None:
        return decode_png(bytes(content))
    if raw is None or not len(raw):
        raise ValueError("the pixels can't be decoded")
    p = np.frombuffer(raw, np.uint8).reshape(int(rows), int(columns), int(bands))
    p = p[..., [2, 1, 0, 3][: int(bands)]] if bands >= 3 else p  # stored blue first
    return upright(p, orientation)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of 8- or 16-bit samples; interlaced and palette files are refused."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in _CHANNELS or head[6]:
        raise ValueError("this kind of PNG is not read")
    width, height, depth, kind = head[:4]
    step = _CHANNELS[kind] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(raw[y, 1:], above, int(raw[y, 0]), step)
    samples = out.reshape(height, width, _CHANNELS[kind], depth // 8)
    return samples[..., 0] if depth == 8 else (samples[..., 0].astype(np.uint16) << 8) | samples[..., 1]


def _unfiltered(row: np.ndarray, above: np.ndarray, kind: int, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = row.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min(((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner)))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width[, channels]) samples of 8 or 16 bits."""
    pixels = pixels[..., None] if pixels.ndim == 2 else pixels
    height, width, channels = pixels.shape
    depth = 16 if pixels.dtype == np.uint16 else 8
    rows = pixels.astype(">u2").view(np.uint8) if depth == 16 else pixels.astype(np.uint8)
    rows = np.column_stack([np.zeros(height, np.uint8), np.ascontiguousarray(rows).reshape(height, -1)])
    kind = {v: k for k, v in _CHANNELS.items()}[channels]

    def part(name: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))

    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The photo as it is meant to be seen, for EXIF orientations 1 to 8."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    flips = {2: (False, True), 3: (True, True), 4: (True, False), 6: (False, True), 7: (True, True), 8: (True, False)}
    up, across = flips.get(orientation, (False, False))
    pixels = pixels[::-1] if up else pixels
    return pixels[:, ::-1] if across else pixels


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma from 0 to 1; transparent parts show white."""
    top = 65535.0 if pixels.dtype == np.uint16 else 255.0
    p = pixels.astype(float) / top
    alpha = p[..., -1] if p.shape[-1] in (2, 4) else 1.0
    colour = p[..., 0] if p.shape[-1] < 3 else p[..., :3] @ np.array([0.299, 0.587, 0.114])
    return colour * alpha + (1 - alpha)


def reduced(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average down to (height, width); never enlarges."""

    def along(a: np.ndarray, size: int) -> np.ndarray:
        n = a.shape[0]
        if size >= n:
            return a
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        edge = np.linspace(0, n, size + 1)
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
        upto = total[low] + part * a[low]
        return (upto[1:] - upto[:-1]) * (size / n)

    return along(along(pixels.astype(float), height).swapaxes(0, 1), width).swapaxes(0, 1)


def working_size(width: int, height: int, megapixels: float) -> tuple[int, int]:
    factor = min(1.0, (megapixels * 1e6 / (width * height)) ** 0.5)
    return max(1, round(width * factor)), max(1, round(height * factor))


def planar_canvas(pixels: np.ndarray, long_side: int, canvas: tuple[int, int]) -> np.ndarray:
    """(3, height, width) from 0 to 1: the photo at the top left of a zero canvas."""
    h, w = pixels.shape[:2]
    factor = min(1.0, long_side / max(w, h))
    small = reduced(pixels[..., :3].astype(float) / (65535.0 if pixels.dtype == np.uint16 else 255.0), max(1, round(w * factor)), max(1, round(h * factor)))
    out = np.zeros((3, canvas[1], canvas[0]))
    out[:, : small.shape[0], : small.shape[1]] = small.transpose(2, 0, 1)[:, : canvas[1], : canvas[0]]
    return out


def flattened(pixels: np.ndarray) -> np.ndarray:
    """RGB over white from RGBA of 16 bits."""
    alpha = pixels[..., 3:].astype(float) / 65535
    return np.round(pixels[..., :3] * alpha + 65535 * (1 - alpha)).astype(np.uint16)


def preview(pixels: np.ndarray, long_side: int = 4096) -> np.ndarray:
    h, w = pixels.shape[:2]
    factor = min(1.0, long_side / max(w, h))
    return np.round(reduced(pixels, max(1, round(w * factor)), max(1, round(h * factor)))).astype(pixels.dtype)


JPEG_SIDE = 65_535  # the longest that the format can say


def write_image(spark: SparkSession, pixels: np.ndarray, path: str, quality: float = 0.92) -> None:
    """A panorama (height, width, 4) of 16 bits as PNG, which keeps depth and alpha, or as TIFF or JPEG of 8 bits over white.

    The kind follows the suffix. The file is written beside its place and moved there when it is whole.
    """
    kind = {"png": "png", "tif": "tiff", "tiff": "tiff", "jpg": "jpg", "jpeg": "jpg"}.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no writer for {path}")
    if kind == "jpg" and max(pixels.shape[:2]) > JPEG_SIDE:
        raise ValueError("a side is too long for a JPEG")
    staged = Path(f"{path}.{uuid.uuid4().hex}.part")
    try:
        if kind == "png":
            staged.write_bytes(encode_png(pixels))
        else:
            _write_by_jvm(spark, (flattened(pixels) >> 8).astype(np.uint8), kind, str(staged), quality)
        staged.rename(path)
    finally:
        staged.unlink(missing_ok=True)


def _write_by_jvm(spark: SparkSession, rgb: np.ndarray, kind: str, path: str, quality: float) -> None:
    jvm, (height, width) = spark._jvm, rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 5)  # three bytes, blue first
    image.getRaster().getDataBuffer()
    samples = bytearray(np.ascontiguousarray(rgb).tobytes())
    bands = spark.sparkContext._gateway.new_array(jvm.int, 3)
    for i in range(3):
        bands[i] = i
    data = jvm.java.awt.image.DataBufferByte(samples, len(samples))
    image.setData(jvm.java.awt.image.Raster.createInterleavedRaster(data, width, height, width * 3, 3, bands, None))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    settings = writer.getDefaultWriteParam()
    if kind == "jpg":
        settings.setCompressionMode(2)  # explicit
        settings.setCompressionQuality(float(quality))
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    try:
        writer.setOutput(out)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    finally:
        out.close()
        writer.dispose()
