"""Photo metadata from file headers, without decoding pixels."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, name string, width int, height int, orientation int, capture_date timestamp, focal_35mm double, unreadable boolean"
VIDEO_SUFFIXES = ("mov", "mp4", "m4v", "avi")


def is_video(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*VIDEO_SUFFIXES)


def cache_key(name: Column, size: Column, modified: Column) -> Column:
    """A key for what is derived from a file: another name, length or date of change gives another key."""
    return F.substring(F.sha2(F.concat_ws("|", name, size.cast("string"), F.unix_micros(modified).cast("string")), 256), 1, 24)


def reused(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``folder/key`` if it was written whole before, else ``make``'s, written there."""
    path = f"{folder}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # the committer writes it last
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row per PNG, JPEG or TIFF file: upright size, orientation, capture date, 35 mm focal length.

    A file that can't be read is a row of size 0 x 0 with ``unreadable`` set; the scan goes on.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, name.rsplit("/", 1)[-1], *header(bytes(content)), False))
                except (ValueError, struct.error, IndexError):
                    rows.append((name, name.rsplit("/", 1)[-1], 0, 0, 1, None, None, True))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(read, SCHEMA)


def header(data: bytes) -> tuple[int, int, int, datetime | None, float | None]:
    """Upright width and height, orientation, capture date, focal length."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", data[16:24])
        if not width or not height:
            raise ValueError("no size")
        return width, height, 1, None, None
    if data[:4] in (b"II*\0", b"MM\0*"):
        width, height = _tiff_size(data)
        exif = _exif(data)
        return (*((height, width) if exif[0] >= 5 else (width, height)), *exif)
    if data[:2] != b"\xff\xd8":
        raise ValueError("neither PNG nor JPEG nor TIFF")
    at, exif = 2, (1, None, None)
    while True:
        if data[at] != 0xFF:
            raise ValueError("not at a marker")
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            exif = _exif(data[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            if not width or not height:
                raise ValueError("no size")
            return (*((height, width) if exif[0] >= 5 else (width, height)), *exif)
        at += 2 + size


def _entries(tiff: bytes, order: str, at: int) -> dict[int, bytes]:
    """The values of a directory by tag."""
    out = {}
    for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        tag, kind, count, value = struct.unpack(order + "HHI4s", tiff[at + 2 + 12 * i : at + 14 + 12 * i])
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        start = struct.unpack(order + "I", value)[0]
        out[tag] = value[:size] if size <= 4 else tiff[start : start + size]
    return out


def _tiff_size(tiff: bytes) -> tuple[int, int]:
    order = "<" if tiff[:2] == b"II" else ">"
    first = _entries(tiff, order, struct.unpack(order + "I", tiff[4:8])[0])
    width, height = (struct.unpack(order + ("H" if len(first.get(tag, b"")) == 2 else "I"), first.get(tag, b"\0\0\0\0"))[0] for tag in (0x0100, 0x0101))
    if not width or not height:
        raise ValueError("no size")
    return width, height


def _exif(tiff: bytes) -> tuple[int, datetime | None, float | None]:
    order = {b"II": "<", b"MM": ">"}[tiff[:2]] if tiff[:2] in (b"II", b"MM") else None
    if order is None:
        return 1, None, None
    first = _entries(tiff, order, struct.unpack(order + "I", tiff[4:8])[0])
    orientation = struct.unpack(order + "H", first[0x0112][:2])[0] if 0x0112 in first else 1
    date = focal = None
    if 0x8769 in first:
        own = _entries(tiff, order, struct.unpack(order + "I", first[0x8769])[0])
        if 0x9003 in own:
            try:
                date = datetime.strptime(own[0x9003].split(b"\0")[0].decode("ascii", "replace"), "%Y:%m:%d %H:%M:%S")
            except ValueError:
                date = None
        if 0xA405 in own:
            focal = float(struct.unpack(order + "H", own[0xA405][:2])[0]) or None
    return orientation if 1 <= orientation <= 8 else 1, date, focal
