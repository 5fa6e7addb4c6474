"""Template images: PNG files decoded in tasks, their masks and metadata, and a writer for masks.

Files are read by Spark's own binary source, so any store that Spark reads will do, and a task decodes the files that it holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.functions.text import numeric_prefix

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# A template needs more ink than this; darker than this is ink; colours are this saturated and bright.
LEAST_PIXELS = 20
DARK = 200
SATURATION, VALUE = 30, 50

TEMPLATE = "name string, prefix int, width int, height int, gray boolean, pixels long, hue int, mask binary, problem string"


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the image's rows from filtered ones; ``step`` bytes are a pixel."""
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), dtype=np.uint8)
    for k, (line, kind) in enumerate(zip(rows, kinds.tolist(), strict=True)):
        above, here = out[k], out[k + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            here[step:] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind in (3, 4):
            for i, v in enumerate(line.tolist()):
                left, up, corner = int(here[i]), int(above[i + step]), int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    far = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if far[0] <= far[1] and far[0] <= far[2] else up if far[1] <= far[2] else corner
                here[i + step] = (v + guess) & 255
        else:
            raise ValueError("unknown filter")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """Red, green, blue and opacity of a PNG image of eight bits a channel, not interlaced; a palette is looked up."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, body, header, palette, clear = 8, b"", None, None, b""
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[6]:
        raise ValueError("a kind of image that isn't read")
    width, height, kind = header[0], header[1], header[3]
    step = CHANNELS[kind]
    lines = np.frombuffer(zlib.decompress(body), np.uint8)
    if len(lines) != height * (width * step + 1):
        raise ValueError("rows are missing")
    lines = lines.reshape(height, width * step + 1)
    pixels = _unfiltered(lines[:, 1:], lines[:, 0], step).reshape(height, width, step)
    opaque = np.full((height, width, 1), 255, dtype=np.uint8)
    if kind == 3:
        if palette is None or int(pixels.max(initial=0)) >= len(palette):
            raise ValueError("a palette is missing")
        alpha = np.frombuffer(clear.ljust(len(palette), b"\xff")[: len(palette)], np.uint8)
        return np.concatenate([palette[pixels[:, :, 0]], alpha[pixels]], axis=2)
    if kind in (0, 4):
        return np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:] if kind == 4 else opaque], axis=2)
    return np.concatenate([pixels[:, :, :3], pixels[:, :, 3:] if kind == 6 else opaque], axis=2)


def encode(image: np.ndarray) -> bytes:
    """A PNG file of (rows, columns, 3) bytes, or of a mask in black on white."""
    if image.ndim == 2:
        image = np.repeat(np.where(image, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    h, w, _ = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def colours(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 179), saturation and value (0 to 255) of every pixel."""
    rgb = image[:, :, :3].astype(np.int64)
    high, low = rgb.max(axis=2), rgb.min(axis=2)
    span = high - low
    r, g, b = (rgb[:, :, k] for k in range(3))
    wide = np.where(span == 0, 1, span)
    hue = np.where(high == r, 60 * (g - b) / wide, np.where(high == g, 120 + 60 * (b - r) / wide, 240 + 60 * (r - g) / wide))
    hue = np.where(span == 0, 0, np.where(hue < 0, hue + 360, hue)) / 2
    return np.rint(hue).astype(np.int64) % 180, np.where(high == 0, 0, np.rint(255 * span / np.where(high == 0, 1, high))).astype(np.int64), high


def masks(image: np.ndarray) -> tuple[np.ndarray, bool, int | None]:
    """(mask, whether the template is gray, median hue): its coloured pixels, or its dark ones if too few are coloured.
    Transparent pixels are paper."""
    hue, saturation, value = colours(image)
    seen = image[:, :, 3] >= 128
    coloured = seen & (saturation >= SATURATION) & (value >= VALUE)
    if int(coloured.sum()) > LEAST_PIXELS:
        return coloured, False, int(np.median(hue[coloured]))
    gray = (image[:, :, :3].astype(np.int64) @ np.array([299, 587, 114])) // 1000
    return seen & (gray < DARK), True, None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column("content"):
            try:
                image = decode(data.as_py())
                mask, gray, hue = masks(image)
                out.append((image.shape[1], image.shape[0], gray, int(mask.sum()), hue, np.packbits(mask.ravel()).tobytes(), None))
            except (ValueError, zlib.error, struct.error) as problem:
                out.append((None, None, None, None, None, None, str(problem)))
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("prefix"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in TEMPLATE.split(", ")])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Every PNG file of a folder with its mask (packed, row by row), pixels of ink, median hue and number; a file that can't be
    read has nulls and says what is wrong with it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    name = F.regexp_extract("path", r"([^/]*)\.png$", 1)
    return files.select(name.alias("name"), numeric_prefix(name).cast("int").alias("prefix"), "content").mapInArrow(_decoded, TEMPLATE)


def usable(templates: DataFrame) -> DataFrame:
    """Templates with ink enough; unreadable ones are none."""
    return templates.where(F.col("pixels") > LEAST_PIXELS)


def as_png(mask: Column, width: Column, height: Column) -> Column:
    """A packed mask as the bytes of a PNG file."""

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def made(masks_, widths, heights):
        import pandas as pd

        return pd.Series([None if m is None else encode(np.unpackbits(np.frombuffer(m, np.uint8), count=int(w) * int(h)).reshape(int(h), int(w)).astype(bool)) for m, w, h in zip(masks_, widths, heights, strict=True)])

    return made(mask, width, height)
