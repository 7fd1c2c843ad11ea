"""Image folders as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mattelake.config import Settings
from mattelake.functions import scalars
from mattelake.schemas import extend


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = Settings().extensions, recursive: bool = True) -> DataFrame:
    """(path, relative, length, modificationTime) of the images under root; contents are not read.

    ``sort_key`` orders a listing regardless of case; the sort itself is left to whoever needs it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    listed = files.select("path", "length", "modificationTime").withColumn("relative", F.expr("path") if not base else F.when(at > 0, F.substr(F.col("path"), at + len(base))).otherwise(F.col("path")))
    return listed.where(scalars.is_image(F.col("path"), extensions)).withColumn("sort_key", F.lower("path"))


def read_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG with 8-bit grey, RGB, palette or alpha samples, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, fade = 8, b"", None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or interlaced or color not in (0, 2, 3, 4, 6):
                raise ValueError("unsupported PNG form")
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            fade = chunk
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height + 1, width, n), np.int64)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].reshape(width, n).astype(np.int64), rows[y]
        if kind == 0:
            out = line
        elif kind == 1:
            out = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            out = (line + up) & 255
        else:
            out, left, corner = np.empty_like(line), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    p = left + up[x] - corner
                    da, db, dc = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[x], corner))
                left = out[x] = (line[x] + guess) & 255
                corner = up[x]
        rows[y + 1] = out
    img = rows[1:].astype(np.uint8)
    if color == 3:
        if palette is None:
            raise ValueError("a palette is missing")
        index = img[..., 0]
        img = palette[index]
        if fade:
            opacity = np.full(256, 255, np.uint8)
            opacity[: len(fade)] = np.frombuffer(fade, np.uint8)
            img = np.dstack([img, opacity[index]])
    return img


def write_png(img: np.ndarray) -> bytes:
    """PNG bytes of (height, width) or (height, width, 1 | 3 | 4) 8-bit samples."""
    planes = img[..., None] if img.ndim == 2 else img
    h, w, n = planes.shape
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), planes.reshape(h, w * n).astype(np.uint8)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def as_rgb(img: np.ndarray) -> np.ndarray:
    """Three samples a pixel: grey repeated, alpha left out."""
    if img.shape[2] < 3:
        return np.repeat(img[..., :1], 3, axis=2)
    return img[..., :3]


def orient(img: np.ndarray, tag: int) -> np.ndarray:
    """img turned upright by its EXIF orientation, 1 to 8."""
    if tag in (5, 6, 7, 8):
        img = img.swapaxes(0, 1)
    if tag in (2, 6, 3, 7):
        img = img[:, ::-1]
    if tag in (3, 4, 7, 8):
        img = img[::-1]
    return img


def exif_orientation(data: bytes) -> int:
    """The orientation tag, 1 to 8, in the EXIF part of a JPEG, PNG or WebP file's beginning; 1 where there is none."""
    at = -1
    if data[:2] == b"\xff\xd8":
        pos = 2
        while pos + 4 <= len(data) and data[pos] == 0xFF and data[pos + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[pos + 2 : pos + 4], "big")
            if data[pos + 1] == 0xE1 and data[pos + 4 : pos + 10] == b"Exif\0\0":
                at = pos + 10
                break
            pos += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        found = data.find(b"eXIf")
        at = found + 4 if found > 0 else -1
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = data.find(b"EXIF")
        at = found + 8 if found > 0 else -1
        at += 6 if data[at : at + 6] == b"Exif\0\0" else 0
    if at < 0 or data[at : at + 2] not in (b"II", b"MM"):
        return 1
    order = "little" if data[at : at + 2] == b"II" else "big"
    entries = at + int.from_bytes(data[at + 4 : at + 8], order)
    for k in range(int.from_bytes(data[entries : entries + 2], order)):
        entry = data[entries + 2 + 12 * k : entries + 14 + 12 * k]
        if int.from_bytes(entry[:2], order) == 0x0112:
            tag = int.from_bytes(entry[8:10], order)
            return tag if 1 <= tag <= 8 else 1
    return 1


Decoder = Callable[[bytes], np.ndarray]


def decode(files: DataFrame, content: str = "content", decoders: dict[str, Decoder] | None = None, path: str = "path") -> DataFrame:
    """files with height, width, n_channels, data (RGB, turned upright) and error, by an Arrow kernel.

    PNG is read here. ``decoders`` maps further suffixes to functions of a file's bytes that give its samples
    (height, width, channels). Undecodable contents give nulls and the reason; they become FAILED rows later.
    """
    keep = [c for c in files.columns if c != content]
    known = {".png": read_png} | (decoders or {})

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row, out = b.slice(k, 1), (None, None, None, None, "no content")
                raw = row.column(content)[0].as_py()
                name = row.column(path)[0].as_py() if path in b.schema.names else ""
                try:
                    if raw is not None:
                        read = read_png if raw[:4] == b"\x89PNG" else known.get("." + (name or "").rsplit(".", 1)[-1].lower(), read_png)
                        img = np.ascontiguousarray(orient(as_rgb(read(raw)), exif_orientation(raw)))
                        out = (img.shape[0], img.shape[1], 3, img.tobytes(), None)
                except Exception as e:  # whatever a decoder raises is the image's own error
                    out = (None, None, None, None, str(e) or type(e).__name__)
                cols = [pa.array([v], t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in keep), *cols], names=[*keep, "height", "width", "n_channels", "data", "error"])

    schema = extend(files.select(*keep).schema, IMAGE_FIELDS)
    return files.select(*keep, content).mapInArrow(run, schema)


IMAGE_FIELDS = "height int, width int, n_channels int, data binary, error string"
JVM_SUFFIXES = (".jpg", ".jpeg", ".bmp", ".gif")
#: Bytes at a file's beginning in which its EXIF part is looked for.
HEAD = 1 << 17


def _head(uri: str) -> bytes:
    """The beginning of a file by its (percent-encoded) URI, in whatever file system it is."""
    if uri.startswith("file:"):
        with open("/" + unquote(uri[5:]).lstrip("/"), "rb") as f:
            return f.read(HEAD)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(quote(uri, safe=":/%?=&+@"))
    with where.open_input_stream(name) as f:
        return f.read(HEAD)


def decode_with_jvm(spark: SparkSession, root: str, suffixes: tuple[str, ...] = JVM_SUFFIXES) -> DataFrame:
    """JPEG, BMP and GIF under root through Spark's own image source: path, then the fields of ``decode``, in RGB and upright.

    The orientation is read from each file's beginning on the executor that has its pixels, so no image moves.
    """
    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(root).select("image.*")
    img = img.withColumn("path", F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))).where(scalars.suffix(F.col("path")).isin(*suffixes))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                out = (None, None, None, None, "cannot be decoded")
                if row["height"] > 0:
                    bgr = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                    rgb = bgr[..., 2::-1] if row["nChannels"] >= 3 else as_rgb(bgr)
                    try:
                        tag = exif_orientation(_head(row["origin"]))
                    except (OSError, ValueError):  # pixels without a readable file stay as they are
                        tag = 1
                    rgb = np.ascontiguousarray(orient(rgb, tag))
                    out = (rgb.shape[0], rgb.shape[1], 3, rgb.tobytes(), None)
                cols = [pa.array([v], t) for v, t in zip((row["path"], *out), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "height", "width", "n_channels", "data", "error"])

    return img.mapInArrow(run, f"path string, {IMAGE_FIELDS}")


def read_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = Settings().extensions, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """(source_file, height, width, n_channels, data, error) of all images under root, whatever their kind.

    JPEG goes through the JVM, PNG and the suffixes of ``decoders`` (WebP, for one) through ``decode``; each
    file is read by one of the two. A suffix that neither knows gives an error row.
    """
    jvm = tuple(e for e in extensions if e in JVM_SUFFIXES and e not in (decoders or {}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = tuple(e for e in extensions if e not in jvm)
    own = decode(files.where(scalars.is_image(F.col("path"), rest)).select("path", "content"), decoders=decoders)
    base = root.rstrip("/") + "/"
    both = own.unionByName(decode_with_jvm(spark, root, jvm)) if jvm else own
    at = F.locate(base, F.col("path"))
    relative = F.when(at > 0, F.substr(F.col("path"), at + len(base))).otherwise(F.col("path"))
    return both.select(relative.alias("source_file"), "height", "width", "n_channels", "data", "error")


def locate_cutouts(originals: DataFrame, ready: DataFrame, review: DataFrame) -> DataFrame:
    """originals (path, relative) with the cut-out of the same stem, from ready before review; without one they go."""
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]+$", "")
    both = ready.select(F.col("path").alias("cutout"), F.lit(0).alias("rank")).unionByName(review.select(F.col("path").alias("cutout"), F.lit(1).alias("rank")))
    best = both.groupBy(stem(F.col("cutout")).alias("_stem")).agg(F.min_by("cutout", "rank").alias("cutout"))
    return originals.withColumn("_stem", stem(F.col("path"))).join(best, "_stem").drop("_stem")
