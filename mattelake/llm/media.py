"""Media columns of lossless WebP images (operator 4).

``store`` turns payloads into images and writes them as a binary column; ``decode_column`` reads
such a column back into pixel arrays; ``text_media`` is the round trip over documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm import webp
from mattelake.llm.common import materialise, spread

UNIT = 64
#: A payload's rows are this wide, and wider only where an image would grow taller than the format allows.
ROW = 256
ROWS_AT_ONCE = 8192
PIXELS_AT_ONCE = 3 << 21
WRITTEN_AT_ONCE = 1 << 17


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def shape_of(n: int) -> tuple[int, int]:
    """(height, width) of n samples, n a multiple of 64: the widest divisor of up to ``ROW``, or as wide as needed."""
    for width in (ROW, 192, 128, 64):
        if n % width == 0 and n // width <= webp.MAX_SIDE:
            return n // width, width
    width = UNIT
    while n % width or n // width > webp.MAX_SIDE:
        width += UNIT
        if width > webp.MAX_SIDE:
            raise ValueError("the payload does not fit one image")
    return n // width, width


PART = webp.MAX_SIDE * UNIT


#: Transforms of the stored forms; each has general back-references.
FORMS = ("predictor", "cross", "palette", "groups")


def form_of(payload: bytes) -> str | None:
    """The form of a payload, by its checksum: equal payloads have equal forms.

    None, the plain grey palette image, is only for a payload of one unit: one row of sixteen pixels
    has no row above, no second block and no place that a reference could name.
    """
    return FORMS[zlib.crc32(payload) % len(FORMS)] if len(payload) > UNIT else None


def _square(n: int) -> tuple[int, int]:
    """(height, width) of n pixels of four samples, n a multiple of 16: as square as the predictors' waves allow."""
    width = 16
    while n % (2 * width) == 0 and width * width < 2 * n and width < webp.MAX_SIDE // 2:
        width *= 2
    return n // width, width


def _rich(payloads: list[bytes], form: str) -> list[bytes]:
    """Payloads as images of four samples a pixel, or grey ones of one sample for the palette (alpha is one of the four)."""
    raw = b"".join(payloads)
    if form == "palette":
        stack, grey = webp.Stack(*zip(*[shape_of(len(p)) for p in payloads])), np.frombuffer(raw, np.uint8).astype(np.uint32)
        return webp.encode_all(stack, np.uint32(webp.OPAQUE) | grey << np.uint32(16) | grey << np.uint32(8) | grey, palette=True, cache_bits=4)
    stack, pixels = webp.Stack(*zip(*[_square(len(p) // 4) for p in payloads])), np.frombuffer(raw, "<u4")
    if form == "predictor":
        return webp.encode_all(stack, pixels, predictor=webp.all_modes(stack, pixels, 3), shift=3)
    if form == "cross":
        return webp.encode_all(stack, pixels, cross=webp.all_cross(stack, pixels, 3), shift=3, green=True, cache_bits=6)
    return webp.encode_all(stack, pixels, cache_bits=8, groups=webp.all_groups(stack, pixels, 3), meta_shift=3)


def encode_payload(payload: bytes) -> bytes:
    """The stored form: one image, or for very long payloads images of ``PART`` samples one after another.

    Every part of more than a unit is stored by one of ``FORMS``, dealt evenly by checksum: predictors
    chosen block by block, cross-colour with subtract-green and a colour cache, bundled palettes with a
    cache, or several prefix-code groups with a cache; all have back-references of any distance.
    """
    return encode_payloads([payload])[0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """``encode_payload`` of each; images of one form are written together, up to about ``WRITTEN_AT_ONCE`` pixels of them."""
    parts = [(i, p[lo : lo + PART]) for i, p in enumerate(payloads) for lo in range(0, len(p), PART)]
    forms: dict[str | None, list[int]] = {}
    for k, (_, p) in enumerate(parts):
        forms.setdefault(form_of(p), []).append(k)
    stored = [b""] * len(parts)
    for form, own in forms.items():
        part = np.cumsum([len(parts[k][1]) // (1 if form == "palette" else 4) for k in own]) // WRITTEN_AT_ONCE
        for _, some in groupby(zip(part.tolist(), own), itemgetter(0)):
            some = [k for _, k in some]
            images = [parts[k][1] for k in some]
            for k, m in zip(some, _rich(images, form) if form else [webp.encode_gray(np.frombuffer(p, np.uint8).reshape(shape_of(len(p)))) for p in images]):
                stored[k] = m
    out = [b""] * len(payloads)
    for (i, _), m in zip(parts, stored):
        out[i] += m
    return out


def _files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def _samples(argb: np.ndarray) -> np.ndarray:
    red, green, blue = ((argb >> np.uint32(s)) & np.uint32(255) for s in (16, 8, 0))
    flat = (argb >= webp.OPAQUE).all() and (red == green).all() and (green == blue).all()
    return webp.grey(argb) if flat else argb.astype("<u4").view(np.uint8)


def decode_payload(media: bytes) -> list[np.ndarray]:
    """Sample arrays of the images stored one after another: a grey image's samples, or the four of each pixel."""
    return [_samples(webp.decode(f)) for f in _files(media)]


def decode_payloads(media: list[bytes]) -> Iterator[list[np.ndarray]]:
    """``decode_payload`` of each, where images of up to ``PIXELS_AT_ONCE`` in all are decoded together."""
    files = [(i, f) for i, m in enumerate(media) for f in _files(m)]
    counts = np.bincount([i for i, _ in files], minlength=len(media)).tolist()
    ends = np.cumsum([webp.pixels_of(f) for _, f in files])
    parts = int(ends[-1]) // PIXELS_AT_ONCE + 1 if files else 1
    part = ends * parts // (int(ends[-1]) + 1 if files else 1)
    decoded = (_samples(a) for _, some in groupby(zip(part.tolist(), files), itemgetter(0)) for a in webp.decode_many([f for _, (_, f) in some]))
    for n in counts:
        yield list(islice(decoded, n))


def feature(images: list[np.ndarray]) -> str:
    """Size, mean, mean absolute step along rows, and the shares of eight brightness bands in per mille."""
    n = sum(i.size for i in images)
    hist = sum(np.bincount(i.ravel(), minlength=256) for i in images)
    steps = sum(int(np.abs(np.diff(i.astype(np.int16), axis=1)).sum()) for i in images)
    bands = (hist.reshape(8, 32).sum(axis=1) * 1000 // n).tolist()
    return f"{images[0].shape[1]}x{sum(len(i) for i in images)};{int(hist @ np.arange(256)) / n:.3f};{steps / n:.3f};{'.'.join(map(str, bands))}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of whole texts as UTF-8; null is an empty text. Written to the shared folder."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_payloads([padded(r) for r in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = spread(docs.select("doc_id", F.col(text).alias("text")))
    return materialise(rows.mapInArrow(run, rows.drop("text").schema.add("n_bytes", "long").add("media", "binary")))


def decode_column(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with media decoded: width, height, pixels (binary, packed ARGB in row order, little-endian), error.

    A null, or bytes that are no lossless WebP image, give null pixels and the reason; the job goes on.
    """
    keep = [c for c in rows.columns if c not in ("width", "height", "pixels", "error")]
    wanted = rows.select(*keep)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                out = []
                for m in part.column(media).to_pylist():
                    try:
                        argb = webp.decode(m or b"")
                        out.append((argb.shape[1], argb.shape[0], argb.astype("<u4").tobytes(), None))
                    except (webp.WebPError, IndexError) as e:
                        out.append((None, None, None, str(e)))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*keep, "width", "height", "pixels", "error"])

    schema = rows.select(*keep).schema
    for name, kind in (("width", "integer"), ("height", "integer"), ("pixels", "binary"), ("error", "string")):
        schema = schema.add(name, kind)
    return wanted.mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Everything but n_bytes comes from the stored bytes read back. Texts of any length are stored whole, in
    images of a bounded size. Repeated rows and null ids stay as they are; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                out = []
                media = part.column("media").to_pylist()
                for m, images in zip(media, decode_payloads(media)):
                    payload = b"".join(i.tobytes() for i in images)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(images)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=list(NAMES))

    rows = store(docs)
    schema = rows.drop("media").schema
    for name in NAMES[2:]:
        schema = schema.add(name, "string" if name in ("payload_sha256", "media_sha256", "feature") else "long")
    return rows.mapInArrow(run, schema)


NAMES = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
