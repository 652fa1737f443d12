"""Media columns: payloads as lossless WebP pixels, read back to pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm import webp, webp_many

#: Bytes of a row of pixels: 48 pixels of four 8-bit samples.
ROW = 192
#: Rows of one image; a longer payload is a sequence of images.
ROWS = webp.MOST


def pad(data: bytes) -> bytes:
    """data with spaces appended up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def store_many(payloads: list[bytes], at_once: int = 1 << 21) -> list[bytes]:
    """Each payload's bytes as samples of one or more WebP files, one after the other; about `at_once` bytes are written together."""
    out, lo = [], 0
    ends = np.cumsum([len(p) for p in payloads])
    while lo < len(payloads):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, "right")))
        out += _store(payloads[lo:hi])
        lo = hi
    return out


def _store(payloads: list[bytes]) -> list[bytes]:
    rows = [np.frombuffer(p, np.uint8).reshape(-1, ROW // 4, 4) for p in payloads]
    parts = [[r[lo : lo + ROWS] for lo in range(0, len(r), ROWS)] for r in rows]
    files = iter(webp_many.encode_many([image for images in parts for image in images]))
    return [b"".join([next(files) for _ in images]) for images in parts]


def load_many(media: list[bytes]) -> list[list[np.ndarray]]:
    """The pixel arrays of sequences of WebP files."""
    parts = [webp.frames(m) for m in media]
    images = iter(webp_many.decode_many([f for files in parts for f in files]))
    return [[next(images) for _ in files] for files in parts]


def together(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of payloads to handle together: like sizes, bounded in number and bytes."""
    held, total = [], 0
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        if held and (len(held) == webp_many.LANES or total + sizes[k] > 4 * webp_many.PIXELS):
            yield held
            held, total = [], 0
        held.append(k)
        total += sizes[k]
    if held:
        yield held


def features(images: list[np.ndarray]) -> str:
    """Size, and of each channel mean, standard deviation and mean step to the right, from exact sums."""
    total = np.zeros(4, np.int64)
    squares = np.zeros(4, np.int64)
    steps = np.zeros(4, np.int64)
    n = n_steps = 0
    for image in images:
        for lo in range(0, len(image), 4096):
            part = image[lo : lo + 4096].astype(np.int32)
            total += part.sum(axis=(0, 1), dtype=np.int64)
            squares += (part * part).sum(axis=(0, 1), dtype=np.int64)
            steps += np.abs(np.diff(part, axis=1)).sum(axis=(0, 1), dtype=np.int64)
        n += image.shape[0] * image.shape[1]
        n_steps += image.shape[0] * (image.shape[1] - 1)
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    step = steps / max(n_steps, 1)
    size = "+".join(f"{i.shape[1]}x{i.shape[0]}" for i in images)
    return size + "".join(f";{name}=" + ",".join(f"{x:.3f}" for x in v) for name, v in (("mean", mean), ("sd", spread), ("step", step)))


def decode_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Each image of a column of WebP sequences: doc_id, frame, width, height, pixels (rows of red, green, blue, alpha), error.

    Null media have no rows; media that can't be read are one row of frame -1 with the reason in error. Repeated rows
    give repeated results. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, media in enumerate(b.column(1)):
                if not media.is_valid:
                    continue
                try:
                    rows += [(k, f, i.shape[1], i.shape[0], i.tobytes(), None) for f, i in enumerate(load_many([media.as_py()])[0])]
                except webp.BadImage as e:
                    rows.append((k, -1, None, None, None, str(e)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.binary()),
                 pa.array(cols[5], pa.string())], names=["doc_id", "frame", "width", "height", "pixels", "error"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(work, f"doc_id {kind}, frame int, width int, height int, pixels binary, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores whole texts (null: empty) as media, reads the stored bytes back and describes what was read.

    One row per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and
    media). Equal texts give equal values, repeated rows repeated rows; other columns don't matter. The texts of a batch are written
    and read in groups of like size, of bounded bytes. An empty table gives an empty result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [data.as_py() or b"" for data in b.column(1)]
            rows: list[tuple] = [()] * len(raws)
            for part in together([len(raw) for raw in raws]):
                stored = store_many([pad(raws[k]) for k in part])
                for k, media, images in zip(part, stored, load_many(stored)):
                    back = b"".join(i.tobytes() for i in images)
                    rows[k] = (len(raws[k]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                               hashlib.sha256(media).hexdigest(), features(images), *([media] if with_media else []))
            cols = list(zip(*rows)) or [[]] * (7 + with_media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                                                    "media_sha256", "feature", "media"][: 8 + with_media])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
                                 "media_sha256 string, feature string" + ", media binary" * with_media)
