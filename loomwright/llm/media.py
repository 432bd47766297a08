"""Media columns: byte payloads stored as lossless WebP images and read back as pixel arrays.

A payload's bytes are the samples of one grey image of 64 columns; beyond a mebibyte (64 x 16384 samples) the image is wider, up to
16384 columns. Pixels behind the last sample are transparent. Only a payload of more than 256 mebibytes is
several files, one after the other, each with its own length in its header.

How an image is written is chosen by size: with or without back-references, by a palette that bundles several pixels where there are
few values, or by the differences from a predictor, whatever the entropy of the symbols promises to be smallest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

COLUMNS = 64
OPAQUE = np.uint32(0xFF000000)
#: Bits that a back-reference takes besides the logarithms of its length and distance, about.
REFERENCE = 7
#: References take longer to write and read than literals, so they must save a tenth.
WORTH = 1 / 0.9


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with bytes 0 up to a positive multiple of COLUMNS."""
    data = (text or "").encode()
    return data + bytes(-len(data) % COLUMNS or (0 if data else COLUMNS))


def _entropy(counts: np.ndarray) -> float:
    """Bits of all symbols with these counts."""
    used = counts[counts > 0].astype(np.float64)
    return float((used * np.log2(used.sum() / used)).sum())


def _with_references(values: np.ndarray, found: tuple) -> float:
    """Bits with these back-references, roughly."""
    starts, lengths, distances = found
    if not len(starts):
        return float("inf")
    literal = _entropy(np.bincount(values[~webp.covered(len(values), starts, lengths)]))
    return (literal + float(np.log2(lengths).sum() + np.log2(distances).sum()) + REFERENCE * len(starts)) * WORTH


def plan(samples: np.ndarray) -> dict:
    """What webp.encode() is to do with grey samples (rows, columns), by the estimated size of each way."""
    flat = samples.ravel()
    counts = np.bincount(flat)
    found = webp.repeats(flat)
    ways = [(_entropy(counts), {"transforms": [(webp.SUBTRACT_GREEN,)]}), (_with_references(flat, found), {"transforms": [(webp.SUBTRACT_GREEN,)], "references": found})]
    if np.count_nonzero(counts) <= 16:
        ways.append((_entropy(counts) / 2, {"transforms": [(webp.PALETTE,)], "references": True}))
    for mode, back in ((1, 1), (2, samples.shape[1])):  # the pixel on the left, the one above
        residues = _entropy(np.bincount(flat[back:] - flat[:-back])) + 8 * back if len(flat) > back else float("inf")
        if (residues + 60) * WORTH < ways[0][0]:
            tiles = np.full((-(-samples.shape[0] // 512), -(-samples.shape[1] // 512)), mode)
            ways.append(((residues + 60) * WORTH, {"transforms": [(webp.SUBTRACT_GREEN,), (webp.PREDICTOR, 9, tiles)], "references": True}))
    return min(ways, key=lambda f: f[0])[1]


def store(payload: bytes) -> bytes:
    """Grey images: subtract-green leaves red and blue 0, so each sample is one green symbol."""
    files = []
    for at in range(0, len(payload), webp.MAX_SIDE**2):
        part = np.frombuffer(payload[at : at + webp.MAX_SIDE**2], dtype=np.uint8)
        columns = COLUMNS * -(-len(part) // (COLUMNS * webp.MAX_SIDE))
        rows = -(-len(part) // columns)
        samples = np.zeros(rows * columns, dtype=np.uint8)
        samples[: len(part)] = part
        grey = samples.astype(np.uint32) * np.uint32(0x010101) | OPAQUE
        grey[len(part) :] = 0
        files.append(webp.encode(grey.reshape(rows, columns), **plan(samples.reshape(rows, columns))))
    return b"".join(files)


def pixels(media: bytes) -> np.ndarray:
    """The grey samples of all images of a stored form, in rows of COLUMNS, uint8."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        image = webp.decode(media[at : at + size]).ravel()
        parts.append((image >> np.uint32(8)).astype(np.uint8)[image >= OPAQUE])
        at += size
    return np.concatenate(parts).reshape(-1, COLUMNS) if parts else np.zeros((0, COLUMNS), dtype=np.uint8)


def feature(image: np.ndarray) -> str:
    """Size, number of sample values, mean in thousandths, and mean absolute step along rows in thousandths."""
    flat = image.ravel().astype(np.int64)
    used = int(np.count_nonzero(np.bincount(flat, minlength=256)))
    steps = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum()) if image.size else 0
    n = max(1, len(flat))
    return f"{image.shape[1]}x{image.shape[0]} values={used} mean={1000 * int(flat.sum()) // n} step={1000 * steps // n}"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, media (the stored form). A null text is stored as an empty one is: COLUMNS zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "media": [store(payload_of(t)) for t in batch["text"]]})

    return _own(docs, id_col, text_col).mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per row: id, n_rows, pixels (samples by row, COLUMNS each), feature. A null stored form has no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [pixels(m or b"") for m in batch["media"]]
            yield pd.DataFrame({"id": batch["id"], "n_rows": [len(i) for i in images], "pixels": [i.tobytes() for i in images], "feature": [feature(i) for i in images]})

    own = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return own.mapInPandas(run, f"id {media.schema[id_col].dataType.simpleString()}, n_rows bigint, pixels binary, feature string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store_texts and read_media of each row in one pass, as digests: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All but n_bytes and the media's own are computed from what is read back. Null counts as empty; equal texts
    give equal values; rows are neither dropped nor combined, texts are stored whole, and other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                media = store(payload_of(text))
                image = pixels(media)
                back = image.tobytes()
                rows.append((len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=batch.index)
            yield pd.concat([batch[["id"]], out], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        _own(docs, id_col, text_col)
        .mapInPandas(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
        .withColumnRenamed("id", id_col)
    )


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
