"""Images without what cameras and editors write beside the pixels: Exif, XMP, comments and texts.

JPEG segments and PNG chunks are copied or left out as they stand, so the pixels are exactly those of the source and nothing is encoded again.
An image of another kind, or one that breaks off, gives no content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Segments of a JPEG that decoding needs: JFIF, the colour profile, the colour transform. Other application segments and comments go.
KEPT_SEGMENTS = {0xE0, 0xE2, 0xEE}
DROPPED_CHUNKS = {b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"}


def _jpeg(data: bytes) -> bytes | None:
    out, at = [data[:2]], 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind == 0xD9:
            return b"".join([*out, b"\xff\xd9"])
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        end = at + 2 + size
        if size < 2 or end > len(data):
            return None
        if kind == 0xDA:  # a scan: its bytes go on to the next marker that is neither a stuffed byte nor a restart
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    return None
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
        if not (0xE0 <= kind <= 0xEF or kind == 0xFE) or kind in KEPT_SEGMENTS:
            out.append(data[at:end])
        at = end
    return None


def _png(data: bytes) -> bytes | None:
    out, at = [PNG], len(PNG)
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        kind = data[at + 4 : at + 8]
        if kind not in DROPPED_CHUNKS:
            out.append(data[at:end])
        if kind == b"IEND":
            return b"".join(out)
        at = end
    return None


def stripped(data: bytes | None) -> bytes | None:
    if not data:
        return None
    return _jpeg(data) if data[:2] == b"\xff\xd8" else _png(data) if data.startswith(PNG) else None


def clean_images(images: DataFrame, key: str = "record_id", content: str = "content") -> DataFrame:
    """key, image_sha256 of the bytes as they came, content and clean_sha256 of what is left; all empty for what is no whole image."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "content": [stripped(x) for x in batch["c"]], "image_sha256": batch["h"]})

    raw = images.select(key, F.col(content).alias("c"), F.sha2(content, 256).alias("h"))
    out = raw.mapInPandas(run, f"{key} {kind}, content binary, image_sha256 string")
    known = F.col("content").isNotNull()
    return out.select(key, F.when(known, F.col("image_sha256")).otherwise("").alias("image_sha256"), F.coalesce("content", F.lit(b"")).alias("content"), F.when(known, F.sha2("content", 256)).otherwise("").alias("clean_sha256"))
