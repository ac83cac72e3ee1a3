"""From an image's bytes to its best face: decoding, detection, sharpness and embedding in one pass, behind an interface for the model.

A model is a callable of a grey image (rows x columns, uint8) that returns faces. It is made once for each worker task. Without one installed,
`whole_image` stands in. PNM and 8-bit PNG are decoded here; another decoder can be passed for more kinds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality

FACE = "bbox array<int>, detector_score double, face_width double, face_height double, sharpness double, detected_sex string, landmarks_available boolean, found array<float>"


@dataclass
class Face:
    box: tuple[float, float, float, float]  # left, top, right, bottom
    score: float
    embedding: list[float] | np.ndarray | None = None
    gender: int | None = None  # 1 is male
    landmarks: object = None


Model = Callable[[np.ndarray], list[Face]]


def _grey(x: np.ndarray) -> np.ndarray:
    if x.ndim == 2:
        return x
    return np.rint(x[..., :3].astype(np.float64) @ (0.299, 0.587, 0.114)).astype(np.uint8) if x.shape[2] > 2 else x[..., 0]


def _pnm(data: bytes) -> np.ndarray | None:
    head = re.match(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if head is None or not 0 < int(head[4]) < 256:
        return None
    w, h, deep = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    body = np.frombuffer(data, np.uint8, offset=head.end())
    return _grey(body[: w * h * deep].reshape(h, w, deep)) if w * h and len(body) >= w * h * deep else None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head = 8, [], None
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 21]
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9]) if head is not None and len(head) == 13 else None
    if channels is None or head[8] != 8 or head[12]:
        return None
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if not w * h or len(raw) != h * (w * channels + 1):
        return None
    rows = raw.reshape(h, -1)
    out = np.zeros((h + 1, w + 1, channels), np.int32)  # a row above and a pixel to the left of nothing
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:].reshape(w, channels).astype(np.int32), out[y]
        if kind in (0, 2):
            out[y + 1, 1:] = (line + (up[1:] if kind else 0)) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) & 255
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], up[x + 1], up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return _grey(out[1:, 1:].astype(np.uint8)) if channels > 1 else out[1:, 1:, 0].astype(np.uint8)


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey image, None where the bytes are no whole image of a known kind."""
    if not data:
        return None
    return _png(data) if data.startswith(b"\x89PNG\r\n\x1a\n") else _pnm(data)


def sharpness(grey: np.ndarray) -> float:
    """Variance of the Laplacian (the four neighbours less four times the pixel), mirrored at the border without repeating it; nothing is 0."""
    if not grey.size:
        return 0.0
    x = np.pad(grey.astype(np.float64), [(1, 1) if n > 1 else (0, 0) for n in grey.shape], mode="reflect")
    x = np.pad(x, [(0, 0) if n > 1 else (1, 1) for n in grey.shape], mode="edge")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def whole_image(embed: Callable[[np.ndarray], list[float]] | None = None) -> Model:
    """Stand-in for a detector: the image is one face, certain and without landmarks or sex; its embedding is the unit vector of a coarse copy."""

    def coarse(grey: np.ndarray) -> list[float]:
        rows, columns = (np.linspace(0, n, 9).astype(int) for n in grey.shape)
        x = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])]).ravel()
        x = x - x.mean() if x.std() > 0 else x + 1
        return (x / np.linalg.norm(x)).tolist()

    return lambda grey: [Face((0, 0, grey.shape[1], grey.shape[0]), 1.0, (embed or coarse)(grey))]


def _one(grey: np.ndarray, model: Model) -> tuple:
    faces = model(grey)
    if not faces:
        return (None,) * 8
    face = max(faces, key=lambda f: f.score)  # the first of equals
    left, top, right, bottom = box = [int(v) for v in face.box]
    sex = None if face.gender is None else "male" if int(face.gender) == 1 else "female"
    vector = None if face.embedding is None else [float(v) for v in face.embedding]
    return box, float(face.score), float(right - left), float(bottom - top), sharpness(grey[max(0, top) : bottom, max(0, left) : right]), sex, face.landmarks is not None, vector


def assess(images: DataFrame, make_model: Callable[[], Model] = whole_image, read: Callable[[bytes | None], np.ndarray | None] = decode, **gate) -> DataFrame:
    """record_id, usable, failure_reason, bbox, detector_score, face_width, face_height, blur_score, detected_sex, landmarks_available, quality_band,
    quality_reasons, embedding of (record_id, content): the best face of each image. What doesn't pass the gate has no sharpness and no embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, names = make_model(), [x.split()[0] for x in FACE.split(", ")]
        for batch in batches:
            grey = [read(x) for x in batch["content"]]
            rows = [(None,) * 8 if g is None else _one(g, model) for g in grey]
            yield pd.DataFrame({"record_id": batch["record_id"], "readable": [g is not None for g in grey], **{n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*rows))}})

    d = images.select(F.col("record_id").cast("string").alias("record_id"), "content").mapInPandas(run, f"record_id string, readable boolean, {FACE}")
    size = [F.col(c) for c in ("face_width", "face_height", "detector_score")]
    hard = {k: v for k, v in gate.items() if k != "min_blur"}
    why = F.when(~F.col("readable"), "unreadable_image").when(F.col("bbox").isNull(), "no_face_detected").otherwise(quality.failure(*size, **hard))
    d = d.withColumn("failure_reason", why)
    usable = F.col("failure_reason").isNull()
    q = quality.assessment(*size, F.col("sharpness"), F.col("landmarks_available"), **gate)
    # a failed image has its reason alone; the vector is brought to length 1
    norm = F.sqrt(F.aggregate("found", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform("found", lambda x: (x / norm).cast("float"))).otherwise(F.col("found"))
    return d.select(
        "record_id", usable.alias("usable"), "failure_reason", "bbox", "detector_score", "face_width", "face_height", F.when(usable, F.col("sharpness")).alias("blur_score"), "detected_sex", "landmarks_available",
        F.when(usable, q["quality_band"]).otherwise("unusable").alias("quality_band"), F.when(usable, q["quality_reasons"]).otherwise(F.array("failure_reason")).alias("quality_reasons"), F.when(usable, unit).alias("embedding"),
    )
