"""From bytes to a shortlist: decoding, sharpness, the best face, the gate, and pages of any depth."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.functions import vision
from linkforge.service import Engine, page_of

FIELDS = "record_id string, pos long, sex string, detected_sex string, age_min double, age_max double, height_cm double, event_day date, location string, province string, district string, municipality string, embedding array<float>, usable boolean"


def pgm(x):
    return b"P5 %d %d 255\n" % x.shape[::-1] + x.astype(np.uint8).tobytes()


def png(x, filters):
    """8-bit PNG of grey or colour rows, each with one of the five filters."""
    h, w = x.shape[:2]
    rows, n = x.reshape(h, -1).astype(int), x.size // (h * w)
    out = b""
    for y in range(h):
        line, kind = [], filters[y % len(filters)]
        for k, v in enumerate(rows[y]):
            a, b, c = (rows[y][k - n] if k >= n else 0), (rows[y - 1][k] if y else 0), (rows[y - 1][k - n] if y and k >= n else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(9, 7), (6, 5, 3), (4, 4, 4)])
def test_decoding(shape):
    x = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    grey = x if x.ndim == 2 else np.rint(x[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    whole = png(x, [0, 1, 2, 3, 4])
    assert np.array_equal(vision.decode(whole), grey)
    assert all(vision.decode(whole[:k]) is None for k in range(0, len(whole) - 16, 5))
    if x.ndim == 2:
        assert np.array_equal(vision.decode(pgm(x)), x) and vision.decode(pgm(x)[:-1]) is None
    assert vision.decode(b"\xff\xd8junk") is None and vision.decode(None) is None and vision.decode(b"P5 0 0 255\n") is None


def test_sharpness_equals_a_naive_convolution():
    rng = np.random.default_rng(2)
    for shape in ((8, 8), (1, 6), (6, 1), (2, 2), (1, 1), (13, 30)):
        x = rng.integers(0, 256, shape)
        inside = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i if i >= n else i
        at = lambda y, k, x=x, shape=shape: float(x[inside(y, shape[0]), inside(k, shape[1])])
        v = [at(y - 1, k) + at(y + 1, k) + at(y, k - 1) + at(y, k + 1) - 4 * at(y, k) for y in range(shape[0]) for k in range(shape[1])]
        assert vision.sharpness(x.astype(np.uint8)) == pytest.approx(np.var(v))
    assert vision.sharpness(np.zeros((0, 5), np.uint8)) == 0.0


def bright(grey):
    """A detector for tests: two boxes around what is over 200, the right one second and as sure; male if it is wide."""
    rows, columns = np.nonzero(grey > 200)
    if not len(rows):
        return []
    box = (columns.min() - 3, rows.min(), columns.max() + 1.9, rows.max() + 1)
    wide = box[2] - box[0] > box[3] - box[1]
    return [vision.Face(box, 0.9, [3.0, 4.0], int(wide), (1, 2)), vision.Face((0, 0, 1, 1), 0.9), vision.Face((0, 0, 100, 100), 0.4)]


def picture(width, height):
    x = np.tile(np.arange(120) % 7 * 10, (120, 1))
    x[10 : 10 + height, 2 : 2 + width] = 230
    x[12, 4] = 210
    return pgm(x)


def test_best_face_gate_and_reasons(spark):
    rows = [("wide", picture(80, 60)), ("tall", picture(45, 90)), ("small", picture(20, 20)), ("none", pgm(np.zeros((5, 5)))), ("broken", b"P5 9 9 255\nx"), ("empty", None)]
    got = {r["record_id"]: r for r in vision.assess(spark.createDataFrame(rows, "record_id string, content binary"), lambda: bright).collect()}
    assert {k: r["failure_reason"] for k, r in got.items()} == {"wide": None, "tall": None, "small": "face_too_small", "none": "no_face_detected", "broken": "unreadable_image", "empty": "unreadable_image"}
    wide, small = got["wide"], got["small"]
    assert wide["bbox"] == [-1, 10, 82, 70] and (wide["face_width"], wide["face_height"], wide["detected_sex"], got["tall"]["detected_sex"]) == (83.0, 60.0, "male", "female")
    assert wide["embedding"] == pytest.approx([0.6, 0.8]) and wide["blur_score"] > 0 and wide["quality_band"] == "good" and wide["usable"]
    assert small["embedding"] is None and small["blur_score"] is None and small["detector_score"] == 0.9 and small["quality_reasons"] == ["face_too_small"] and small["quality_band"] == "unusable"
    grey = vision.decode(picture(80, 60))
    assert wide["blur_score"] == pytest.approx(vision.sharpness(grey[10:70, 0:82]))
    blurry = vision.assess(spark.createDataFrame(rows[:1], "record_id string, content binary"), lambda: bright, min_blur=1e9).first()
    assert blurry["usable"] and blurry["quality_reasons"] == ["blurry"] and blurry["quality_band"] == "moderate"


def test_upload_from_bytes_to_shortlist(spark):
    person = lambda side, k, sex, v, usable=True: (f"{side}{k}", k, sex, None, 30.0 + k, None, 170.0, None, "Kavre", None, None, None, v, usable)
    am = spark.createDataFrame([person("A", 0, "male", [0.6, 0.8]), person("A", 1, "male", [1.0, 0.0]), person("A", 2, "female", None)], FIELDS)
    pm = spark.createDataFrame([person("P", 0, "male", [0.0, 1.0])], FIELDS)
    engine = Engine(am, pm)

    def ask(content, **more):
        one = {"name": "x.pgm.jpg", "content": content, "content_type": "", "target": "am", "sex": "unspecified"} | more
        schema = "name string, content binary, content_type string, target string, sex string" + (", age_min double" if "age_min" in more else "")
        seen, found = engine.upload_image(spark.createDataFrame([tuple(one.values())], schema), 20, lambda: bright)
        return seen, found and {r["candidate_record_id"]: r for r in found.collect()}

    seen, found = ask(picture(80, 60))
    assert seen["has_face"] and seen["detected_sex"] == "male" and seen["quality_band"] == "good" and seen["error"] is None
    assert found.keys() == {"A0", "A1"} and found["A0"]["rank"] == 1 and found["A0"]["face_score"] == 1.0 and found["A0"]["candidate_source"] == "face+metadata"
    seen, found = ask(b"no image", age_min=30.0)
    assert not seen["has_face"] and seen["failure_reason"] == "unreadable_image" and found.keys() == {"A0", "A1", "A2"} and found["A0"]["candidate_source"] == "metadata_only" and found["A0"]["age_score"] == 1.0
    assert ask(b"") == ((seen := ask(b"")[0]), None) and seen["error"] == "empty file" and ask(b"x", target="zz")[0]["error"] == "invalid target"


def test_pages_of_any_depth(spark):
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") * F.col("id") - 7).alias("pos"), F.col("id").alias("k"))
    for limit, offset in ((10, 0), (25, 4980), (7, 2493), (0, 5), (10, 6000), (5000, 0)):
        total, page = page_of(rows, "pos", limit, offset)
        assert total == 5000 and [r["k"] for r in page.collect()] == list(range(5000))[offset : offset + limit]
    total, page = page_of(rows.orderBy("k"), "pos", 7, 2493)
    mixed = spark.createDataFrame([(None, 1), (3, 2), (None, 3), (-4, 4)], "pos long, k long")
    assert [r["k"] for r in page_of(mixed, "pos", 2, 2)[1].collect()] == [4, 2] and len(page_of(mixed, "pos", 2, 1)[1].collect()) == 2
    assert page_of(mixed.where("k = 1"), "pos", 5, 0)[1].count() == 1 and page_of(mixed.limit(0), "pos", 5, 0)[0] == 0
