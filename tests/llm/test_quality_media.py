from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkforge.llm import media, quality

from .cases import frame


def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.85, 0.7, 0.9, 0.6])
    x = np.where(rng.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    x[rng.random(x.shape) < 0.3] = 2
    patterns, counts = np.unique(x, axis=0, return_counts=True)
    post, table = quality.expectation_maximisation(patterns, counts.astype(float))
    accuracy = table[1, :, 1] / (table[1, :, 0] + table[1, :, 1])
    assert np.abs(accuracy - right).max() < 0.04
    code = {tuple(p): v for p, v in zip(patterns.tolist(), post)}
    assert np.mean([(code[tuple(r)] > 0.5) == t for r, t in zip(x.tolist(), truth)]) > 0.93


def test_held_out_quality(spark):
    """The labels were never seen: good documents are kept, bad ones score lower."""
    d = "/root/testdata/sf0.01"
    rows = quality.classify(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) > 0.97
    wins = np.mean([g["score"] > b["score"] for g in good for b in bad])
    assert wins > 0.85, wins


def test_scores_do_not_depend_on_partitions_and_ties(spark):
    """A third of the rows lacks an id, one id repeats, and the sample is smaller than either group."""
    rows = [(i if i % 3 else None if i % 2 else 7, f"the house of {i} and the garden is here for {'!' * (i % 5)} {i % 11}") for i in range(300)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # sums of a batch are rounded in its order: equal but for the last digits
    runs = [sorted(round(r["score"], 9) for r in quality.classify(docs.repartition(n), sample=40).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_defined_results(spark):
    docs = frame(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    assert all(got[k]["score"] == 0 and not got[k]["keep"] for k in (4, 5, 6))
    assert quality.classify(docs).count() == docs.count()
    assert quality.classify(frame(spark, [])).count() == 0


def picture(seed, side=120):
    rng = np.random.default_rng(seed)
    x = media.resize(rng.random((15, 15)), side / 15)
    return np.rint((x - x.min()) / (x.max() - x.min()) * 255).astype(np.uint8)


def pgm(x):
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.ascontiguousarray(x).tobytes()


def test_copies_are_found(spark):
    rows = []
    for k in range(6):
        x = picture(k)
        rows += [(10 * k, pgm(x)), (10 * k + 1, pgm(x[10:100, 20:118])), (10 * k + 2, pgm((x * 0.8 + 10).astype(np.uint8))), (10 * k + 3, pgm(np.rot90(x))), (10 * k + 4, pgm(x))]
        noisy = np.clip(x + np.random.default_rng(k).normal(0, 2, x.shape), 0, 255).astype(np.uint8)
        rows.append((10 * k + 5, pgm(noisy)))
    rows += [(100, None), (101, b""), (102, b"not an image"), (103, pgm(np.zeros((50, 50), np.uint8))), (104, pgm(np.zeros((1, 1), np.uint8)))]
    out = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame([(*r, "x") for r in rows], "image_id long, content binary, id string")).collect()}
    assert len(out) == len(rows)
    assert all(out[10 * k + j] == 10 * k for k in range(6) for j in range(6)), out
    assert all(out[k] == k for k in range(100, 105))
    empty = spark.createDataFrame([], "image_id long, content binary")
    assert media.image_copies(empty).count() == 0


def turned(x, degrees):
    h, w = x.shape
    a, (yy, xx) = np.deg2rad(degrees), np.mgrid[:h, :w]
    dx, dy = xx - (w - 1) / 2, yy - (h - 1) / 2
    sx, sy = (np.clip(v, 0, n - 1.001) for v, n in ((np.cos(a) * dx - np.sin(a) * dy + (w - 1) / 2, w), (np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2, h)))
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    return ((x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy)[h // 8 : -h // 8, w // 8 : -w // 8]


def edited(x, k):
    noise = np.random.default_rng(k).normal(0, 1, x.shape)
    h, w = x.shape
    blur = x.astype(float)
    for _ in range(3):
        blur = media.smooth(blur)
    return {
        "light": x * 0.8 + 10, "noise2": x + 2 * noise, "noise8": x + 8 * noise, "turn90": np.rot90(x), "turn10": turned(x, 10), "turn30": turned(x, 30), "crop75": x[h // 8 : 7 * h // 8, w // 8 : 7 * w // 8],
        "crop50": x[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4], "scale90": media.resize(x, 0.9), "scale80": media.resize(x, 0.8), "scale71": media.resize(x, 0.71), "scale60": media.resize(x, 0.6), "blur": blur,
    }


def test_recall_of_edited_copies(spark):
    """The final components, not proposals: one edit of each of 13 kinds for every of 40 pictures; pictures of different kinds stay apart."""
    rows, kind = [], {}
    for k in range(40):
        x = picture(k)
        rows.append((1000 * k, pgm(x)))
        for j, (name, y) in enumerate(edited(x.astype(float), k).items(), 1):
            rows.append((1000 * k + j, pgm(np.clip(np.rint(y), 0, 255).astype(np.uint8))))
            kind[1000 * k + j] = name
    out = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows, "image_id long, content binary")).collect()}
    assert all(c // 1000 == i // 1000 for i, c in out.items())
    for name in set(kind.values()):
        mine = [i for i in kind if kind[i] == name]
        assert np.mean([out[i] == out[i // 1000 * 1000] for i in mine]) >= 0.9, name


def test_candidates_miss_few_pairs_that_the_consensus_confirms():
    """Single edits against all-pairs consensus: no third copy helps."""
    lost, all_ = 0, 0
    for k in range(12):
        x = picture(100 + k)
        p, c = media.corners(x)
        own = media.keys_of(p, c)
        for y in edited(x.astype(float), k).values():
            q, d = media.corners(np.clip(np.rint(y), 0, 255))
            if media.confirmed(p, c, q, d):
                all_ += 1
                lost += np.isin(own, media.keys_of(q, d)).sum() < media.SHARED
    assert all_ > 140 and lost <= 0.1 * all_, (lost, all_)


def test_truncated_and_equal_contents(spark):
    x = pgm(picture(1))
    odd = [b"P5 10", b"P5", b"P5 ", b"P5 3 3", b"P5 # open", b"P6 2 2 255\n1", b"P5 -1 4 255\n", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n\x00\x00", x[:100]]
    assert all(media.decode(data) is None for data in odd)
    flat = pgm(np.zeros((50, 50), np.uint8))
    rows = [(5, flat), (3, flat), (9, None), (8, None), (7, b"jpeg?"), (6, b"jpeg?"), (2, x), (2, x), (11, x)]
    got = sorted((r["image_id"], r["component_id"]) for r in media.image_copies(spark.createDataFrame(rows, "image_id long, content binary")).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 9), (11, 2)]


def test_drawn_pictures_keep_their_corners(spark):
    vectors = np.random.default_rng(3).normal(size=(20, 64)).tolist()
    drawn = media.pictures(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    grey = [media.decode(bytes(r["content"])) for r in drawn]
    assert {x.shape for x in grey} == {(96, 96)}
    assert all(len(media.corners(x)[0]) > 60 for x in grey)
    assert media.pictures(spark.createDataFrame([(1, [0.5] * 50 + [1.0])], "vec_id long, embedding array<double>")).first()["content"] is not None


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 4), st.integers(1, 3))
def test_png_round_trip(kind, seed):
    import zlib

    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (6, 5), dtype=np.uint8)
    above, lines = np.zeros(5, int), b""
    for row in x.astype(int):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = [np.zeros(5, int), left, above, (left + above) // 2, paeth][kind]
        lines += bytes([kind]) + bytes(((row - guess) % 256).tolist())
        above = row
    part = lambda name, body: len(body).to_bytes(4, "big") + name + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", (5).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    assert (media.decode(png) == x).all()


def test_contents_without_an_id_link_as_well(spark):
    """The same picture, whole and cropped, with and without ids."""
    rng = np.random.default_rng(4)
    small = media.resize(rng.normal(size=(24, 24)), 5)
    x = np.rint((small - small.min()) / (small.max() - small.min()) * 255).astype(np.uint8)
    pgm = lambda a: b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a).tobytes()
    whole, crop = pgm(x), pgm(x[10:110, 10:110])
    other = pgm(np.rint(np.clip(media.resize(rng.normal(size=(24, 24)), 5), -2, 2) * 60 + 125).astype(np.uint8))
    rows = [(None, whole), (5, crop), (None, whole), (None, other), (3, None), (None, None)]
    got = [tuple(r) for r in media.image_copies(spark.createDataFrame(rows, "image_id long, content binary")).collect()]
    assert sorted((c for _, n, c in got if n), key=str) == [5, 5, 5, None]
    assert sorted((c for _, n, c in got if not n), key=str) == [3, None]


def test_chance_meetings_in_large_buckets_are_no_rows(spark, monkeypatch):
    """60 images that all meet in one bucket, some of them in a second one: the pairs of brute force, and rows for these alone."""
    rng = np.random.default_rng(6)
    buckets = {1: list(range(60)), **{k: sorted(rng.choice(60, 10, replace=False).tolist()) for k in range(2, 8)}, 9: list(range(40, 55))}
    part = {i: 40 if 40 <= i < 55 else i - i % 3 for i in range(60)}
    rows = spark.createDataFrame([(k, i, ids[0], len(ids)) for k, ids in buckets.items() for i in ids], "key long, id long, lo long, m long")
    group = spark.createDataFrame([(i, c) for i, c in part.items() if i != c or i == 40], "id long, component long")
    shared = Counter((a, b) for ids in buckets.values() for a, b in combinations(ids, 2) if part[a] != part[b])
    want = {p: n for p, n in shared.items() if n >= media.SHARED}
    assert 0 < len(want) < len(shared) / 2
    made = media.across(rows, group).collect()
    assert Counter((r["a"], r["b"]) for r in made) == want
    assert {tuple(r) for r in media.crossing(rows, group).collect()} == set(want)
    monkeypatch.setattr(media, "KNOWN", 1)  # the listing by counts
    assert {tuple(r) for r in media.crossing(rows, group).collect()} == set(want)


def test_descriptors_are_dealt_once(spark):
    """More pairs than images: all are looked at, in rounds, and the images' own descriptors stay where they were written."""
    grey = [np.rint(np.clip(media.resize(np.random.default_rng(k // 5).normal(size=(24, 24)), 5), -2, 2) * 60 + 125) for k in range(20)]
    rows = []
    for k, x in enumerate(grey):
        p, c = media.corners(x[k % 5 :, k % 5 :])
        rows.append((bytes([k]), k, len(p), p.astype(np.float32).tobytes(), c.tobytes()))
    found, drop = media.bucketed(spark.createDataFrame(rows, media.FEATURES), "id")
    pairs = spark.createDataFrame(list(combinations(range(20), 2)), "a long, b long")
    assert {tuple(r) for r in media.verified(pairs, found).collect()} == {(a, b) for a, b in combinations(range(20), 2) if a // 5 == b // 5}
    have = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = media.beside(pairs, found)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", have)
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the pairs by either image
    drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("linkforge_")]


def test_a_group_of_copies_gives_no_pairs(spark):
    """Many small buckets of one component are not expanded; pairs across components are those of brute force."""
    rng = np.random.default_rng(8)
    buckets = {k: sorted(rng.choice(30, int(rng.integers(2, 12)), replace=False).tolist()) for k in range(150)}
    part = {i: 0 if i < 24 else i for i in range(30)}
    rows = spark.createDataFrame([(k, i, ids[0], len(ids)) for k, ids in buckets.items() for i in ids], "key long, id long, lo long, m long")
    group = spark.createDataFrame([(i, 0) for i in range(24)], "id long, component long")
    shared = Counter()
    for ids in buckets.values():
        listed = combinations(ids, 2) if len(ids) <= media.SMALL else ((ids[0], i) for i in ids[1:])
        shared.update((a, b) for a, b in listed if part[a] != part[b])
    want = {p for p, n in shared.items() if n >= media.SHARED}
    assert want and {tuple(r) for r in media.candidates(rows, group).collect()} == want
    assert media.candidates(rows.where("id < 24"), group).count() == 0
