"""Fixtures that every operator on documents has to survive."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, n string, id string, key string, h string, tk string, size string, bucket string, rank string, _d string"
EXTRA = ("x",) * 9

SF = "/root/testdata/sf0.001"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(300)]
    text = " ".join(base)
    edited = " ".join(base[:140] + ["new", "words"] + base[142:])
    line = " ".join(word() for _ in range(30))
    out = [
        (1, text, "en", "a"), (2, text, "en", "a"), (3, edited, "en", "b"), (4, "", "en", "b"), (5, None, None, None), (6, "   \n\t ", "fr", "a"),
        (7, "one", "fr", "c"), (8, "ONE", "fr", "c"), (9, "one two three four", "fr", "c"), (10, "a" * 3000, "de", "a"), (11, "12 34 !!", "de", "a"),
        (12, line + " " + " ".join(word() for _ in range(60)), "de", None), (13, " ".join(word() for _ in range(60)) + " " + line, "de", "a"), (14, "é" * 70 + "x", "fr", "a"),
        (15, "y" + "é" * 70, "fr", "a"), (16, " ".join(word() for _ in range(30_000)), "en", "a"), (17, text.upper(), "en", "a"), (17, text.upper(), "en", "a"),
    ]
    out += [(100 + i, f"{line} {word()} {word()} {' '.join(word() for _ in range(20))}", "en", "hot") for i in range(40)]
    return [(d, t, g, s, len(t) if t is not None else None, *EXTRA) for d, t, g, s in out]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DDL)


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
