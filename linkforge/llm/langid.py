"""Language identification by nearest centroids of TF-IDF byte n-grams.

A text is the unit vector of its hashed 1- to 3-grams over lower-cased bytes (blanks for all ASCII
but letters), term frequency 1 + ln(count), times the inverse document frequency of the sample. Every language has
`CENTROIDS` centroids from spherical k-means, so that different kinds of text of one language keep
their own; the nearest by cosine decides. A text is rejected where its cosine is
far below those of the language's own sample at about its length: vectors of short texts are sparse, and cosines grow with length.

The model is fitted on a bounded sample: the `SAMPLE` documents of each language with the smallest hash, found among those
under a threshold that the language's count sets, so no task ever ranks a language. Prediction reads the whole of every text.

A null text or one without a letter is `und` with score 0 and rejected. An empty training set predicts `und`
throughout. Repeated rows are predicted alike; other columns pass through `identify` unread, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh, lean, small_batches, text_chunks

UND = "und"
BITS = 12
DIMENSIONS = 1 << BITS
#: Documents of a language from which the model learns, at most, and its centroids.
SAMPLE, CENTROIDS = 400, 4
#: A text is foreign below this part of the cosine that all but `LOW` of the sample at about its length reach.
FAR, LOW = 0.65, 0.02
#: Lengths are compared by the binary logarithm of their n-grams; rows of the sample of which a quantile is taken, at least.
LENGTHS, ROWS = 48, 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, a row for each text; n-grams never cross texts."""
    n, rows = len(buf), len(off) - 1
    out = np.zeros(rows * DIMENSIONS, np.int64)
    if not n:
        return out.reshape(rows, DIMENSIONS)
    x = _FOLD[buf]
    # capital letters of the Latin-1 block: C3 80..9E
    upper = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
    x[upper] += 0x20
    x = x.astype(np.uint32)
    # the rows of a call times DIMENSIONS, and its bytes, are numbers of 32 bits, but for a text of 2 GB
    small = np.int32 if max(n, rows << BITS) < 1 << 31 else np.int64
    text = np.repeat(np.arange(rows, dtype=small) << BITS, np.diff(off))
    gram, left = x, np.repeat(off[1:].astype(small), np.diff(off))
    left -= np.arange(n, dtype=small)
    for size in (1, 2, 3):
        if size > 1:
            gram = (gram[:-1] << np.uint32(8)) | x[size - 1 :]
        ok = left[: len(gram)] >= size
        code = (gram * np.uint32(2654435761) + np.uint32(size * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        place = text[: len(gram)] + code.astype(small)
        del code
        out += np.bincount(place[ok], minlength=len(out))
        del place
    return out.reshape(rows, DIMENSIONS)


def unit(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(counted.shape, np.float32)
    some = counted > 0
    v[some] = 1 + np.log(counted[some])
    v *= idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=v, where=norm > 0)


def centroids(v: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start: no draw, so equal input gives equal centroids."""
    mean = v.sum(0)
    c = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(c) < min(k, len(v)):
        c.append(v[np.argmin(np.max(v @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c.astype(np.float32)


def length_of(counted: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(1, counted.sum(1))).astype(int)


def floors(length: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each length the cosine under which a text is foreign, from the sample's rows of about that length."""
    out = np.zeros(LENGTHS, np.float32)
    for k in range(LENGTHS):
        away = np.abs(length - k)
        reach = max(1, int(np.sort(away)[min(len(away), ROWS) - 1]))
        out[k] = FAR * np.quantile(near[away <= reach], LOW)
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # by centroid and length: cosine under which its language rejects
    idf: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows given; rows without lang or letters are not used."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    d = d.withColumn("h", F.xxhash64("doc_id", "text"))  # rows that share an id, or have none, still differ
    # of n different hashes about twice the sample lie under the bound, and hardly ever fewer than the sample
    part = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    bounds = d.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", (part * float(1 << 63) * 2 - float(1 << 63)).alias("bound"))
    # a row for each language, fewer than the centroids that the driver holds
    some = d.join(F.broadcast(bounds), "lang").where(F.col("h").cast("double") <= F.col("bound"))
    order = W.partitionBy("lang").orderBy("h")
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("lang", "text")
    small_batches(docs.sparkSession)

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch, "text", rows=256):
                rows = [x.astype(np.float32).tobytes() for x in counts(buf, off)]
                yield pa.RecordBatch.from_arrays([batch.column("lang")[lo:hi], pa.array(rows, pa.binary())], names=["lang", "v"])

    held = cut(chosen.mapInArrow(vectors, "lang string, v binary"))

    def stack(rows: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(x, np.float32) for x in sorted(rows["v"])])

    def frequency(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(rows)], "df": [(stack(rows) > 0).sum(0).astype(np.float64).tobytes()]})

    seen = held.groupBy("lang").applyInPandas(frequency, "n long, df binary").collect()  # a row for each language
    if not seen:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, LENGTHS), np.float32), np.ones(DIMENSIONS, np.float32))
    n, df = sum(r["n"] for r in seen), np.sum([np.frombuffer(r["df"], np.float64) for r in seen], axis=0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        counted = stack(rows)
        v = unit(counted, idf)
        c = centroids(v)
        low = floors(length_of(counted), (v @ c.T).max(1))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "c": [c.tobytes()], "low": [low.tobytes()]})

    parts = sorted(held.groupBy("lang").applyInPandas(learn, "lang string, c binary, low binary").collect())  # CENTROIDS vectors for each language
    c = [np.frombuffer(r["c"], np.float32).reshape(-1, DIMENSIONS) for r in parts]
    low = np.concatenate([np.frombuffer(r["low"], np.float32)[None].repeat(len(x), 0) for r, x in zip(parts, c)])
    return Model([r["lang"] for r, x in zip(parts, c) for _ in x], np.concatenate(c), low, idf)


NEW = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs`, then lang_pred, score, rejected; such a name that `docs` has already gets an underscore more."""
    small_batches(docs.sparkSession)
    letters_in, *new = fresh(docs, "_letters", *NEW)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()))]])
    names = np.array([*model.languages, UND], object)
    columns = schema.names

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(letters_in).to_numpy(zero_copy_only=False)
            best, score, floor = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.full(batch.num_rows, 2.0)
            if len(model.languages):
                for lo, hi, buf, off in text_chunks(batch, text, rows=512):
                    counted = counts(buf, off)
                    near = unit(counted, model.idf) @ model.centroids.T
                    best[lo:hi], score[lo:hi] = near.argmax(1), near.max(1)
                    floor[lo:hi] = model.floors[best[lo:hi], np.minimum(length_of(counted), LENGTHS - 1)]
            best[~letters.astype(bool)] = len(names) - 1
            und = best == len(names) - 1
            score = np.where(und, 0.0, np.clip(score, 0, 1))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(und | (score < floor))], names=columns)

    return docs.withColumn(letters_in, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def known_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, columns unchanged."""
    *_, rejected = fresh(docs, "_letters", *NEW)
    return identify(docs, model, text).where(~F.col(rejected)).select(*[f"`{c}`" for c in docs.columns])
