"""The stream of pair states against the batch answer: late, repeated and replayed reviews."""

import random

from linkforge.schema import REVIEW
from linkforge.sources.versions import Versions
from linkforge.streaming import pair_state


def reviews(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pair = ("PM0", "AM0") if i % 3 == 0 else (f"PM{rng.randrange(6)}", rng.choice(["AM1", "AM2", None]))
        at = f"2024-01-{rng.randrange(1, 29):02d}T00:00:0{rng.randrange(3)}Z"
        rows.append((f"r{i}", *pair, rng.choice(pair_state.DECIDED), rng.choice(["", "excluded"]), None, at, "m", "f"))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select(*[c.split()[0] for c in pair_state.STATE.split(", ")]).collect()), key=str)


def deliver(spark, rows, path):
    spark.createDataFrame(rows, REVIEW).coalesce(1).write.mode("append").parquet(path)


def follow(spark, tmp_path, checkpoint="c", **more):
    query = pair_state.start(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", partitions=3, **more)
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    """Three deliveries out of order, with repeats within and across batches, and reviews that don't count."""
    monkeypatch.setattr(pair_state, "COMPACT", 2)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    rows = reviews(120, 1)
    rows.sort(key=lambda r: r[6], reverse=True)
    bad = [(None, "PM0", "AM0", "rejected", "", None, "2025-01-01T00:00:00Z", "m", "f"), ("x", "PM0", "AM0", "rejected", "", None, None, "m", "f"), ("y", "PM9", "AM9", "maybe", "", None, "2025-01-01T00:00:00Z", "m", "f")]
    deliver(spark, rows[:50] + rows[:5] + bad, f"{tmp_path}/log")
    follow(spark, tmp_path)
    first = rows_of(pair_state.newest(spark, f"{tmp_path}/out"))
    assert first == rows_of(pair_state.pair_reviews(spark.createDataFrame(rows[:50], REVIEW)))
    deliver(spark, rows[40:90], f"{tmp_path}/log")
    deliver(spark, rows[:20] + rows[90:], f"{tmp_path}/log")
    follow(spark, tmp_path, files=1)
    log = spark.read.schema(REVIEW).parquet(f"{tmp_path}/log")
    got = rows_of(pair_state.newest(spark, f"{tmp_path}/out"))
    assert got == rows_of(pair_state.pair_reviews(log)) == rows_of(pair_state.pair_reviews(spark.createDataFrame(rows, REVIEW)))
    hot = next(r for r in got if r[:2] == ("PM0", "AM0"))
    assert hot[6] == sum(r[1:3] == ("PM0", "AM0") for r in rows) and hot[-1] is True
    assert len(Versions(spark, f"{tmp_path}/out").manifest()["folders"]) == 1  # written as one
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_repeats_alone_change_nothing(spark, tmp_path):
    rows = reviews(20, 2)
    deliver(spark, rows, f"{tmp_path}/log")
    follow(spark, tmp_path)
    had = rows_of(pair_state.newest(spark, f"{tmp_path}/out"))
    deliver(spark, rows, f"{tmp_path}/log")
    follow(spark, tmp_path)
    assert rows_of(pair_state.newest(spark, f"{tmp_path}/out")) == had
    again = Versions(spark, f"{tmp_path}/out").read(pair_state.STATE)
    assert again.where("commit > 0").count() == 0  # no pair had news


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A crash after the sink's commit and before the stream's: the same batch comes again."""
    write = pair_state.into_versions(f"{tmp_path}/out")
    batch = pair_state.pair_reviews(spark.createDataFrame(reviews(30, 3), REVIEW))
    write(batch, 0)
    version = Versions(spark, f"{tmp_path}/out").manifest()
    write(batch, 0)
    assert Versions(spark, f"{tmp_path}/out").manifest() == version
    deliver(spark, reviews(30, 3), f"{tmp_path}/log")
    follow(spark, tmp_path)  # its batch 0 is in already
    assert Versions(spark, f"{tmp_path}/out").manifest() == version
    assert rows_of(pair_state.newest(spark, f"{tmp_path}/out")) == rows_of(batch)


def test_empty_log(spark, tmp_path):
    deliver(spark, [], f"{tmp_path}/log")
    follow(spark, tmp_path)
    assert pair_state.newest(spark, f"{tmp_path}/out").count() == 0
    assert pair_state.pair_reviews(spark.createDataFrame([], REVIEW)).count() == 0
