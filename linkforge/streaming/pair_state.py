"""The state of each pair under review, kept by a stream: its last decision, its reviews by decision, and whether reviewers disagree.

The log may come late, out of order and repeatedly. A review counts once by its review_id, and the last one is that of the greatest
(reviewed_at, review_id), whenever it arrives, so the state after the last batch is what `pair_reviews` gives over the whole log.
Reviews without review_id, reviewed_at or decision are left out: they can be neither told from a repeat nor put in order.
A pair without one of its record ids is a pair like others.

State is kept for each key in RocksDB and is read entry by entry, so a pair with very many reviews never stands in memory as a whole.
The results go to committed versions; a batch that is replayed after a crash finds its run there and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import REVIEW
from ..sources.versions import Versions

PAIR = ["pm_record_id", "am_record_id"]
DECIDED = ("potential", "rejected", "inconclusive")
LAST = "reviewed_at string, review_id string, decision string, forensic_status string"
COUNTS = ", ".join(f"{d} long" for d in DECIDED)
STATE = f"pm_record_id string, am_record_id string, {LAST}, reviews long, {COUNTS}, disagreement boolean"
#: The store that keeps several states for a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Appended batches after which the sink writes its newest rows as one folder.
COMPACT = 16


def counted(log: DataFrame) -> DataFrame:
    """The reviews that count; batch or stream."""
    return log.where(F.col("review_id").isNotNull() & F.col("reviewed_at").isNotNull() & F.col("decision").isin(*DECIDED))


def pair_reviews(log: DataFrame) -> DataFrame:
    """The batch answer: one row for each pair."""
    once = counted(log).groupBy(*PAIR, "review_id").agg(F.min(F.struct("reviewed_at", "decision", "forensic_status")).alias("r"))
    last = F.max_by(F.struct("r.reviewed_at", "review_id", "r.decision", "r.forensic_status"), F.struct("r.reviewed_at", "review_id"))
    by = once.groupBy(*PAIR).agg(last.alias("last"), F.count(F.lit(1)).alias("reviews"), *[F.count_if(F.col("r.decision") == d).alias(d) for d in DECIDED])
    several = sum((F.col(d) > 0).cast("int") for d in DECIDED) > 1
    return by.select(*PAIR, "last.*", "reviews", *DECIDED, several.alias("disagreement"))


class PairReviews(StatefulProcessor):
    """Of each pair: the ids of its reviews, the last of them, and their number by decision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "review_id string", "counted boolean")
        self.last = handle.getValueState("last", f"{LAST}, {COUNTS}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.last.get()
        last, counts = (None, dict.fromkeys(DECIDED, 0)) if have is None else (tuple(have[:4]), dict(zip(DECIDED, have[4:])))
        changed = False
        for part in rows:
            part = part.sort_values(["review_id", "reviewed_at", "decision"]).drop_duplicates("review_id")
            for one in part[["reviewed_at", "review_id", "decision", "forensic_status"]].itertuples(index=False, name=None):
                if self.seen.containsKey((one[1],)):
                    continue
                self.seen.updateValue((one[1],), (True,))
                counts[one[2]] += 1
                last = one if last is None or one[:2] > last[:2] else last
                changed = True
        if changed:
            self.last.update((*last, *counts.values()))
            row = (*key, *last, sum(counts.values()), *counts.values(), sum(n > 0 for n in counts.values()) > 1)
            yield pd.DataFrame([row], columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def states(log: DataFrame) -> DataFrame:
    """A row for each pair with new reviews in a batch, as they stand after it."""
    return counted(log).groupBy(*PAIR).transformWithStateInPandas(PairReviews(), STATE, "Update", "None")


def into_versions(root: str, name: str = "pair_reviews") -> Callable[[DataFrame, int], None]:
    """A batch sink under `root`; `newest` reads it. A batch that is in already adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        kept = Versions(batch.sparkSession, root)
        if kept.append(batch, f"{name}/{number}") is None:
            batch.write.format("noop").mode("append").save()  # its rows are in, but its state has to be made again
        if len(kept.manifest()["folders"]) >= COMPACT:
            kept.rewrite(kept.newest(STATE, PAIR), f"{name}/{number} in one")

    return write


def newest(spark: SparkSession, root: str) -> DataFrame:
    return Versions(spark, root).newest(STATE, PAIR)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str | None]):
    """A stream keeps the settings that it starts with; the session gets its own back."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            if v is not None:
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def start(spark: SparkSession, log: str, root: str, checkpoint: str, files: int | None = None, partitions: int | None = None, once: bool = True) -> StreamingQuery:
    """Follow the Parquet log at `log` into versions under `root`; with `once` until all that is there now is in.

    `files` bounds a batch; `partitions` is the number of state partitions, which a checkpoint keeps for good.
    """
    source = spark.readStream.schema(REVIEW)
    source = source if files is None else source.option("maxFilesPerTrigger", files)
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": partitions and str(partitions)}):
        out = states(source.parquet(log)).writeStream.outputMode("update").foreachBatch(into_versions(root)).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out).start()
