"""Incremental curation as a stream (an extension: the batch operators fed by Structured Streaming)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.state import fold_marks
from tessera.sources.state_store import StateStore

MARKS = "person string, asset_id string, score double, first_seq bigint, last_seq bigint"


def distinct_marks(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Marks of a stream without repeats that arrive within the delay; later repeats are folded by the state."""
    return stream.withWatermark("recorded_ts", delay).dropDuplicatesWithinWatermark(["person", "asset_id", "seq"])


def marks_per_hour(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Marks per person and hour of recording; rows later than the delay are dropped by the watermark."""
    w = F.window("recorded_ts", "1 hour")
    n = stream.withWatermark("recorded_ts", delay).groupBy(w, "person").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("hour"), "person", "n")


def merge_into(store: StateStore):
    """A ``foreachBatch`` function that folds each batch into the store; replaying a batch changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        def folded(old: DataFrame) -> DataFrame:
            log = old.select("person", "asset_id", F.col("last_seq").alias("seq"), "score")
            log = log.unionByName(old.select("person", "asset_id", F.col("first_seq").alias("seq"), F.lit(None).cast("double").alias("score")))
            log = log.unionByName(batch.select("person", "asset_id", "seq", "score"))
            return fold_marks(log, ["score"]).select("person", "asset_id", "score", "first_seq", "last_seq")

        store.update(MARKS, folded)

    return merge
