"""Streaming forms: frames that arrive, closed-loop decoding with state, and incremental journals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_windows(events: DataFrame, time: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """Count and sum per key and tumbling window; rows later than the watermark are left out.

    A stream's watermark needs a timestamp with time zone, so a plain one is cast.
    """
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = stamped.groupBy(F.window("_t", length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def decode_stream(residuals: DataFrame, key: str, frame: str, q: str, step: float) -> DataFrame:
    """Running decoded value per key from quantised residuals; the state is the last decoded value.

    Frames of a key have to arrive in order; inside a micro-batch they are sorted.
    """
    kind = residuals.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(frame)
        out = []
        for f, n in zip(rows[frame], rows[q]):
            value += float(n) * step
            out.append((keys[0], int(f), value))
        state.update((value,))
        yield pd.DataFrame(out, columns=[key, frame, "decoded"])

    return residuals.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{frame}` bigint, decoded double", "value double", "append", GroupStateTimeout.NoTimeout)


def journaled(spark: SparkSession, journal: str, work: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that does only tasks (key, fingerprint) that the journal lacks, then enters them."""

    def run(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        tasks = batch.dropDuplicates(["key", "fingerprint"])
        try:
            done = own.read.parquet(journal)
        except Exception as error:  # the journal does not exist before its first entry
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done = None
        if done is not None:
            tasks = tasks.join(done, ["key", "fingerprint"], "left_anti")
        tasks = tasks.persist()
        try:
            work(tasks)
            tasks.select("key", "fingerprint").write.mode("append").parquet(journal)
        finally:
            tasks.unpersist()

    return run
