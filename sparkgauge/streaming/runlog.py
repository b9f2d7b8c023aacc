"""The run log as a stream: availability so far, and the circuit breaker as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "kind string, arm string, doc string, docClass string, repeat int, availability string, seq long"


def read_log(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """Prediction records as they are appended, a file at a time."""
    return spark.readStream.schema(schema).json(folder).filter("coalesce(kind, 'prediction') = 'prediction'")


def availability(records: DataFrame) -> DataFrame:
    """Attempted, completed and failed so far by arm; for update or complete mode. Its state is a row an arm."""
    n = lambda s: F.count(F.when(F.col("availability") == s, 1))
    return records.groupBy("arm").agg(
        F.count(F.lit(1)).alias("attempted"), n("completed").alias("completed"), n("transport_failure").alias("transport_failures"), n("contract_failure").alias("contract_failures")
    )


def breaker(records: DataFrame, limit: int) -> DataFrame:
    """``arm, seq, streak``: a row whenever an arm reaches ``limit`` contract failures in a row.

    State is one number an arm; records of a micro-batch are taken in order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, what in zip(rows["seq"], rows["availability"], strict=True):
            streak = streak + 1 if what == "contract_failure" else 0
            if streak == limit:
                out.append((key[0], int(seq), streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["arm", "seq", "streak"])

    return records.groupBy("arm").applyInPandasWithState(step, "arm string, seq long, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def windowed_rates(records: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Completed share by arm and event-time window; rows later than ``late`` are left to the watermark."""
    return (
        records.withWatermark(time, late)
        .groupBy(F.window(time, width), "arm")
        .agg(F.count(F.lit(1)).alias("attempted"), F.avg((F.col("availability") == "completed").cast("double")).alias("availability"))
    )
