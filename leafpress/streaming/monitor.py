"""Streams: smoothed rates with state per key, and newly arrived files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafpress.operators.progress import ALPHA, LEAST_SECONDS


def rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """The streaming form of progress.ewma: events (keys as strings, seconds, counter), each key's in order over its batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, c, rate = state.get if state.exists else (None, None, None)
        for f in frames:
            out = []
            for x in f.sort_values(["seconds", "counter"]).itertuples():
                if c is None or x.counter > c:
                    if c is not None and x.seconds - s >= LEAST_SECONDS:
                        now = (x.counter - c) / (x.seconds - s)
                        rate = now if rate is None else ALPHA * now + (1 - ALPHA) * rate
                    s, c = float(x.seconds), float(x.counter)
                out.append((*key, float(x.seconds), float(x.counter), rate))
            yield pd.DataFrame(out, columns=[*keys, "seconds", "counter", "rate"])
        state.update((s, c, rate))

    schema = ", ".join(f"{k} string" for k in keys) + ", seconds double, counter double, rate double"
    return events.groupBy(*keys).applyInPandasWithState(run, schema, "s double, c double, rate double", "append", GroupStateTimeout.NoTimeout)


def new_files(spark: SparkSession, folder: str, newer_than: str | None = None, pattern: str = "*.md") -> DataFrame:
    """A stream of (path, modificationTime, content): each file once, and only those modified after a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    out = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return out if newer_than is None else out.filter(F.col("modificationTime") > F.lit(newer_than).cast("timestamp"))
