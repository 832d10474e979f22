"""A live head as a stream: per-series state decides whether a sample is in order.

The state of a series is its last time, count and last value; any t below the last time is rejected, with no tolerance
and no watermark, since the rule is exact and per series. Within a micro-batch a series' rows are taken by arrival. The
query's checkpoint is the log: after a restart the state is as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.model import labels_str

OUT = "labels_str string, t long, v double, arrival long, accepted boolean"
STATE = "last_t long, num_samples long, last_v double"


#: Rows of a series that leave at once.
OUT_ROWS = 10_000


def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A series' rows of the micro-batch, by arrival. Of these three numbers a row are held; labels and results are not."""
    last_t, count, last_v = state.get if state.exists else (None, 0, None)
    held = [[f[c].to_numpy() for c in ("t", "v", "arrival")] for f in frames]
    t, v, arrival = (np.concatenate(c) for c in zip(*held))
    del held
    order = np.argsort(arrival, kind="stable")
    t, v, arrival = t[order], v[order], arrival[order]
    highest = np.fmax.accumulate(t if last_t is None else np.fmax(t, last_t))
    before = np.concatenate((highest[:1] if last_t is None else [last_t], highest[:-1]))
    ok = (t >= before) | np.isnan(before)
    if ok.any():
        last = np.flatnonzero(ok)[-1]
        last_t, count, last_v = int(t[last]), count + int(ok.sum()), float(v[last])
    if last_t is not None:
        state.update((last_t, count, last_v))
    for at in range(0, len(t), OUT_ROWS):
        own = slice(at, at + OUT_ROWS)
        yield pd.DataFrame({"labels_str": key[0], "t": t[own], "v": v[own], "arrival": arrival[own], "accepted": ok[own]})


def ingest(samples: DataFrame) -> DataFrame:
    """A stream of samples (labels, t, v, arrival) with ``accepted``; keyed by series, so state is spread by series."""
    keyed = samples.select(labels_str(F.col("labels")).alias("labels_str"), "t", "v", "arrival")
    return keyed.groupBy("labels_str").applyInPandasWithState(judge, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start(samples: DataFrame, accepted: str, rejected: str, checkpoint: str, **trigger):
    """Run the head: accepted samples to one Parquet folder, rejected ones to another. stop() ends it; what a batch has
    written is replaced if the batch runs again, since each has a folder of its own."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, wanted in ((accepted, True), (rejected, False)):
            batch.where(F.col("accepted") == wanted).drop("accepted").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return ingest(samples).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
