"""Series and summaries of runs that arrive as streams."""

from typing import Any, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STRETCH = 256  # rows of a series that are averaged with one product of matrices
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which :func:`streaming_average` needs."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def streaming_average(rows: DataFrame, key: str, order: str, values: Sequence[str], alpha: float) -> DataFrame:
    """Exponential averages ``(key, order, values, delta_<value> ...)`` of series whose rows arrive in any order.

    ``order`` counts the rows of a key from 0 without gaps. A row is sent once all rows before it have arrived; until
    then it waits in the state, which lives on the executors' disks and survives batches and restarts. Of a row that
    comes again only the first counts. Missing values count 0. The first row is its own average and has a change of 0.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    values = list(values)
    named = rows.where(F.col(key).isNotNull() & (F.col(order) >= 0)).select(
        F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]
    )
    shape = ", ".join([f"`{key}` string", f"`{order}` long", *(f"`{v}` double" for v in values), *(f"`delta_{v}` double" for v in values)])
    return named.groupBy(key).transformWithStateInPandas(_Average(key, order, values, alpha), shape, "Append", "None")


class _Average(StatefulProcessor):
    """State of a key: the next row's number with the averages before it, and the rows that came too early."""

    def __init__(self, key: str, order: str, values: Sequence[str], alpha: float):
        self.key, self.order, self.values, self.alpha = key, order, list(values), alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next long, averages array<double>")
        self.early = handle.getMapState("early", "at long", "x array<double>")
        steps = np.subtract.outer(np.arange(STRETCH), np.arange(STRETCH))
        self.weights = np.where(steps >= 0, (1 - self.alpha) ** np.maximum(steps, 0.0), 0.0)
        self.fading = (1 - self.alpha) ** np.arange(1.0, STRETCH + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.now.get() if self.now.exists() else None
        following, last = (held[0], np.array(held[1])) if held else (0, None)
        waiting = self.early.exists()
        for chunk in rows:
            chunk = chunk.drop_duplicates(self.order).sort_values(self.order)
            at, x = chunk[self.order].to_numpy(), chunk[self.values].to_numpy(dtype=float)
            at, x = at[at >= following], x[at >= following]
            while True:
                # the rows whose turn has come: a gap-free beginning of the chunk, then what waited for it
                n = int((at == following + np.arange(len(at))).sum())
                ready, at, x = x[:n], at[n:], x[n:]
                freed = []
                while waiting and len(freed) < STRETCH and self.early.containsKey((following + n + len(freed),)):
                    place = (following + n + len(freed),)
                    freed.append(self.early.getValue(place)[0])
                    self.early.removeKey(place)
                ready = np.concatenate((ready, np.array(freed).reshape(-1, len(self.values))))
                if not len(ready):
                    break
                averages, changes = self._follow(ready, last)
                out = {self.key: [key[0]] * len(ready), self.order: following + np.arange(len(ready))}
                out |= dict(zip(self.values, averages.T)) | {f"delta_{v}": c for v, c in zip(self.values, changes.T)}
                yield pd.DataFrame(out)
                following, last = following + len(ready), averages[-1]
                later = at >= following
                at, x = at[later], x[later]
            for place, row in zip(at.tolist(), x.tolist()):
                if not self.early.containsKey((place,)):
                    self.early.updateValue((place,), (row,))
                waiting = True
        if last is not None:
            self.now.update((following, last.tolist()))

    def _follow(self, x: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        averages, before = [], last
        for start in range(0, len(x), STRETCH):
            part = x[start : start + STRETCH]
            n, new = len(part), self.alpha * part
            if before is None:
                new[0] = part[0]
            found = self.weights[:n, :n] @ new
            if before is not None:
                found += np.outer(self.fading[:n], before)
            averages.append(found)
            before = found[-1]
        averages = np.concatenate(averages)
        start = averages[:1] if last is None else last[None, :]
        return averages, np.diff(np.concatenate((start, averages)), axis=0)

    def close(self) -> None:
        pass


def streaming_summaries(summaries: DataFrame) -> DataFrame:
    """The newest summary of every run and metric, from a stream of summary rows with ``run``, ``metric``, ``modified``.

    A run that is summarised again replaces its rows; of rows with the same time the largest counts. The state is one
    row per run and metric. Sent in update mode; :func:`pairtide.operators.reports.run_overview` shows the result.
    """
    others = [c for c in summaries.columns if c not in ("run", "metric", "modified")]
    newest = F.max(F.struct("modified", *others)).alias("newest")
    return summaries.groupBy("run", "metric").agg(newest).select("run", "metric", "newest.*")
