"""Sinks that survive restarts: every micro-batch owns one folder, so a replayed batch overwrites
what its first try wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.session import SETTINGS, work_path

BATCH = "batch"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STATE = {STATE_STORE: SETTINGS[STATE_STORE]}  # what a stream with state and timers of its own needs


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and as it was afterwards. A stream keeps those it is started with."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def batch_folder_writer(out: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable:
    """``foreachBatch`` function writing ``prepare(batch)`` to ``out/batch=<id>``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        prepare(rows).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return write


def start(
    stream: DataFrame,
    out: str,
    mode: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    trigger: dict | None = None,
    checkpoint: str | None = None,
    settings: dict[str, str] | None = None,
):
    """Start a stream into batch folders. The trigger defaults to working off what is available; `settings` hold for
    this stream only."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or f"{out}-progress")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(batch_folder_writer(out, prepare))
    )
    with session_settings(stream.sparkSession, settings or {}):
        return writer.start()


def run_available(stream: DataFrame, name: str, mode: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                  settings: dict[str, str] | None = None) -> str:
    """Process all available input once; returns the output folder."""
    out = work_path(stream.sparkSession, name)
    start(stream, out, mode, prepare, settings=settings).awaitTermination()
    return out


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All rows written so far with their batch number."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).parquet(out)


def latest_per_key(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state written per key by a stream in update mode."""
    values = [c for c in updates.columns if c not in (*keys, BATCH)]
    newest = F.max(F.struct(F.col(BATCH), *values)).alias("newest")
    return updates.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"newest.{v}").alias(v) for v in values])


class DeltaLog:
    """A log of micro-batches that is merged as it grows: reading it costs the same however many batches there were.

    A batch owns the folder ``batch=<id>``. Each ``every`` batches what has come so far is merged into
    ``merged/upto=<id>`` by `merge`, which must give the same rows for merged parts as for all rows at once (sums do). The
    highest merged folder that was written to its end is the high-water mark: it stands for all batches up to its id,
    a replay of which changes nothing. Folders below the mark before it are deleted, so readers of the last one finish."""

    DONE = "_SUCCESS"

    def __init__(self, spark: SparkSession, out: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], every: int = 8):
        self.spark, self.out, self.schema, self.merge, self.every = spark, out, schema, merge, every
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        self._files = self._path("merged").getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the folders of a kind that were written to their end."""
        where = self._path(folder)
        if not self._files.exists(where):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(where)]
        numbers = sorted(int(name.removeprefix(prefix)) for name in names if name.startswith(prefix))
        return [n for n in numbers if self._files.exists(self._path(f"{folder}/{prefix}{n}/{self.DONE}"))]

    def mark(self) -> int:
        """The last batch that is merged, -1 for none."""
        return max(self._whole("merged", "upto="), default=-1)

    def _parts(self) -> list[str]:
        mark = self.mark()
        later = [f"{self.out}/{BATCH}={n}" for n in self._whole(".", f"{BATCH}=") if n > mark]
        return ([f"{self.out}/merged/upto={mark}"] if mark >= 0 else []) + later

    def read(self) -> DataFrame:
        """What all batches add up to."""
        parts = self._parts()
        return self.merge(self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function."""
        if batch_id <= self.mark():
            return
        self.merge(rows).write.mode("overwrite").parquet(f"{self.out}/{BATCH}={batch_id}")
        if len(self._parts()) > self.every:
            before = self.mark()
            self.read().write.mode("overwrite").parquet(f"{self.out}/merged/upto={batch_id}")
            for n in self._whole(".", f"{BATCH}="):
                if n <= before:
                    self._files.delete(self._path(f"{BATCH}={n}"), True)
            for n in self._whole("merged", "upto="):
                if n < before:
                    self._files.delete(self._path(f"merged/upto={n}"), True)


def run_into(stream: DataFrame, log: DeltaLog) -> DeltaLog:
    """Process all available input once into a log."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{log.out}-progress")
    writer.trigger(availableNow=True).foreachBatch(log.write).start().awaitTermination()
    return log
