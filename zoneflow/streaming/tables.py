"""Tables kept current by a stream.

A keyed table is dealt into buckets by a hash of its key. A batch reads and writes the buckets its keys
are in, so its work follows the batch, not the table. One small file names the folder of each bucket;
it appears in a single step, so a reader sees all of a batch or nothing of it, and a batch that is
repeated after a failure finds whether it was done.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from zoneflow.operators.dashboard import summary
from zoneflow.operators.tables import cameras_with_metrics
from zoneflow.params import DEFAULTS, Params
from zoneflow.session import materialize, release
from zoneflow.sources.sinks import _path, _system

BUCKETS = 64
STATE = "_state-"  # files that name the folders of the buckets after a batch
KEPT = 3  # states whose folders stay for readers and repeated batches
PLACE = "zoneflow_bucket"


class Change(NamedTuple):
    """What a batch did: the rows of its keys before and after it; None where there were none."""

    before: DataFrame | None
    after: DataFrame


class KeyedTable:
    """The first ``keep`` rows of each key in the order ``best``, at ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], best: Sequence[Column] = (),
                 keep: int = 1, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.best, self.keep = spark, path, list(keys), list(best), keep
        self.buckets = buckets

    # -- states --

    def _states(self) -> list[int]:
        fs, folder = _system(self.spark, self.path), _path(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removeprefix(STATE)) for n in names if n.startswith(STATE))

    def _folders(self, state: int | None) -> dict[str, str]:
        """Bucket to folder."""
        if state is None:
            return {}
        stream = _system(self.spark, self.path).open(_path(self.spark, self.path, f"{STATE}{state}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, batch_id: int, folders: dict[str, str]) -> None:
        fs = _system(self.spark, self.path)
        draft = _path(self.spark, self.path, f"_draft-{batch_id}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        fs.rename(draft, _path(self.spark, self.path, f"{STATE}{batch_id}"))
        states = self._states()
        kept = states[-KEPT:]
        used = {f for s in kept for f in self._folders(s).values()}
        for old in states[:-KEPT]:
            for folder in set(self._folders(old).values()) - used:
                fs.delete(_path(self.spark, self.path, folder), True)
                batch = folder.partition("/")[0]
                if not any(f.startswith(f"{batch}/") for f in used):
                    fs.delete(_path(self.spark, self.path, batch), True)
            fs.delete(_path(self.spark, self.path, f"{STATE}{old}"), False)

    # -- rows --

    def _bucket(self) -> Column:
        hashed = F.xxhash64(*self.keys) if self.keys else F.lit(0).cast("long")
        return F.pmod(hashed, F.lit(self.buckets)).cast("string")

    def _read(self, folders: dict[str, str], buckets: Sequence[str]) -> DataFrame | None:
        paths = [f"{self.path}/{folders[b]}" for b in buckets if b in folders]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The table after the last complete batch; None before the first."""
        states = self._states()
        folders = self._folders(states[-1] if states else None)
        return self._read(folders, sorted(folders))

    def _first(self, rows: DataFrame) -> DataFrame:
        if not self.best:
            return rows
        order = (W.partitionBy(*self.keys) if self.keys else W.partitionBy(F.lit(0))).orderBy(*self.best)
        packed = rows.select(F.struct(*rows.columns).alias("row"), F.row_number().over(order).alias("place"))
        return packed.filter(F.col("place") <= self.keep).select("row.*")

    def apply(self, batch: DataFrame, batch_id: int, merge: Callable | None = None) -> Change:
        """Bring the rows of a batch in; the same change again if this batch has been done.

        ``merge`` makes the new rows from the old ones of the touched buckets (or None) and the batch;
        without it the first rows of each key are kept.
        """
        states = self._states()
        keys = batch.select(*self.keys).distinct() if self.keys else None
        last = max((s for s in states if s < batch_id), default=None)
        before = self._folders(last)
        if batch_id in states:
            after = self._folders(batch_id)
            touched = sorted(b for b, f in after.items() if f.startswith(f"batch-{batch_id}/"))
        else:
            touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())
            old = self._read(before, touched)
            if merge is not None:
                rows = merge(old, batch)
            else:
                rows = self._first(batch if old is None else old.unionByName(batch, allowMissingColumns=True))
            folder = f"batch-{batch_id}"
            rows.withColumn(PLACE, self._bucket()).repartition(PLACE).write.mode("overwrite").partitionBy(
                PLACE).parquet(f"{self.path}/{folder}")
            after = before | {b: f"{folder}/{PLACE}={b}" for b in touched}
            self._commit(batch_id, after)
        return Change(self._of(self._read(before, touched), keys), self._of(self._read(after, touched), keys))

    def _of(self, rows: DataFrame | None, keys: DataFrame | None) -> DataFrame | None:
        return rows if rows is None or keys is None else rows.join(keys, self.keys, "left_semi")


AfterBatch = Callable[[Change, int], None]


def keyed_table(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], best: Sequence[Column],
    keep: int = 1, buckets: int = BUCKETS, then: AfterBatch | None = None,
) -> DataStreamWriter:
    """Keep the first ``keep`` rows of each key, in the order ``best``, at ``path`` (see ``KeyedTable``)."""
    def update(batch: DataFrame, batch_id: int) -> None:
        # Several actions read the batch; without this each would run the query below again.
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                table = KeyedTable(batch.sparkSession, path, keys, best, keep, buckets)
                change = table.apply(batch, batch_id)
                if then is not None:
                    then(change, batch_id)
        finally:
            batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a keyed table; None before its first batch."""
    return KeyedTable(spark, path, ()).read()


def latest_table(
    results: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("camera_id",),
    order: Sequence[str] = ("frame_id",), buckets: int = BUCKETS, then: AfterBatch | None = None,
) -> DataStreamWriter:
    """Keep the newest row per key at ``path`` (one row per camera; repeating a batch is safe)."""
    return keyed_table(results, path, checkpoint, keys, [F.desc(c) for c in order], buckets=buckets, then=then)


# ---- alerts ------------------------------------------------------------------------------


NEWEST = (F.desc, "created_ms"), (F.asc, "alert_id")


def _newest() -> list[Column]:
    return [order(column) for order, column in NEWEST]


def alert_log_table(
    alerts: DataFrame, path: str, checkpoint: str, params: Params = DEFAULTS
) -> DataStreamWriter:
    """``append_alerts`` on a stream: the newest alerts of all tenants, as many as the log keeps.

    A batch is cut to that number in each task before it meets the log, which has that many rows.
    """
    return keyed_table(alerts, path, checkpoint, (), _newest(), keep=params.alerts_kept, buckets=1)


def tenant_alerts_table(
    alerts: DataFrame, path: str, checkpoint: str, params: Params = DEFAULTS, buckets: int = BUCKETS
) -> DataStreamWriter:
    """``alerts_for_tenant`` on a stream: the newest alerts of each tenant, without their numbers."""
    return keyed_table(alerts, path, checkpoint, ("user_id",), _newest(), params.alerts_per_user, buckets)


# ---- dashboard ---------------------------------------------------------------------------


SUMS = ("total_zones", "active_zones", "total_count", "high_risk_zones")


def dashboard_stream(
    results: DataFrame, cameras: DataFrame, latest_path: str, summary_path: str, checkpoint: str,
    buckets: int = BUCKETS,
) -> DataStreamWriter:
    """Keep current results and the summary of each tenant (``read_keyed`` of ``summary_path``).

    ``cameras`` is a static table without metrics. The first batch sums all of it up; after that, for
    each camera a batch touches, its old row is taken out of its tenant's sums and its new one put in.
    """
    def sums(some: DataFrame, rows: DataFrame) -> DataFrame:
        """What ``some`` cameras with these results add to the sums of their tenants."""
        metrics = rows.drop(*[c for c in cameras.columns if c != "camera_id"])
        return summary(cameras_with_metrics(some, metrics)).select("user_id", *SUMS)

    def of(rows: DataFrame) -> DataFrame:
        return cameras.join(rows.select("camera_id"), "camera_id", "left_semi")

    def negative(rows: DataFrame) -> DataFrame:
        return rows.select("user_id", *[(-F.col(c)).alias(c) for c in SUMS])

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])

    def retract(change: Change, batch_id: int) -> None:
        spark = change.after.sparkSession
        table = KeyedTable(spark, summary_path, ("user_id",), buckets=buckets)
        first = table._states() in ([], [batch_id])
        known, after = change.before, change.after
        none = after.limit(0)
        fresh = after if known is None else after.join(known.select("camera_id"), "camera_id", "left_anti")
        delta = sums(of(after), after).unionByName(negative(sums(of(fresh), none)))
        if known is not None:
            delta = delta.unionByName(negative(sums(of(known), known)))
        if first:
            delta = delta.unionByName(sums(cameras, none))
        delta = materialize(added(delta))
        table.apply(delta, batch_id, lambda old, new: added(new if old is None else old.unionByName(new)))
        release(delta)

    return latest_table(results, latest_path, checkpoint, buckets=buckets, then=retract)
