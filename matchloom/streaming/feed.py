"""The change feed on a stream: the batch rules, with state per (entity, field group).

Two ways with the same results.  ``run_batches`` puts each micro-batch through the
batch operators against a stored state: they deal a hot field out over its hours,
so a backlog of any size and skew is worked off in bounded memory.
``stream_changes`` keeps the state in the stateful operator, for low latency; it
holds a field's share of one micro-batch, so its source is to be read with
``admitted``, which bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from matchloom.session import checkpoint_dir

# ---------------------------------------------------------------- fixed values
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES_DDL = (
    "entity string, field_group string, observed_at string, ordinal bigint, change string, "
    "old_value string, value string, hash string"
)
# ------------------------------------------------------------ end fixed values
CHANGED = [c.split(" ")[0] for c in CHANGES_DDL.split(", ")]


class FieldProcessor(StatefulProcessor):
    """Stored (hash, time, value) of one field; emits one change per record.

    A micro-batch's records of a field are taken in (time, ingest) order.  A
    record that arrives after a newer one was applied is stale.  Since the stored
    time is the running maximum and the stored hash and value are the last ones
    seen and applied, all records of a batch are decided at once by shifts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("field", "hash string, at string, value string")

    def handleInitialState(self, key: Any, rows: pd.DataFrame, timerValues: Any) -> None:
        first = rows.iloc[0]
        self.state.update((first["base_hash"], first["base_at"], first["base_value"]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
                        ) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["observed_at", "ordinal"], ignore_index=True)
        digest, at, value = self.state.get() if self.state.exists() else (None, None, None)
        known = batch["value"].notna()
        before = batch["observed_at"].shift()
        if at is not None:
            # Text times compare as text; the first record meets the stored time.
            before = before.where(before > at, at).fillna(at)
            stale = batch["observed_at"] <= before
        else:
            # A field without state gets one from its first value; nothing before that is stale.
            born = known.cumsum().shift(fill_value=0) > 0
            stale = born & (batch["observed_at"] <= before.fillna(""))
        seen = known & ~stale
        last = batch["hash"].where(seen).ffill().shift()
        last = last if digest is None else last.fillna(digest)
        applied = seen & (batch["hash"] != last)
        old = batch["value"].where(applied).ffill().shift()
        old = old if value is None else old.fillna(value)
        change = pd.Series("applied", index=batch.index).mask(seen & ~applied, "noise")
        change = change.mask(~known, "suspected_deletion").mask(stale, "stale_skip")
        if at is not None or known.any():
            newest = batch["observed_at"].max()
            hashes, values = batch["hash"][seen], batch["value"][applied]
            self.state.update((hashes.iloc[-1] if len(hashes) else digest,
                               newest if at is None else max(at, newest),
                               values.iloc[-1] if len(values) else value))
        yield pd.DataFrame({
            "entity": key[0], "field_group": key[1], "observed_at": batch["observed_at"],
            "ordinal": batch["ordinal"], "change": change,
            "old_value": old.astype(object).where(old.notna(), None),
            "value": batch["value"], "hash": batch["hash"]})

    def close(self) -> None:
        pass


def stream_changes(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Changes of a streaming feed; fields are independent, so each is its own key.

    ``base`` is the state of a base load (entity, field_group, base_value,
    base_hash, base_at) that the stream starts from.
    """
    start = None if base is None else base.groupBy("entity", "field_group")
    return feed.groupBy("entity", "field_group").transformWithStateInPandas(
        FieldProcessor(), CHANGES_DDL, outputMode="append", timeMode="none", initialState=start)


def run_available(spark: SparkSession, changes: DataFrame, name: str) -> DataFrame:
    """Process what is there, writing changes to the shared folder, and read them back."""
    import uuid

    root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        query = (
            changes.writeStream.format("parquet").outputMode("append")
            .option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(CHANGES_DDL).parquet(f"{root}/changes")


def admitted(spark: SparkSession, path: str, schema: StructType, max_bytes: int = 1 << 29, **options: str) -> DataFrame:
    """A file stream of which each micro-batch takes files of about ``max_bytes``, oldest first."""
    return (spark.readStream.schema(schema).options(maxBytesPerTrigger=max_bytes, **options).parquet(path))


STATE_DDL = "entity string, field_group string, base_value string, base_hash string, base_at string, batch bigint"


def batch_sink(root: str, base: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: writes a micro-batch's changes, then the state after it.

    A micro-batch counts once its state is in the ledger.  One that is given again
    is left out if it counts; else its changes, which came from the same state,
    are written over.  Only the state of the batch's own fields is read and written.
    """
    from matchloom.operators import feed as fd
    from matchloom.sources.store import Store

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, f"{root}/state")
        done = {r["run_id"] for r in store._runs("fields")}
        if f"batch-{batch_id}" in done:
            return
        if base is not None and not done:
            store.upsert(base.select(*fd.KEY, "base_value", "base_hash", "base_at", F.lit(-1).cast("bigint").alias("batch")),
                         "fields", fd.KEY, ["batch"], "base", "base")
        state = store.read("fields")
        if state is None:
            state = spark.createDataFrame([], STATE_DDL)
        held = state.join(batch.select(*fd.KEY).distinct(), fd.KEY, "left_semi").drop("batch")
        path = f"{root}/changes/batch={batch_id}"
        fd.mark_changes(fd.mark_stale(batch, held)).select(*CHANGED).write.mode("overwrite").parquet(path)
        changes = spark.read.schema(CHANGES_DDL).parquet(path).withColumnsRenamed({"field_group": "field", "value": "new_value"})
        after = fd.next_state(changes, held).withColumn("batch", F.lit(batch_id).cast("bigint"))
        store.upsert(after, "fields", fd.KEY, ["batch"], f"batch-{batch_id}", f"batch-{batch_id}")

    return write


def run_batches(spark: SparkSession, feed: DataFrame, name: str, base: DataFrame | None = None,
                root: str | None = None) -> DataFrame:
    """Process what is there batch by batch, and read the changes of all batches back."""
    import uuid

    root = root or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (feed.writeStream.foreachBatch(batch_sink(root, base))
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(CHANGES_DDL).option("recursiveFileLookup", "true").parquet(f"{root}/changes")


def keyed_sink(root: str, key: list[str], order: list[str], table: str):
    """foreachBatch function that upserts each micro-batch into a versioned table.

    A repeated batch writes the same rows again, and the newest row per key wins,
    so the sink is idempotent.
    """
    from matchloom.sources.store import Store

    def write(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, root).upsert(
            batch, table, key, order, f"batch-{batch_id}", f"batch-{batch_id}")

    return write


def dedup_within(feed: DataFrame, event_id: str, event_time: str, delay: str) -> DataFrame:
    """Insert-or-ignore on a stream: one row per content id within the watermark."""
    return feed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([event_id])
