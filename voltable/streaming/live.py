"""Structured Streaming counterparts: quote ingestion, live snapshots, stale quotes, exits.

Stateful operators need the RocksDB state store (`use_rocksdb`). Checkpoints go to the folder the
cluster names in `spark.checkpoint.dir`; the driver never holds stream state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def checkpoint_folder(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{base}/{name}"


def stream_chain(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1, fmt="parquet") -> DataFrame:
    """Chain files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def stream_snapshots(chain: DataFrame, ts="quote_ts", lateness="1 day", window="1 day", band=(0.40, 0.60)) -> DataFrame:
    """IV around half delta, put-call spot proxies and chain size per symbol and day; late rows are dropped.

    In append mode a day comes out once a later row closes it, so the last days of a stream stay inside; `keep_latest` and
    `latest` write what changed in each batch instead and have every day, the open ones as far as they got.
    The batch job overwrites the day later with the exact at-the-money rule, which needs the spot first.
    """
    near = F.abs("delta").between(*band)
    return chain.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), "symbol").agg(
        F.avg(F.when(near & (F.col("vol") > 0), F.col("vol"))).alias("iv"), F.avg(F.when(near, F.col("strike"))).alias("spot"), F.count(F.lit(1)).alias("chain_size")
    ).select("symbol", F.to_date("w.start").alias("d"), "spot", "iv", "chain_size")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch by time; of equal times by `seq` if the stream has it."""
    batch = pd.concat(list(rows))
    return batch.sort_values(["quote_ts", "seq"] if "seq" in batch else ["quote_ts"], kind="stable")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, once=True) -> StreamingQuery:
    """Write the rows each micro-batch changed below `path`, a folder per batch; a batch that runs again replaces its own."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of every key that `keep_latest` wrote."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_last")).select("_last.*")


def _until(batch: pd.DataFrame) -> int | None:
    """Milliseconds of the day after the key's expiration, when its state may go."""
    if "expiration" not in batch or batch["expiration"].isna().all():
        return None
    return int((pd.Timestamp(pd.to_datetime(batch["expiration"]).max()) + pd.Timedelta(days=1)).value // 1_000_000)


class _Expiring(StatefulProcessor):
    """State that goes when the stream's time passes its key's expiration, or `ttl_ms` after its last update.

    The first row of a key that names an expiration sets an event-time timer for the day after it; when the watermark passes
    that, the state is cleared. One timer per key."""

    SCHEMA = ""

    def __init__(self, ttl_ms: int | None, event_time: bool):
        self.ttl_ms, self.event_time = ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.SCHEMA + ", until bigint", self.ttl_ms)

    def remember(self, batch: pd.DataFrame, *values) -> None:
        until = self.state.get()[-1] if self.state.exists() else None
        if until is None and self.event_time:
            until = _until(batch)
            if until is not None:
                self.handle.registerTimer(until)
        self.state.update((*values, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: _Expiring, output: str, lateness: str) -> DataFrame:
    if processor.event_time:
        rows = rows.withWatermark("quote_ts", lateness)
    mode = "EventTime" if processor.event_time else "None" if processor.ttl_ms is None else "ProcessingTime"
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "Append", mode)


class StaleRuns(_Expiring):
    """Per contract: last price and how often it repeated. A missing price ends the run, also at the edge of a batch."""

    SCHEMA, COLUMNS = "price double, run int", ["contract", "quote_ts", "price", "run_length"]

    def __init__(self, threshold: int, ttl_ms: int | None, event_time: bool):
        super().__init__(ttl_ms, event_time)
        self.threshold = threshold

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        price, run = self.state.get()[:2] if self.state.exists() else (float("nan"), 0)
        out = []
        for ts, p in zip(batch["quote_ts"], batch["price"].astype(float)):
            run = 0 if pd.isna(p) else run + 1 if p == price else 1
            price = p
            if run >= self.threshold:
                out.append((key[0], ts, float(p), run))
        self.remember(batch, float(price), int(run))
        yield pd.DataFrame(out, columns=self.COLUMNS)


def stream_stale_quotes(quotes: DataFrame, threshold=3, ttl_ms: int | None = None, lateness="1 day") -> DataFrame:
    """(contract, quote_ts, price) rows whose price repeats for `threshold` observations or more. A column `seq`
    orders rows of equal `quote_ts`.

    With a column `expiration` a contract's state goes once the stream is `lateness` past the day after it; rows later than
    that are dropped. Without one, state stays unless `ttl_ms` is given.
    """
    return _stateful(quotes, "contract", StaleRuns(threshold, ttl_ms, "expiration" in quotes.columns), "contract string, quote_ts timestamp, price double, run_length int", lateness)


class ExitWatch(_Expiring):
    """Per position: the peak P&L so far and whether it already closed."""

    SCHEMA, COLUMNS = "peak double, closed boolean", ["position_id", "quote_ts", "pnl", "peak_pnl", "exit_reason"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        peak, closed = self.state.get()[:2] if self.state.exists() else (0.0, False)
        out = []
        for row in batch.itertuples():
            if closed:
                break
            if pd.isna(row.pnl):
                continue
            peak = max(peak, row.pnl)
            reason = None
            if row.dte <= row.exit_dte:
                reason = "expiration"
            elif row.pnl_pct >= row.profit_target:
                reason = "profit_target"
            elif row.pnl_pct <= -row.loss_limit:
                reason = "stop_loss"
            elif peak > 0 and (peak - row.pnl) / peak >= row.trail:
                reason = "trailing_stop"
            if reason:
                closed = True
                out.append((key[0], row.quote_ts, float(row.pnl), float(peak), reason))
        self.remember(batch, float(peak), bool(closed))
        yield pd.DataFrame(out, columns=self.COLUMNS)


def stream_exit_monitor(marks: DataFrame, positions: DataFrame, ttl_ms: int | None = None, lateness="1 day") -> DataFrame:
    """One exit row per position. `marks` streams (position_id, quote_ts, pnl, dte, and `seq` to order equal times); `positions` is static
    with (position_id, net_premium, profit_target, loss_limit, exit_dte, trail). With a column `expiration` in either a position's state
    goes after it, as for `stream_stale_quotes`."""
    both = marks.join(positions, "position_id").withColumn("pnl_pct", F.col("pnl") / F.abs("net_premium"))
    return _stateful(both, "position_id", ExitWatch(ttl_ms, "expiration" in both.columns), "position_id string, quote_ts timestamp, pnl double, peak_pnl double, exit_reason string", lateness)


def on_step(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once=True) -> StreamingQuery:
    """`callback(batch, id)` per micro-batch."""
    writer = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
