"""The lifecycle of listings as streams of sightings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from estimark.operators import lifecycle
from estimark.sources.stored import StoredTable


def timed(stream: DataFrame, at: str) -> DataFrame:
    """``stream`` with ``at`` as a timestamp: watermarks take no other type, and times without
    a zone are read in the session's zone."""
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def distinct_sightings(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """One row for each key, the first that arrives, among those within ``delay``."""
    return timed(stream, at).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """First and last seen date of each key, in update mode."""
    return lifecycle.seen(stream, key, at)


def hourly(stream: DataFrame, at: str, group: str, least: int = 1, delay: str = "1 hour") -> DataFrame:
    """Counts by hour and group, those of ``least`` and more."""
    return timed(stream, at).withWatermark(at, delay).groupBy(F.window(at, "1 hour"), group).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("window.start").alias("hour"), group, "n")


def guarded_upsert(table: StoredTable, stream: str = "listings", smallest_share: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that upserts a batch into a stored table, once: a batch that
    comes again after a failure is skipped. A full scan (a row's ``full_scan``) that shrank below the
    share of what is stored is left out."""

    def put(batch: DataFrame, number: int) -> None:
        if "full_scan" in batch.columns and table.manifest() is not None and batch.where("full_scan").limit(1).count():
            if batch.count() < smallest_share * table.read().count():
                return
        table.upsert(batch.drop("full_scan"), (stream, number))

    return put


def watch_files(spark: SparkSession, path: str, schema: str, put: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 seconds"):
    """Starts a query that hands each batch of new JSON files below ``path`` to ``put``; without
    ``every``, it stops when all that is there now has been handed over."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def due_digests(stream: DataFrame, users: DataFrame, at: str, group: str, delay: str = "1 hour") -> DataFrame:
    """(hour, user, n): active users at whose hour a group (their city) has as many new listings
    as they ask for. users: id, city, active, send_hour, min_new."""
    counts = hourly(stream, at, group, 1, delay).withColumnRenamed(group, "__group")
    hit = counts.join(users.where("active"), (F.col("__group") == F.col("city")) & (F.hour("hour") == F.col("send_hour")))
    return hit.where(F.col("n") >= F.coalesce("min_new", F.lit(1))).select("hour", F.col("id").alias("user"), "n")


#: States with variables, timers and expiry need this store; a query's checkpoint keeps the one it began with.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def with_states(stream: DataFrame) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream


def one_timer(handle: StatefulProcessorHandle, at: int, timers: TimerValues) -> None:
    """The key's only timer from now on, at that time or as soon as the watermark moves."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(max(at, timers.getCurrentWatermarkInMs() + 1))


class PriceFollower(StatefulProcessor):
    """The last price of a listing is its state; a timer forgets it."""

    def __init__(self, key: str, forget_after_ms: int | None):
        self.key, self.forget_after = key, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "price double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before, latest = (self.last.get()[0] if self.last.exists() else None), None
        # of a batch, two numbers a sighting are held to put them in order
        for ms, price in sorted((r["ms"], r["price"]) for r in rows if r["ms"] is not None and r["price"] is not None):
            if before is not None and price < before:
                yield Row(**{self.key: key[0], "ms": ms, "previous_price": before, "price": price})
            before, latest = price, ms
        if latest is not None:
            self.last.update((before,))
            if self.forget_after:
                one_timer(self.handle, latest + self.forget_after, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


def price_changes(stream: DataFrame, key: str, at: str, price: str, forget_after_days: int | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, at, previous_price, price) whenever a listing is seen cheaper than before. The state
    is one price a listing; it goes once the watermark is ``forget_after_days`` days past the last
    sighting, if that is given. Within a batch sightings count in the order of their times."""
    kind = with_states(stream).select(key).schema[key].dataType.simpleString()
    rows = timed(stream, at)
    rows = (rows.withWatermark(at, delay) if forget_after_days else rows).select(key, at, F.unix_millis(at).alias("ms"), F.col(price).cast("double").alias("price"))
    follow = PriceFollower(key, forget_after_days * DAY_MS if forget_after_days else None)
    found = rows.groupBy(key).transformWithState(follow, f"`{key}` {kind}, ms bigint, previous_price double, price double", "append", "EventTime" if forget_after_days else "None")
    return found.select(key, F.timestamp_millis("ms").alias(at), "previous_price", F.col("price").alias(price))


class Expiry(StatefulProcessor):
    """First and last sighting of a listing and whether it is stale; one timer tells when it goes
    stale, then when it is dropped."""

    def __init__(self, key: str, stale_after: int, drop_after: int):
        self.key, self.stale_after, self.drop_after = key, stale_after * DAY_MS, drop_after * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "first bigint, last bigint, stale boolean")

    def row(self, key: tuple, first: int, last: int, status: str) -> Row:
        return Row(**{self.key: key[0], "first": first, "last": last, "status": status})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first, last = (self.seen.get()[0], self.seen.get()[1]) if self.seen.exists() else (None, None)
        for r in rows:
            if r["ms"] is not None:
                first, last = r["ms"] if first is None else min(first, r["ms"]), r["ms"] if last is None else max(last, r["ms"])
        if last is None:
            return
        self.seen.update((first, last, False))
        one_timer(self.handle, last + self.stale_after, timerValues)
        yield self.row(key, first, last, "seen")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.seen.exists():
            return
        first, last, stale = self.seen.get()
        if stale:
            self.seen.clear()
        else:
            self.seen.update((first, last, True))
            self.handle.registerTimer(max(last + self.drop_after, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, first, last, "dropped" if stale else "stale")


def expiry(stream: DataFrame, key: str, at: str, stale_after: int = 7, drop_after: int = 30, delay: str = "1 hour") -> DataFrame:
    """(key, first_seen, last_seen, status) as listings are seen, go stale (``stale_after`` days
    without a sighting) and are dropped (``drop_after`` days). Who returns before that keeps the
    first sighting; who returns later begins anew. Times are carried as milliseconds, so the
    session's zone doesn't matter."""
    kind = with_states(stream).select(key).schema[key].dataType.simpleString()
    rows = timed(stream, at).withWatermark(at, delay).select(key, at, F.unix_millis(at).alias("ms"))
    found = rows.groupBy(key).transformWithState(Expiry(key, stale_after, drop_after), f"`{key}` {kind}, first bigint, last bigint, status string", "append", "EventTime")
    return found.select(key, F.timestamp_millis("first").alias("first_seen"), F.timestamp_millis("last").alias("last_seen"), "status")


def run_now(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs a streaming frame over all that is there, into a table in memory."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
