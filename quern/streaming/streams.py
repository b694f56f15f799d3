"""Structured Streaming counterparts: tails of logs, idempotent appends, windows, running aggregates, open spans."""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import shared_dir


def tail(spark: SparkSession, path: str, schema, ts: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a path; the checkpoint of the query is the cursor. ts becomes a timestamp fit for watermarks."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder, and read that back."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/quern/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def follow(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what is new since the last call with this checkpoint to a table, and read the table: the checkpoint holds the cursor
    and the state of the keys, so a stream that was stopped or lost goes on where it was, and no file is taken twice."""
    stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def once(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Redelivered rows that come within the delay are dropped; state is bounded by it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, keys: list[str], size: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window that the watermark has closed; sliding windows with slide."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running(stream: DataFrame, keys: list[str], **aggregates) -> DataFrame:
    """Aggregates over everything seen so far (complete mode)."""
    return stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


SPAN = "key string, started timestamp, ended timestamp, state string"


def spans(stream: DataFrame, key: str, ts: str, kind: str, opens: str, closes: str, orphan_after_ms: int = 3_600_000, delay: str = "1 hour") -> DataFrame:
    """Spans of a key: each closing event closes the first span that is open; one that stays open past the timeout comes out as
    an orphan. Open spans are the state of their key, until the timeout."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [(group[0], pd.Timestamp(t, unit="us", tz="UTC"), pd.NaT, "orphan") for t in held]
            state.remove()
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values("at", kind="stable")
            for what, at in zip(rows["what"], rows["at"]):
                if what == opens:
                    held.append(int(at))
                elif held:
                    out.append((group[0], pd.Timestamp(held.pop(0), unit="us", tz="UTC"), pd.Timestamp(int(at), unit="us", tz="UTC"), "closed"))
            if held:
                state.update((held,))
                state.setTimeoutTimestamp(max(max(held) // 1000 + orphan_after_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        found = pd.DataFrame(out, columns=["key", "started", "ended", "state"])
        yield found.assign(started=pd.to_datetime(found["started"], utc=True), ended=pd.to_datetime(found["ended"], utc=True), key=found["key"].astype(object), state=found["state"].astype(object))

    slim = stream.withWatermark(ts, delay).where(F.col(kind).isin(opens, closes)).select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(kind).alias("what"))
    return slim.groupBy("key").applyInPandasWithState(step, SPAN, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


MOVED = "key string, at timestamp, event string, before string, after string"


def transitions(stream: DataFrame, key: str, ts: str, event: str, table: dict[tuple[str, str], str], start: str, order: str | None = None, idle_ms: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Moves of a state machine kept for each key: table tells the state that an event leads to from a state ("*" for any); an
    event without an entry leaves it. Only moves come out. A key that had no event for idle_ms is forgotten and starts anew
    (retention), else its state, one word, is kept. order: a column that tells events of the same time apart."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            now = state.get[0] if state.exists else start
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "tie"], kind="stable")
            for what, at in zip(rows["what"], rows["at"]):
                after = table.get((now, what), table.get(("*", what), now))
                if after != now:
                    out.append((group[0], pd.Timestamp(int(at), unit="us", tz="UTC"), what, now, after))
                    now = after
            state.update((now,))
            if idle_ms is not None:
                state.setTimeoutTimestamp(max(int(rows["at"].max()) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        moved = pd.DataFrame(out, columns=["key", "at", "event", "before", "after"])
        yield moved.assign(at=pd.to_datetime(moved["at"], utc=True), **{c: moved[c].astype(object) for c in ("key", "event", "before", "after")})

    tie = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    known = sorted({what for _, what in table})
    slim = stream.withWatermark(ts, delay).where(F.col(event).isin(*known)).select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(event).alias("what"), tie.alias("tie"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return slim.groupBy("key").applyInPandasWithState(step, MOVED, "now string", "append", timeout)
