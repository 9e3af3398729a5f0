"""Streams whose keys are folded in the order of event time: rows wait in the state until the watermark has passed them, and idle keys go."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.shared import cut, new_path
from folio.sources.tables import read_corpus

#: A step takes what a key has kept, a row (micros, event_id, values...) and gives what it keeps and the rows it gives out; an end takes what is kept.
Step = Callable[[dict, list], list[tuple]]


def fold_in_order(stream: DataFrame, values: list[str], step: Step, out: str, late: str = "10 minutes", idle: str = "1 hour", end: Callable[[dict], list[tuple]] = lambda kept: []) -> DataFrame:
    """user_id and `out` of a stream with user_id, ts, event_id and `values`, folded by user in the order of (ts, event_id).

    Rows wait until the watermark, `late` behind the latest ts, has passed them, so that the result is that of the
    batch form whatever the order in which rows come, and rows later than that are dropped. A
    timer takes what waits when its time passes; a user without rows for `idle` is ended, `end`
    gives out what is still open, and the state goes. The state is what waits and what `step` keeps."""
    rest = stream.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {idle})")).first()[0]
    names = [f.split()[0] for f in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        wait, kept, seen = json.loads(state.get[0]) if state.exists else ([], {}, 0)
        if not state.hasTimedOut:
            for pdf in batches:
                wait += pdf[["at", "event_id", *values]].astype(object).to_numpy().tolist()
        wait.sort(key=lambda r: r[:2])
        mark, found = state.getCurrentWatermarkMs(), []
        ready = sum(r[0] < mark * 1000 for r in wait)
        for row in wait[:ready]:
            found += step(kept, row)
            seen = row[0] // 1000
        wait = wait[ready:]
        if not wait and seen + rest <= mark:
            found += end(kept)
            state.remove()
        else:
            state.update((json.dumps([wait, kept, seen]),))
            state.setTimeoutTimestamp(max(wait[0][0] // 1000 if wait else seen + rest, mark) + 1)
        yield pd.DataFrame([(key[0], *r) for r in found], columns=["user_id", *names])

    rows = stream.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).select("user_id", "ts", "at", "event_id", *values)
    return rows.groupBy("user_id").applyInPandasWithState(run, f"user_id long, {out}", "held string", "append", "EventTimeTimeout")


def runs_in_order(frames: DataFrame, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """merge_equal_runs on a stream of frames(user_id, ts, event_id, content, duration): a run is given out when another content follows, or when its user has been idle."""

    def step(kept: dict, row: list) -> list[tuple]:
        _, _, content, duration = row
        run, out = kept.get("run"), []
        if run and run[1] != content:
            out.append(tuple(run))
        if not run or run[1] != content:
            kept["run"] = run = [(run[0] if run else 0) + 1, content, 0, 0]
        run[2], run[3] = run[2] + 1, run[3] + duration
        return out

    return fold_in_order(frames, ["content", "duration"], step, "run long, content string, n long, duration long", late, idle, lambda kept: [tuple(kept["run"])])


def counter_in_order(cmds: DataFrame, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """resettable_counter on a stream of cmds(user_id, ts, event_id, flag). A user who comes back after `idle` begins anew."""

    def step(kept: dict, row: list) -> list[tuple]:
        kept["n"] = kept.get("n", 0) + 1
        out = [(row[1], kept["n"])]
        if row[2] == 0:
            kept["n"] = 0
        return out

    return fold_in_order(cmds, ["flag"], step, "event_id long, total long", late, idle)


def pairs_in_order(cmds: DataFrame, requests: tuple[int, ...], late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """pair_in_order on a stream of cmds(user_id, ts, event_id, cmd): the open requests of each code are kept; they are forgotten once the user has been idle."""

    def step(kept: dict, row: list) -> list[tuple]:
        at, event, cmd = row
        opened = kept.get(str(cmd - 1))
        out = []
        if opened:
            asked, since = opened.pop(0)
            out.append((cmd - 1, asked, event, at - since))
        if cmd in requests:
            kept.setdefault(str(cmd), []).append([event, at])
        return out

    return fold_in_order(cmds, ["cmd"], step, "code int, event_id long, answer long, latency long", late, idle)


def run_now(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream over what its sources hold now: written by a file sink, with its checkpoint, in the shared folder, and read back."""
    path = new_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return spark.readStream.schema(read_corpus(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def with_clock(stream: DataFrame, last: DataFrame, by: str = "60 days") -> DataFrame:
    """A stream(user_id, ts, ...) and one row more of user -1, `by` behind the latest ts of last(ts): the clock that lets a
    bounded stream's timers run out. The row's other columns are null."""
    tick = cut(last.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {by}")).alias("ts")).select("ts", F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id")), "clock")
    path = tick.inputFiles()[0].rsplit("/", 1)[0]
    clock = stream.sparkSession.readStream.schema(tick.schema).parquet(path)
    return stream.unionByName(clock, allowMissingColumns=True)
