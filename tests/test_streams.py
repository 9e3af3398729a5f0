"""Streams in the order of event time: timers, idle users, restarts, and pairs of interleaved requests."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.streaming import commands
from folio.streaming.ordered import counter_in_order, pairs_in_order, runs_in_order

SCHEMA = "event_id long, ts string, user_id long, content string, flag long, duration long, cmd int"


def put(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(path))
    return df


def go(spark, tmp_path, build, schema, name):
    """Runs a stream over what lies in the folder now; a second call goes on at its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-at").trigger(availableNow=True).start()
    q.awaitTermination()
    state = (q.lastProgress or {}).get("stateOperators") or [{}]
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()), state[0].get("numRowsTotal")


def row(i, at, user, content="a", flag=1, duration=1, cmd=48):
    return (i, f"2024-01-01 {at}", user, content, flag, duration, cmd)


def test_a_last_run_comes_out_when_its_time_passes_and_idle_users_go(spark, tmp_path):
    df = put(spark, [row(1, "00:00:00", 1, "a"), row(2, "00:01:00", 1, "b"), row(3, "00:03:00", 1, "b", duration=5), row(4, "00:02:00", 2, "c")], tmp_path / "in" / "0")
    build = lambda s: runs_in_order(s, late="1 minute", idle="30 minutes")
    out, _ = go(spark, tmp_path, build, df.schema, "runs")
    assert out == [(1, 1, "a", 1, 1)]  # the later run may still grow
    put(spark, [row(5, "02:00:00", 3, "z")], tmp_path / "in" / "1")  # time passes: another user's row
    out, held = go(spark, tmp_path, build, df.schema, "runs")
    assert out == [(1, 1, "a", 1, 1), (1, 2, "b", 2, 6), (2, 1, "c", 1, 1)] and held == 1


def test_order_of_arrival_does_not_matter_and_restarts_lose_nothing(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [row(i, f"0{i // 60}:{i % 60:02d}:00", i * 7 % 3, "ab"[i * i % 7 % 2], int(rng.integers(3)), i) for i in range(180)]
    late = [rows[i] for i in rng.permutation(180)]
    late.sort(key=lambda r: int(r[0]) // 20)  # out of order by 20 minutes at most
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    out = {}
    for part in range(3):
        put(spark, late[part * 60 : part * 60 + 60], tmp_path / "in" / str(part))
        for name, f in (("count", counter_in_order), ("runs", runs_in_order)):
            out[name] = go(spark, tmp_path, lambda s, f=f: f(s, late="25 minutes", idle="9 hours"), whole.schema, name)[0]
    put(spark, [row(999, "23:59:00", 99)], tmp_path / "in" / "last")
    for name, f in (("count", counter_in_order), ("runs", runs_in_order)):
        out[name] = go(spark, tmp_path, lambda s, f=f: f(s, late="25 minutes", idle="9 hours"), whole.schema, name)[0]
    assert out["count"] == sorted(map(tuple, commands.resettable_counter(whole).collect()))
    assert out["runs"] == sorted(map(tuple, commands.merge_equal_runs(whole).collect()))


def brute_pairs(rows, requests):
    opened, out = defaultdict(list), []
    for event, at, user, cmd in sorted(rows, key=lambda r: (r[1], r[0])):
        if opened[user, cmd - 1]:
            asked, since = opened[user, cmd - 1].pop(0)
            out.append((user, cmd - 1, asked, event, (at - since) * 1_000_000))
        if cmd in requests:
            opened[user, cmd].append((event, at))
    return sorted(out)


@pytest.mark.parametrize("slot", [60, 3600, 10**9])
def test_interleaved_requests_are_paired_in_order(spark, slot):
    rng = np.random.default_rng(6)
    rows = [(i, int(t), int(u), int(c)) for i, (t, u, c) in enumerate(zip(rng.integers(0, 9_000, 400), rng.integers(0, 4, 400), rng.choice([48, 49, 50, 64, 65, 7], 400)))]
    cmds = spark.createDataFrame(rows, "event_id long, at long, user_id long, cmd int").withColumn("ts", F.timestamp_seconds("at"))
    got = commands.pair_in_order(cmds, (48, 49, 64), slot)  # 49 is the response of 48 and a request of its own
    assert sorted(map(tuple, got.collect())) == brute_pairs(rows, (48, 49, 64))


def test_stream_pairs_in_order_like_the_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [row(i, f"0{i // 60}:{i % 60:02d}:00", int(rng.integers(2)), cmd=int(rng.choice([48, 49, 64, 65]))) for i in range(150)]
    df = put(spark, rows, tmp_path / "in" / "0")
    put(spark, [row(999, "23:59:00", 99)], tmp_path / "in" / "last")
    got, _ = go(spark, tmp_path, lambda s: pairs_in_order(s, (48, 64), late="1 minute", idle="20 hours"), df.schema, "pairs")
    assert got == sorted(map(tuple, commands.pair_in_order(df, (48, 64)).collect())) and len(got) > 30
