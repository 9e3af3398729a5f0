"""Reader commands and frames: batch answers, and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import fold
from folio.operators.search import FEW, HELD, _pack, gram_keys, gram_sizes, query_grams, with_found, with_grams
from folio.sources.shared import cut
from folio.sources.tables import commands, read_corpus, with_
from folio.streaming.ordered import counter_in_order, pairs_in_order, run_now, runs_in_order, stream_table, with_clock


def _user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def merge_equal_runs(frames: DataFrame) -> DataFrame:
    """user_id, run, content, n, duration: consecutive frames of equal content as one; durations (microseconds) add up."""
    change = F.coalesce((F.col("content") != F.lag("content").over(_user())).cast("int"), F.lit(1))
    rows = frames.withColumn("change", change).withColumn("run", F.sum("change").over(_user().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run").agg(F.min("content").alias("content"), F.count("*").alias("n"), F.sum("duration").alias("duration"))


def frames(events: DataFrame) -> DataFrame:
    """user_id, ts, event_id, content, duration: a frame lasts until the user's next one, the last one no time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "ts", "event_id", F.col("event_type").alias("content"), at.alias("at"))
    return rows.withColumn("duration", F.coalesce(F.lead("at").over(_user()) - F.col("at"), F.lit(0))).drop("at")


def pair_requests(cmds: DataFrame, request: int = 48) -> DataFrame:
    """user_id, event_id, answer, latency (microseconds): a request whose next command of the user is its response, request + 1."""
    at = F.unix_micros("ts")
    nxt = cmds.select("user_id", "event_id", "cmd", F.lead("cmd").over(_user()).alias("next"), F.lead("event_id").over(_user()).alias("answer"), (F.lead(at).over(_user()) - at).alias("latency"))
    return nxt.where((F.col("cmd") == request) & (F.col("next") == request + 1)).select("user_id", "event_id", "answer", "latency")


def pair_in_order(cmds: DataFrame, requests: tuple[int, ...], slot_s: int = 3600) -> DataFrame:
    """user_id, code, event_id, answer, latency (microseconds): the n-th request of a user and code with the n-th response
    that has one to answer. A response is the request's code + 1; one that comes while no request is open is left out.

    Codes that stand for two kinds of request are one queue: their responses can't be told apart. With Q requests
    and R responses so far, the least that Q - R has been (or 0, if more) is how many responses
    were left out, so that numbers are running sums and a join by number pairs them. Sums and
    least values run within slots of time, and over a user's slots: no task holds a user."""
    role = F.filter(F.array(F.when(F.col("cmd").isin(*requests), F.struct(F.col("cmd").alias("code"), F.lit(1).alias("d"))), F.when((F.col("cmd") - 1).isin(*requests), F.struct((F.col("cmd") - 1).alias("code"), F.lit(-1).alias("d")))), lambda x: x.isNotNull())
    key = ["user_id", "code"]
    rows = cmds.select("user_id", "event_id", "ts", F.explode(role).alias("x")).select("user_id", "event_id", "ts", "x.*", F.floor(F.unix_seconds("ts") / slot_s).alias("slot"))
    own = Window.partitionBy(*key, "slot").orderBy("ts", "event_id")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda d: F.sum((F.col("d") == d).cast("long")).over(upto)
    rows = rows.withColumns({"q": count(1), "r": count(-1)}).withColumn("low", F.min(F.col("q") - F.col("r")).over(before))
    slots = rows.groupBy(*key, "slot").agg(F.max("q").alias("q0"), F.max("r").alias("r0"), F.min(F.col("q") - F.col("r")).alias("low0"))
    past = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumns({c: F.coalesce(F.sum(c).over(past), F.lit(0)) for c in ("q0", "r0")})
    slots = slots.withColumn("low0", F.least(F.lit(0), F.min(F.col("q0") - F.col("r0") + F.col("low0")).over(past)))
    rows = rows.join(slots, [*key, "slot"]).select(*key, "event_id", F.unix_micros("ts").alias("at"), "d", (F.col("q") + F.col("q0")).alias("q"), (F.col("r") + F.col("r0")).alias("r"), F.least("low0", F.col("low") + F.col("q0") - F.col("r0")).alias("low"))
    asked = rows.where("d = 1").select(*key, F.col("q").alias("no"), "event_id", F.col("at").alias("since"))
    said = rows.where("d = -1 AND q - r >= low").select(*key, (F.col("r") + F.col("low")).alias("no"), F.col("event_id").alias("answer"), "at")
    return asked.join(said, [*key, "no"]).select(*key, "event_id", "answer", (F.col("at") - F.col("since")).alias("latency"))


def result_tally(cmds: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, cmd, result, n in windows that tumble, or slide by `slide`; works on a stream with a watermark too."""
    return cmds.groupBy(F.window("ts", width, slide).alias("w"), "cmd", "result").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cmd", "result", "n")


def resettable_counter(cmds: DataFrame) -> DataFrame:
    """user_id, event_id, total: running count of commands that starts again after each command of flag 0."""
    group = F.coalesce(F.sum(F.when(F.col("flag") == 0, 1).otherwise(0)).over(_user().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cmds.withColumn("g", group)
    return rows.select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def reading_sessions(cmds: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n of the sessions that a pause of `gap` ends."""
    s = cmds.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def stream_corpus(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents as their files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_tally(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return result_tally(stream.withWatermark("ts", late), width)


def stream_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """doc_id, query_id of arriving docs(doc_id, text) and the stated queries(query_id, q) they contain: a stream-static join.

    Up to FEW queries are broadcast. Up to HELD are looked up in Python workers, a text at a time: no row is
    made for a gram of a text. More are met by the gram of each that the fewest other ones have."""
    q = queries.select("query_id", fold(F.col("q")).alias("q")).where(F.length("q") > 0)
    docs = docs.select("doc_id", fold(F.col("text")).alias("text"))
    if queries.limit(FEW + 1).count() <= FEW:
        return docs.join(F.broadcast(q), F.contains(F.col("text"), F.col("q"))).select("doc_id", "query_id")
    q = cut(q, "queries")
    if q.limit(HELD + 1).count() <= HELD:
        found = with_found(docs, [r["q"] for r in q.select("q").distinct().collect()])
        return found.join(F.broadcast(q), "q").select("doc_id", "query_id")
    keys = cut(gram_keys(q, query_grams(q).groupBy("gram").agg(F.count("*").alias("n"))), "keys")
    return with_grams(docs, "text", gram_sizes(q)).join(keys, "gram").where(F.contains("text", F.col("q"))).select("doc_id", "query_id")


def stream_pairs(requests: DataFrame, responses: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """user_id, request, answer, latency: every response of the user that follows a request within the time, both sides with watermarks."""
    a = requests.select(F.col("user_id").alias("user"), F.col("event_id").alias("request"), F.col("ts").alias("asked")).withWatermark("asked", late)
    b = responses.select("user_id", F.col("event_id").alias("answer"), F.col("ts").alias("said")).withWatermark("said", late)
    near = (F.col("user") == F.col("user_id")) & (F.col("said") >= F.col("asked")) & (F.col("said") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "request", "answer", (F.col("said").cast("double") - F.col("asked").cast("double")).alias("latency"))


def stream_counter(cmds: DataFrame) -> DataFrame:
    """resettable_counter on a stream: a user's count is the state. Commands of a batch are taken in order of time; late ones count when they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0,)
        pdf, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event, flag in zip(pdf["event_id"], pdf["flag"], strict=True):
            total += 1
            out.append((key[0], event, total))
            total = 0 if flag == 0 else total
        state.update((total,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "total"])

    return cmds.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, total long", "total long", "append", "NoTimeout")


def stream_runs(frames: DataFrame) -> DataFrame:
    """merge_equal_runs on a stream: the open run is the state, a run is given out when another content follows it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        no, content, n, duration = state.get if state.exists else (0, None, 0, 0)
        pdf, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for what, took in zip(pdf["content"], pdf["duration"], strict=True):
            if n and what != content:
                out.append((key[0], no, content, n, duration))
            no, n, duration = (no, n + 1, duration + took) if n and what == content else (no + 1, 1, took)
            content = what
        state.update((int(no), content, int(n), int(duration)))
        yield pd.DataFrame(out, columns=["user_id", "run", "content", "n", "duration"]).astype({"user_id": "int64", "run": "int64", "n": "int64", "duration": "int64"})

    return frames.groupBy("user_id").applyInPandasWithState(run, "user_id long, run long, content string, n long, duration long", "run long, content string, n long, duration long", "append", "NoTimeout")


def dedup_stream(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each text within the watermark."""
    return stream.withColumn("md5", F.md5("text")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["md5"])


def calls(events: DataFrame) -> DataFrame:
    """user_id, event_id, ts, cmd: two kinds of requests (48, 64) and their responses, made of events."""
    cmd = F.expr("CASE event_type WHEN 'view' THEN 48 WHEN 'click' THEN 49 WHEN 'purchase' THEN 64 WHEN 'signup' THEN 65 ELSE 2 END")
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), cmd.alias("cmd"))


def _timed(s, d, build):
    """The rows that build makes of the events as a stream, with a clock behind them; the clock's own user is left out."""
    events = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = with_clock(events(stream_table(s, d, "events")), events(read_corpus(s, d, "events")))
    return run_now(build(stream), "stream").where("user_id <> -1")


def _frames(e):
    return e.select("user_id", "ts", "event_id", F.coalesce("event_type", F.lit("")).alias("content"), F.coalesce(F.col("event_id") % 97, F.lit(0)).alias("duration"))


def _c(s, d):
    return commands(read_corpus(s, d, "events"))


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_C = with_("commands").rstrip()
_IN_ORDER = """WITH c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 48 WHEN 'click' THEN 49 WHEN 'purchase' THEN 64 WHEN 'signup' THEN 65 END AS cmd FROM events WHERE event_type <> 'error'),
a AS (SELECT user_id, CASE WHEN cmd IN (48, 64) THEN cmd ELSE cmd - 1 END AS code, event_id, ts, CASE WHEN cmd IN (48, 64) THEN 1 ELSE -1 END AS d FROM c),
b AS (SELECT *, sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) OVER w AS q, sum(CASE WHEN d = -1 THEN 1 ELSE 0 END) OVER w AS r FROM a WINDOW w AS (PARTITION BY user_id, code ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, least(0, coalesce(min(q - r) OVER (PARTITION BY user_id, code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM b)
SELECT x.user_id, x.code, x.event_id, y.event_id AS answer, epoch_us(y.ts) - epoch_us(x.ts) AS latency FROM e x JOIN e y ON x.user_id = y.user_id AND x.code = y.code AND x.d = 1 AND y.d = -1 AND y.q - y.r >= y.low AND x.q = y.r + y.low"""
_RUNS = f"WITH a AS (SELECT *, event_id % 97 AS took, CASE WHEN event_type = lag(event_type) {_W} THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT *, CAST(sum(c) {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a) SELECT user_id, run, min(event_type) AS content, count(*) AS n, CAST(sum(took) AS BIGINT) AS duration FROM b GROUP BY user_id, run"
_COUNT = f"g AS (SELECT *, coalesce(sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM commands) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS total FROM g"
_FIND = "WITH q AS (SELECT DISTINCT left(w, 12) AS q FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM benchmark)) SELECT doc_id, q FROM documents JOIN q ON contains(lower(text), lower(q))"


def _stream_found(s, d):
    """Documents as they arrive, searched for the words of the benchmark texts; the id of a query is the word's hash."""
    q = cut(_pack(s, d), "pack")
    return run_now(stream_search(stream_table(s, d, "documents").select("doc_id", "text"), q), "found").join(q, "query_id").select("doc_id", "q")


#: Longer than any pause of the events.
_LONG = "40 days"

REGISTERED = {
    "stream_corpus": (lambda s, d: run_now(stream_table(s, d, "documents").select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("md5")), "corpus"), "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS md5 FROM documents"),
    "stream_search": (_stream_found, _FIND),
    "dedup_stream": (lambda s, d: run_now(dedup_stream(stream_table(s, d, "documents").select("text", F.timestamp_seconds(F.coalesce(F.col("doc_id"), F.lit(0)) + 86_400).alias("ts")), "ts", "100000 days").select("md5"), "first"), "SELECT DISTINCT md5(text) AS md5 FROM documents"),
    "stream_runs": (lambda s, d: _timed(s, d, lambda e: runs_in_order(_frames(e), idle=_LONG)), _RUNS),
    "stream_counter": (lambda s, d: _timed(s, d, lambda e: counter_in_order(e.withColumn("flag", F.coalesce(F.col("event_id") % 2, F.lit(0))), idle=_LONG)), f"{_C}, {_COUNT}"),
    "stream_pairs_in_order": (lambda s, d: _timed(s, d, lambda e: pairs_in_order(calls(e), (48, 64), idle=_LONG)), _IN_ORDER),
    "stream_sessions": (lambda s, d: _timed(s, d, lambda e: reading_sessions(e.withWatermark("ts", "10 minutes"))).withColumn("start", F.unix_timestamp("start")), f"{_C}, a AS (SELECT *, CASE WHEN ts < lag(ts) {_W} + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM commands), b AS (SELECT *, sum(c) {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM b GROUP BY user_id, s"),
    "pair_in_order": (lambda s, d: pair_in_order(calls(read_corpus(s, d, "events")), (48, 64)), _IN_ORDER),
    "merge_equal_runs": (lambda s, d: merge_equal_runs(frames(read_corpus(s, d, "events"))), f"WITH a AS (SELECT *, coalesce(lead(epoch_us(ts)) {_W} - epoch_us(ts), 0) AS took, CASE WHEN event_type = lag(event_type) {_W} THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT *, CAST(sum(c) {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a) SELECT user_id, run, min(event_type) AS content, count(*) AS n, CAST(sum(took) AS BIGINT) AS duration FROM b GROUP BY user_id, run"),
    "pair_requests": (lambda s, d: pair_requests(_c(s, d)), f"{_C} SELECT user_id, event_id, answer, latency FROM (SELECT *, lead(epoch_us(ts)) {_W} - epoch_us(ts) AS latency, lead(cmd) {_W} AS nxt, lead(event_id) {_W} AS answer FROM commands) WHERE cmd = 48 AND nxt = 49"),
    "result_tally": (lambda s, d: result_tally(_c(s, d)).withColumn("start", F.unix_timestamp("start")), f"{_C} SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, cmd, result, count(*) AS n FROM commands GROUP BY ALL"),
    "result_tally_sliding": (lambda s, d: result_tally(_c(s, d), slide="30 minutes").withColumn("start", F.unix_timestamp("start")), f"{_C} SELECT CAST(floor(epoch(ts) / 1800) * 1800 - back AS BIGINT) AS start, cmd, result, count(*) AS n FROM commands, (VALUES (0), (1800)) v(back) GROUP BY ALL"),
    "resettable_counter": (lambda s, d: resettable_counter(_c(s, d)), f"{_C}, g AS (SELECT *, coalesce(sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM commands) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS total FROM g"),
    "reading_sessions": (lambda s, d: reading_sessions(_c(s, d)).withColumn("start", F.unix_timestamp("start")), f"{_C}, a AS (SELECT *, CASE WHEN ts < lag(ts) {_W} + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM commands), b AS (SELECT *, sum(c) {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM b GROUP BY user_id, s"),
}
