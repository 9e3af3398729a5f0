"""Goldens on inline rows, and plans."""

import re

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.search import search_hits
from folio.sources.tables import doc_pages
from folio.streaming.commands import dedup_stream, stream_corpus


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_entities_and_spaces(spark):
    assert one(spark, "&amp;lt; &lt; &am", T.decode_entities) == "&lt; < &am"
    assert one(spark, "a b﻿c\nd", T.norm_spaces) == "a b c\nd"


def test_natural_key(spark):
    names = ["img10.png", "IMG2.png", "img 02b.png", ""]
    keys = {n: one(spark, n, T.natural_key) for n in names}
    assert sorted(names, key=keys.get) == ["", "IMG2.png", "img 02b.png", "img10.png"]


def test_bracketed_numbers(spark):
    assert [one(spark, v, T.strip_bracketed_number) for v in ("[12]", " 7 ", "x1", "", None)] == [12, 7, None, None, None]


def test_hits_do_not_overlap_and_queries_are_literal(spark):
    docs = spark.createDataFrame([(1, "aaa a.b xa\\Ebxa\\Eb")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "aa"), (2, "."), (3, "a\\Eb")], "query_id int, q string")
    hits = sorted((r["query_id"], r["pos"], r["end"]) for r in search_hits(doc_pages(docs), q).collect())
    assert hits == [(1, 0, 2), (2, 5, 6), (3, 9, 13), (3, 14, 18)]


def test_dedup_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "2024-01-01 00:00:00") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = dedup_stream(stream_corpus(spark, str(tmp_path / "in"), df.schema), "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r["text"] for r in spark.sql("SELECT text FROM seen").collect()) == ["text 0", "text 1", "text 2"]


def test_no_python_in_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = doc_pages(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_long_right_to_left_lines(spark):
    """Lines whose runs are longer than the stack is deep."""
    for part in ("\u05d0 ", "\u05d0\u05d4 12 ab "):
        text = part * 20_000
        got = spark.createDataFrame([(text,)], "t string").select(T.rtl_runs(F.col("t")).alias("t")).first()["t"]
        want = re.sub("[\u05d0-\u05ea][\u05d0-\u05ea 0-9]*", lambda m: m[0][::-1], text)
        assert got == want
