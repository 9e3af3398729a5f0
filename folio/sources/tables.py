"""The corpus tables, and tables derived from them by plain SQL that Spark and the checks share in meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.arrays import let, running


def read_corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, start, len: the lines of each text and their offsets in code points, found within the row."""
    rows = docs.select("doc_id", F.posexplode(_held("text")).alias("line_no", "x"))
    return rows.select("doc_id", "line_no", "x.line", "x.len", "x.start")


def _held(text: str) -> Column:
    """A text's lines as an array."""
    return let(F.split(text, "\n", -1), lambda l: let(running(_widths(l)), lambda at: F.transform(l, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.get(at, i).alias("start"), F.length(x).alias("len")))))


def line_pages(docs: DataFrame, lines_a_page: int = 20) -> DataFrame:
    """doc_id, page_no, lines: each page with that many lines(line_no, line, start, len), as an array."""
    n = F.lit(lines_a_page)
    held = let(_held("text"), lambda l: F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / n).cast("int")), lambda p: F.slice(l, p * n + 1, n)))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(held).alias("page_no", "lines"))


def _widths(parts: Column) -> Column:
    """Lengths of parts with what parted them."""
    return F.transform(parts, lambda x: F.length(x) + 1)


def doc_pages(docs: DataFrame, lines_a_page: int = 20) -> DataFrame:
    """doc_id, page_no, text, start, end (exclusive): each page is that many lines."""
    n = F.lit(lines_a_page)

    def page(l, at, p):
        return F.struct(F.array_join(F.slice(l, p * n + 1, n), "\n").alias("text"), F.get(at, p * n).alias("start"), (F.get(at, F.least((p + 1) * n, F.size(l))) - 1).alias("end"))

    held = let(F.split("text", "\n", -1), lambda l: let(running(_widths(l)), lambda at: F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / n).cast("int")), lambda p: page(l, at, p))))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(held).alias("page_no", "x"))
    return rows.select("doc_id", "page_no", "x.text", "x.start", "x.end")


def page_text(rows: DataFrame) -> DataFrame:
    """Text per page of rows(doc_id, page_no, line_no, line, start, len)."""
    held = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.groupBy("doc_id", "page_no").agg(held.alias("h"), F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
    return out.select("doc_id", "page_no", F.array_join("h.line", "\n").alias("text"), "start", "end")


QUERY_ROWS = ((1, "the"), (2, "ing a"), (3, "tion"), (4, "aa"), (5, "é"), (6, "."))


def search_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERY_ROWS), "query_id int, q string")


def commands(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, cmd, result, flag of reader commands made of events."""
    cmd = F.expr("CASE event_type WHEN 'view' THEN 48 WHEN 'click' THEN 49 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 ELSE 49 END")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", cmd.alias("cmd"), F.when(F.col("event_type") == "error", 4).otherwise(0).alias("result"), (F.col("event_id") % 2).alias("flag"))


def pixels(vectors: DataFrame, span: int = 10_000) -> DataFrame:
    """image_id, x, y, r, g, b: one image for each label, one row of pixels for each vector, in the order of vec_id.

    A label's rows are numbered in two levels, within ranges of `span` ids, so that no task holds a label."""
    rows = vectors.select(F.col("label").alias("image_id"), "vec_id", F.floor(F.col("vec_id") / span).alias("part"), "embedding")
    before = Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("image_id", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("image_id", "part").orderBy("vec_id")) - 1
    rows = rows.withColumn("own", own).join(counts, ["image_id", "part"]).withColumn("y", (F.col("base") + F.col("own")).cast("int"))
    rows = rows.select("image_id", "y", F.posexplode("embedding").alias("x", "v"))
    r = F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int")
    return rows.select("image_id", "x", "y", r.alias("r"), (255 - r).alias("g"), (F.col("x") * F.col("y") % 256).alias("b"))


def other_pixels(px: DataFrame) -> DataFrame:
    return px.withColumn("r", F.least(F.lit(255), F.col("r") + (F.col("x") + F.col("y")) % 3))


#: The same derivations for the checks.
SQL = {
    "lines": """lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, line, CAST(length(line) AS INTEGER) AS len,
  CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))""",
    "pages": """doc_pages AS (SELECT doc_id, CAST(line_no // 20 AS INTEGER) AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS text,
  min(start) AS start, max(start + len) AS "end" FROM lines GROUP BY doc_id, line_no // 20)""",
    "queries": "queries AS (SELECT CAST(a AS INTEGER) AS query_id, b AS q FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERY_ROWS) + ") t(a, b))",
    "commands": """commands AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 48 WHEN 'click' THEN 49 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 ELSE 49 END AS cmd,
  CASE WHEN event_type = 'error' THEN 4 ELSE 0 END AS result, event_id % 2 AS flag FROM events)""",
    "pixels": """pixels AS (SELECT image_id, CAST(i - 1 AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INTEGER) AS r,
  255 - CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INTEGER) AS g, CAST((i - 1) * y % 256 AS INTEGER) AS b
  FROM (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
pixels_b AS (SELECT image_id, x, y, least(255, r + (x + y) % 3) AS r, g, b FROM pixels)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
