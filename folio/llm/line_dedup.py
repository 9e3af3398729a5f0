"""Corpus-wide removal of repeated lines with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import LOWER, UPPER, WHITE, fingerprint, lower_ascii, scratch, slots_for, table, written

HASH = ["h1", "h2"]
#: Lines for each bucket of the runs.
RUN_ROWS = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash(key: Column) -> Column:
    h1, h2 = fingerprint(key)
    return F.struct(h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """Runs of (h1, h2, n): line hashes and the number of documents they are in, in levels.

    A run is a table of `buckets` buckets by hash, one sorted file each, in a folder of the
    shared file system. `add` takes one batch: its keys are merge-anti-joined against those that a
    run has already settled (`threshold` or more documents, so that further counts can't
    matter), and the rest becomes a run of level 0. When a level holds `fanout` runs they are
    compacted into one of the next level, by merge joins of equal buckets. Neither moves a run through a
    shuffle. A list of the runs is written after each batch: `open` goes on with it in
    another session, so that later batches can be added.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int, fanout: int = 2, buckets: int = 8):
        self.spark, self.folder, self.threshold, self.fanout, self.buckets = spark, folder, threshold, fanout, buckets
        self.levels: list[list[str]] = [[]]
        self.batches = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        last = max(spark.read.json(f"{folder}/list-*").collect(), key=lambda r: r["batches"])  # a row for each batch
        self = cls(spark, folder, last["threshold"], last["fanout"], last["buckets"])
        self.levels, self.batches = [[str(x) for x in level] for level in last["levels"]], last["batches"]
        return self

    def _read(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):
            columns = "(h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2)"
            self.spark.sql(f"CREATE TABLE {run} {columns} INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(run)

    def _write(self, counts: DataFrame) -> str:
        """A run of counts, each key once."""
        run = f"run_{uuid.uuid4().hex}"
        rows = counts.select(*HASH, "n").repartition(self.buckets, *HASH)
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{run}").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def close(self) -> None:
        """Takes the runs' names out of the catalog; their files and the list stay."""
        for level in self.levels:
            for run in level:
                self._drop(run)

    def add(self, counts: DataFrame) -> None:
        """Adds one batch of counts(h1, h2, n), each key once."""
        counts = counts.repartition(self.buckets, *HASH)
        for run in (r for level in self.levels for r in level):
            settled = self._read(run).where(F.col("n") >= self.threshold).select(*HASH)
            counts = counts.join(settled.hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._write(counts))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[k] = self.levels[k], []
            self.levels[k + 1].append(self._write(self._merged(old)))
            for run in old:
                self._drop(run)
            k += 1
        self.batches += 1
        state = [(self.batches, self.threshold, self.fanout, self.buckets, self.levels)]
        schema = "batches int, threshold int, fanout int, buckets int, levels array<array<string>>"
        self.spark.createDataFrame(state, schema).coalesce(1).write.json(f"{self.folder}/list-{self.batches}")

    def _merged(self, runs: list[str]) -> DataFrame:
        first, *rest = [self._read(r) for r in runs]
        for r in rest:
            both = first.join(r.withColumnRenamed("n", "m").hint("merge"), HASH, "full")
            first = both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return first

    def frequent(self) -> DataFrame:
        merged = self._merged([r for level in self.levels for r in level])
        return merged.where(F.col("n") >= self.threshold).select(*HASH)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_dropped` added (columns of these names are replaced).

    A text is split at newlines; a line's key is the line stripped of white space at both
    ends, A-Z lower-cased. Keys of at least `min_chars` code points that occur in at least
    `min_docs` documents lose all their lines. Each row is a document: repeated rows, and
    rows whose doc_id is null, count once each. A null or empty text is one empty line and
    is kept as an empty text. An empty table gives an empty table. Other columns, of any name
    and type, pass through; only doc_id and text are looked at. A text of any length is one
    cell and never copied for its lines: only hashes leave it.

    Texts are read twice (hashes; rebuilding) and shuffled once; runs, joins and counts
    work on hashes of 16 bytes. The hot line is counted by partial sums, and the join that
    finds its documents is between two written tables, which Spark may split by skew.
    """
    spark = docs.sparkSession
    r1, r2 = fingerprint(F.col("doc_id"), F.col("text"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= min_chars), _hash))
    lines = docs.select(r1.alias("r1"), r2.alias("r2"), F.explode(hashes).alias("h")).select("r1", "r2", "h.h1", "h.h2")
    lines = written(lines.withColumn("batch", F.pmod("r1", F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(spark, scratch(spark, "runs"), min_docs, fanout, buckets=slots_for(lines.count(), RUN_ROWS, 8))
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).groupBy(*HASH).agg(F.count("*").alias("n")))
    frequent = written(runs.frequent(), "frequent")
    runs.close()
    dropped = lines.join(frequent, HASH, "left_semi").groupBy(F.col("r1").alias("d1"), F.col("r2").alias("d2")).agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    own = docs.drop("kept_text", "n_lines", "n_dropped")
    own = own.select(F.struct("*").alias("row"), r1.alias("r1"), r2.alias("r2"))
    both = own.join(dropped, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2")), "left")
    every = _lines(F.col("row.text"))
    kept = F.when(F.col("drop").isNull(), every).otherwise(F.filter(every, lambda x: ~((F.length(_key(x)) >= min_chars) & F.array_contains(F.col("drop"), _hash(_key(x))))))
    out = both.select("row", F.size(every).cast("long").alias("n"), kept.alias("kept"))
    return out.select("row.*", F.array_join("kept", "\n").alias("kept_text"), F.col("n").alias("n_lines"), (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
