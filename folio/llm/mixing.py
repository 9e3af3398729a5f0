"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import count_words, row_key, running_sum, slots_for, table, written

#: Weights by the rank of the source, over and over.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_rank, weight, source_size, target of each source of sizes(source, size).

    Sources rank by code point, null last. `share` times all sizes is dealt by weight; a
    target stops at `most` times its source's size and the excess is dealt again by weight.
    In the order of size / weight the sources that stop are a prefix, so one pass over the
    sources (a table of as many rows as there are sources) finds the level.
    """
    every, ranked = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(ranked))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumns({"cap": most * F.col("source_size"), "ratio": most * F.col("source_size").cast("double") / F.col("weight"), "total": F.sum("source_size").over(every)})
    up = Window.orderBy("ratio", "rank")
    s = s.withColumns({"stopped": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.lit(share) * F.col("total") - F.col("stopped")) / F.col("rest"))
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))
    s = s.withColumn("cut", F.min(free).over(every)["level"])
    return s.select("source", F.col("rank").alias("source_rank"), "weight", "source_size", F.coalesce(F.least(F.col("weight") * F.col("cut"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


#: What a document's place in the queue hangs on; rows that agree in all of it are interchangeable.
TURN = ["virtual", "source_rank", "key", "r1", "r2", "copy"]


def queue(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "") -> DataFrame:
    """The copies that the mixture takes: doc_id, r1, r2, size, source_size, target, weight, copy, virtual, taken.

    A source's documents queue in the order of md5(seed, doc_id), `most` times over. `virtual`
    is the virtual time at which a copy is half served: the source's words up to its middle
    divided by the source's weight. All copies are put in that order, and the order is cut
    where the middle of a copy lies beyond `share` times all words: `taken` is 1 up to there,
    0 behind. A source whose queue ends before leaves its share to the others, which is what
    `target` says in closed form. Source targets are met but for half a document and what the
    others' halves leave over. Ties go by source, md5, and the row's fingerprint.
    """
    r1, r2 = row_key(docs)
    work = docs.select("doc_id", "source", r1.alias("r1"), r2.alias("r2"), count_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    work = written(work, "mix-sizes")
    rows = work.count()
    digits = min(15, max(2, ceil(log(max(rows, 1) / 2_000 + 1, 16))))
    targets = written(source_targets(work, share, most, weights), "mix-targets")
    queued = running_sum(work, ["source"], ["key", "r1", "r2"], "size", "until", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"), 16**digits)
    theirs = targets.withColumnsRenamed({"source": "_source"})
    queued = queued.join(theirs, F.col("source").eqNullSafe(F.col("_source")), "left").drop("source", "_source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    middle = (2 * (F.col("copy") * F.col("source_size") + F.col("until")) - F.col("size")) / 2
    queued = written(queued.withColumn("virtual", middle / F.col("weight")), "mix-queue")
    # the level is where the closed form expects the cut: words flow evenly over virtual time up to it
    level = targets.agg(F.max(F.col("target") / F.col("weight")).alias("level"), F.sum("source_size").alias("words")).first()
    slots, t = slots_for(rows * most), F.col("virtual") / F.lit(level["level"] or 1.0)
    slot = F.floor(slots * F.when(t <= 1, t).otherwise(2 - 1 / t))
    total = running_sum(queued, [], TURN, "size", "total", slot, 2 * slots + 1)
    return total.withColumn("taken", F.when(2 * F.col("total") - F.col("size") <= 2 * share * F.lit(level["words"] or 0), 1).otherwise(0)).drop("total", "key", "until", "source_rank")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "") -> DataFrame:
    """The mixture itself: a row of docs for each copy taken, range-sorted by virtual time.

    Columns are those of docs, of any name and type. Rows that are equal in every column share
    their copies. Sizes are words; rows without words are taken as often as their place in the
    queue says. A null source is the last source; an empty table stays empty; no id needs to be
    unique. The queue works on narrow rows; texts, of any length, are shuffled twice: to their
    copies and into the order of the mixture.
    """
    copies = queue(docs, share, most, weights, seed).where("taken = 1").select(F.col("r1").alias("c1"), F.col("r2").alias("c2"), "virtual")
    r1, r2 = row_key(docs)
    once = docs.select(F.struct("*").alias("row"), r1.alias("r1"), r2.alias("r2")).dropDuplicates(["r1", "r2"])
    both = once.join(copies, (F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionByRange(n, "virtual").sortWithinPartitions("virtual", "r1").select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    copies = queue(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    one = copies.groupBy("doc_id", "r1", "r2").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("taken").alias("n"), F.min("virtual").alias("virtual"), F.count_if(F.col("copy") == 0).alias("same"))
    one = one.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))  # repeated rows: a row each, their copies dealt as evenly as they go
    extra = (F.col("turn") <= F.col("n") % F.col("same")).cast("long")
    return one.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.floor(F.col("n") / F.col("same")) + extra)).cast("long").alias("taken"), "virtual")


SQL = r"""
WITH w AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, 2 * CAST(source_size AS DOUBLE) / weight AS ratio FROM s2),
s4 AS (SELECT *, CAST(coalesce(sum(2 * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped,
  CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s3),
s5 AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - stopped) / rest AS level FROM s4),
s6 AS (SELECT source, rank, weight, source_size, total, coalesce(least(weight * (SELECT arg_min(level, (ratio, rank)) FROM s5 WHERE ratio > level), CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target FROM s5),
q AS (SELECT w.*, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until FROM w),
c AS (SELECT q.*, s6.rank, source_size, target, total, copy, CAST(2 * (copy * source_size + until) - size AS DOUBLE) / 2 / weight AS virtual
  FROM q JOIN s6 ON q.source IS NOT DISTINCT FROM s6.source, (VALUES (0), (1)) v(copy)),
t AS (SELECT *, CAST(sum(size) OVER (ORDER BY virtual, rank, key, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS up FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN 2 * up - size <= CAST(3 AS DOUBLE) * total THEN size ELSE 0 END) AS BIGINT) AS taken, min(virtual) AS virtual
FROM t GROUP BY doc_id, size, source_size, target
"""
