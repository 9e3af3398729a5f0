"""Conflict-constrained best-fit packing of documents into bins of tokens."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import count_words, fingerprint, lower_ascii, slots_for, table, written

#: Equal rows that one task numbers.
CHUNK = 10_000
OUT = "doc_id long, piece int, size long, source string, shard int, bin int, position int, start long, bin_used long"


class Bins:
    """Open bins ordered by residual. Sets of bins are bitmaps: those with each residual, those
    that hold a duplicate cluster, and those that hold a source once, twice, and so on."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.at = defaultdict(int)  # residual -> bins
        self.some = 0  # residuals that have bins
        self.cluster = defaultdict(int)
        self.source = defaultdict(lambda: [0] * per_source)

    def put(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """The bin and the start of the new piece: the successor search goes from residual
        `size` upwards until it meets the tightest bin without a conflict, or opens a new one."""
        no = self.cluster[cluster] | self.source[source][-1]
        left = self.some >> size
        r = size - 1
        while left:
            step = (left & -left).bit_length()
            r, left = r + step, left >> step
            if fits := self.at[r] & ~no:
                b = (fits & -fits).bit_length() - 1
                return self._take(b, r, size, source, cluster)
        self.residual.append(self.capacity)
        b = len(self.residual) - 1
        self.at[self.capacity] |= 1 << b
        return self._take(b, self.capacity, size, source, cluster)

    def _take(self, b: int, r: int, size: int, source: object, cluster: object) -> tuple[int, int]:
        bit = 1 << b
        self.at[r] &= ~bit
        if not self.at[r]:
            self.some &= ~(1 << r)
        self.residual[b] = r - size
        self.at[r - size] |= bit
        self.some |= 1 << (r - size)
        self.cluster[cluster] |= bit
        for k, held in enumerate(levels := self.source[source]):
            if not held & bit:
                levels[k] = held | bit
                break
        return b, self.capacity - r


def _pack(capacity: int, per_source: int):
    def pack(rows: pa.Table) -> pa.Table:
        # ids stay Arrow columns: as pandas' nullable longs, large ones would be rounded
        rows = rows.take(pc.sort_indices(rows, [("size", "descending"), *[(c, "ascending") for c in ("k1", "k2", "piece", "turn")]]))
        bins, held = Bins(capacity, per_source), defaultdict(int)
        size, source, c1, c2 = (rows.column(c).to_pylist() for c in ("size", "source", "c1", "c2"))
        put = [bins.put(n, s, c) for n, s, c in zip(size, source, zip(c1, c2, strict=True), strict=True)]
        position = []
        for b, _ in put:
            position.append(held[b])
            held[b] += 1
        made = {"bin": [b for b, _ in put], "start": [s for _, s in put], "position": position, "bin_used": [capacity - bins.residual[b] for b, _ in put]}
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        out = [(name, kinds[kind]) for name, kind in (f.split() for f in OUT.split(", "))]
        return pa.table({name: pa.array(made[name], kind) if name in made else rows.column(name).cast(kind) for name, kind in out})

    return pack


def pack(docs: DataFrame, capacity: int = 4096, per_source: int = 8, shard_rows: int = 5_000) -> DataFrame:
    """Pieces of docs(doc_id, text, source) and their bins: the columns of OUT.

    A document is its words and one end mark (a null or empty text: the mark alone); a longer
    one than `capacity` becomes full pieces and a rest. No bin holds two pieces of one
    duplicate cluster (equal texts but for A-Z case and white space) nor more than
    `per_source` pieces of one source (null is a source). Pieces are dealt by hash over shards
    of about `shard_rows`, whatever their source or cluster, and packed there by decreasing
    size; (shard, bin) names a bin. The bins hang on the rows alone, not on their order, files
    or partitions. Every piece is placed: repeated rows and ties are pieces of their own, null
    ids too, and ids of any size come through whole; an empty table gives an empty one. Other columns aren't read.
    """
    clean = F.btrim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    c1, c2 = fingerprint(clean)
    k1, k2 = fingerprint(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (count_words(F.col("text")) + 1).alias("tokens"), c1.alias("c1"), c2.alias("c2"), k1.alias("k1"), k2.alias("k2"))
    # equal rows are numbered by counting them, in chunks so that no task makes all of a large group
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("same"))
    chunk = F.explode(F.expr(f"sequence(0, cast((same - 1) div {CHUNK} AS int))"))
    rows = rows.select("*", chunk.alias("chunk")).repartition("k1", "k2", "chunk")
    rows = rows.select("*", F.explode(F.expr(f"sequence(chunk * {CHUNK}, cast(least(same, (chunk + 1L) * {CHUNK}) - 1 AS int))")).alias("turn"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(0, cast((tokens - 1) div {capacity} AS int))")).alias("piece"))
    rows = rows.withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity))
    rows = written(rows.drop("tokens", "same", "chunk"), "pack-pieces")
    shards = slots_for(rows.count(), shard_rows, 1)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("k1", "k2", "piece", "turn"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInArrow(_pack(capacity, per_source), OUT)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
