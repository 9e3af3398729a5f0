"""Helpers the training-data operators share: shared-folder tables, row keys, distributed running sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: list[str] = []
_live: list[str] = []
#: Slots whose totals one task adds up.
SPAN = 1_024


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset: a temporary folder in local mode, an error on a cluster."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="folio-"))
    return _own[0]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by `release` or when the driver's JVM ends."""
    root = f"{shared_folder(spark)}/folio-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, root)
    fs.deleteOnExit(at)
    _live.append(root)
    return f"{root}/{name}"


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what `scratch` has named since it had named `since` paths (see `mark`), but for the last one.

    Call it once the table in that last one has been written and nothing else will be read."""
    for root in _live[since:-1]:
        at, fs = _file_system(spark, root)
        fs.delete(at, True)
        _live.remove(root)


def mark() -> int:
    """How many paths are in use: what `release` takes."""
    return len(_live)


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df as a table in the shared folder, in a folder for each value of `parts`: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """128 bits over the columns' values, as two longs with different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("folio"), *cols)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, slot: Column, slots: int) -> DataFrame:
    """Adds `out`: the inclusive running sum of `value` in each group, in the order of (slot, order).

    A group of any size is dealt over its slots, whole numbers from 0 to before `slots`, so that
    no task holds a whole group: sums run within (group, slot), those of the slots' totals
    within spans of SPAN slots, and, if there are several, those of the spans' totals within
    the group. The slots should be even, as those of a hash of the order columns are. df should
    be a written table, as it is read twice; names that begin with `_` are for this function.
    """
    df = df.withColumn("_slot", slot.cast("long"))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(groups)]
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(groups)]
    totals = df.groupBy(*groups, "_slot").agg(F.sum(value).alias("_total")).withColumn("_span", F.floor(F.col("_slot") / SPAN))
    totals = totals.withColumn("_in", F.coalesce(F.sum("_total").over(before([*groups, "_span"], "_slot")), F.lit(0)))
    if slots > SPAN:
        spans = totals.groupBy(*groups, "_span").agg(F.sum("_total").alias("_sum"))
        spans = spans.select(*named, F.col("_span").alias("_at"), F.coalesce(F.sum("_sum").over(before(groups, "_span")), F.lit(0)).alias("_base"))
        totals = totals.join(spans, [*same, F.col("_span") == F.col("_at")]).withColumn("_in", F.col("_in") + F.col("_base")).drop("_at", *[f"_k{i}" for i in range(len(groups))])
    totals = totals.select(*named, F.col("_slot").alias("_of"), F.col("_in").alias("_before"))
    within = Window.partitionBy(*groups, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = df.withColumn("_within", F.sum(value).over(within)).join(totals, [*same, F.col("_slot") == F.col("_of")], "left")
    return both.select(*[F.col(c) for c in df.columns if c != "_slot"], (F.col("_within") + F.col("_before")).alias(out))


def rank_by_hash(df: DataFrame, groups: list[str], order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Adds `out`: the number of each row, from 1, within its group in the order of a hash of the columns of order."""
    slots = slots_for(rows)
    return running_sum(df.withColumn("_one", F.lit(1)), groups, order, "_one", out, hashed_slot(order, slots), slots).drop("_one")


def hashed_slot(order: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(slots))


def slots_for(rows: int, each: int = 5_000, least: int = 64) -> int:
    """Enough slots for about `each` rows in one, whatever the size of the largest group."""
    return max(least, -(-rows // each))


def hashable(c: Column, kind: DataType) -> Column:
    """c in a form that can be hashed and sorted whatever its type: a map becomes the sorted hashes of its entries."""
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.xxhash64(hashable(e["key"], kind.keyType), hashable(e["value"], kind.valueType))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[hashable(c[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(kind.fields)]))
    return c


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """The fingerprint of all columns of a row, of whatever type."""
    return fingerprint(*[hashable(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
