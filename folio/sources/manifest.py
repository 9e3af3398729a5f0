"""Checksums of written files where they lie: a list that is committed at once, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of the list beside the files; Spark's readers of the data skip names that begin with `_`.
LIST = "_manifest"


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """name, size, sha256 of the data files under path, read by the tasks as they lie there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")).where(~name.rlike(r"^[._]"))


def one_list(sums: DataFrame) -> DataFrame:
    """The rows in one part. They are moved there: coalesce would have one task read all the files."""
    return sums.repartition(1)


def write_manifest(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet under path (a new folder), then the list of its files, and returns the list.

    The sums are taken from what lies in the folder, not from what was meant to be written. The list is
    one file, written beside and renamed, so that it is there whole or not at all; a folder without one isn't finished."""
    spark = df.sparkSession
    df.write.parquet(path)
    one_list(file_sums(spark, path)).write.parquet(f"{path}/{LIST}.part")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = hadoop(f"{path}/{LIST}.part"), hadoop(f"{path}/{LIST}")
    if not part.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(part, whole):
        raise OSError(f"{path} has a list already")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, size long, sha256 string").parquet(f"{path}/{LIST}")


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """name, status (missing, extra, torn, changed) of the files under path that aren't as the list has them; torn: another size."""
    now, then = file_sums(spark, path), read_manifest(spark, path).select("name", F.col("size").alias("size0"), F.col("sha256").alias("sum0"))
    status = F.when(F.col("size").isNull(), "missing").when(F.col("size0").isNull(), "extra").when(F.col("size") != F.col("size0"), "torn").when(F.col("sha256") != F.col("sum0"), "changed")
    return now.join(then, "name", "full").select("name", status.alias("status")).where("status IS NOT NULL")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files under path that are as the list has them, with the name of each one's file."""
    bad = verify_files(spark, path).select("name")
    return spark.read.parquet(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).join(bad, F.col("file") == F.col("name"), "left_anti")
