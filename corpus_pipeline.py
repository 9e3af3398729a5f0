"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again by the next.

Quality filter, repeated lines, near duplicates (five-word shingles, similarity 0.8), mixture of
sources, packing into bins. All stages but the last return the columns of documents.

Every stage takes nulls in any column, texts of any length, ties and repeated rows as its
operator's docstring says; an empty table gives an empty one; other columns than those of
documents are left behind by the first stage. Ids are never changed, and null ones are ids of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import fingerprint, mark, release, table, written
from folio.llm.line_dedup import dedup_lines
from folio.llm.mixing import mix
from folio.llm.near_dup import near_duplicates
from folio.llm.packing import pack
from folio.llm.quality import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any other; repeated rows share their fate."""
    return classify(docs, docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. A null text is one empty line, and comes out empty;
    a document whose lines all go stays, with an empty text."""
    out = dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, and every document without words.

    The one is the first by id (null ids last), then by the text's hash; of repeated rows of
    that id and text the first by the other columns."""
    ids = ["doc_id", "t1", "t2"]
    groups = near_duplicates(docs.select("doc_id", "text")).where("n_shingles > 0")
    found = written(groups.groupBy("component", *ids).agg(F.count("*").alias("n")), "near-ids")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ids, "n")).alias("x"))
    first = written(first.select("component", *[F.col(f"x.{c}").alias(f"_{c}") for c in (*ids, "n")]), "near-first")
    t1, t2 = fingerprint(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    theirs = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2"))
    gone = found.join(first, same, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in ids])
    repeated = first.where("_n > 1").select(*[f"_{c}" for c in ids])
    if not repeated.limit(1).count():
        return docs.join(written(gone, "near-gone"), theirs, "left_anti").select(*COLUMNS)
    alone = docs.join(written(gone.unionByName(repeated), "near-gone"), theirs, "left_anti").select(*COLUMNS)
    rest = [c for c in COLUMNS if c != "doc_id"]
    ordered = F.struct(*[x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    once = docs.join(repeated, theirs).groupBy("_doc_id", "_t1", "_t2").agg(F.min(ordered).alias("x"))
    return alone.unionByName(once.select(F.col("_doc_id").alias("doc_id"), *[f"x.{c}" for c in rest]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2, ... share 150 % of all words; a document comes twice at most. A null source comes last;
    rows equal in every column share their copies, and rows without words are taken as their place in the queue says."""
    return mix(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins of 4,096 words that hold them. Every row is placed: repeated
    ones in different bins, a null or empty text as its end mark alone."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dup", near_dups), ("mixing", mixture), ("packing", packed)]
#: SQL can't express the classifier; the rows of run() are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage has put into the shared folder goes as soon as its own rows are written,
    and those as soon as the next stage's are; the last table stays for the caller."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since)
    return docs
