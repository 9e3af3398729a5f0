"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import table
from folio.llm.quality import learnable

#: Buckets of n-grams, code points scored at once, and about how many documents of each language are learned from.
BUCKETS, BLOCK, FIT_DOCS = 1 << 15, 500_000, 3_000
ORDERS = (1, 2, 3)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about BLOCK code points: the buckets (orders x positions), where each piece
    begins, and the row it is of. A longer text is cut into overlapping pieces whose grams add up to its own."""
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        low = f" {(t or '').lower()} "
        for at in range(0, max(1, len(low) - 2), BLOCK):
            held.append(low[at : at + BLOCK + 2])
            owner.append(i)
            size += len(held[-1])
            if size >= BLOCK:
                yield (*_grams(held), np.array(owner))
                held, owner, size = [], [], 0
    if held:
        yield (*_grams(held), np.array(owner))


def _grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in pieces])
    h, out = np.zeros(len(c), np.uint64), np.empty((len(ORDERS), len(c)), np.int32)
    for k in range(len(ORDERS)):  # the k-th row: grams of k + 1 code points
        h = h.copy()
        h[: len(c) - k] += (c[k:] + np.uint64(k + 1)) * _MULTIPLIERS[k]
        out[k] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int32)
    out[:, ends - 1] = BUCKETS  # grams that would run over a piece's end: a bucket that weighs nothing
    out[:, ends - 2] = BUCKETS
    return out, np.concatenate([[0], ends[:-1]])


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over docs(text, lang): each task adds up its own, Spark the tasks'."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                n = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for grams, _, _ in _pieces(texts.tolist()):
                    n += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
        for lang, n in held.items():
            at = np.flatnonzero(n[:BUCKETS])
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})

    return docs.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix of log-probabilities (bucket x language), of docs(doc_id, text, lang).

    About FIT_DOCS documents of each language are learned from, chosen by the hash of their
    id; the driver gets the counts of BUCKETS buckets for each language. Priors are even.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    rates = {r["lang"]: min(1.0, FIT_DOCS / r["n"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in rates.items()])
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    langs = sorted(rates)
    counts = np.zeros((BUCKETS + 1, len(langs)))
    rows = gram_counts(sample).toPandas()
    counts[rows["bucket"], rows["lang"].map(langs.index)] = rows["n"]
    prob = np.log((counts[:BUCKETS] + 0.5) / (counts[:BUCKETS].sum(0) + 0.5 * BUCKETS))
    return langs, np.concatenate([prob, np.zeros((1, len(langs)))]).astype(np.float32)


def language(spark, langs: list[str], prob: np.ndarray, text: Column) -> Column:
    """struct<lang, score> of each whole text: the likeliest language and its posterior probability."""
    shared = spark.sparkContext.broadcast(prob)  # BUCKETS * languages * 4 bytes

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            total = np.zeros((len(texts), len(langs)))
            for grams, begins, owner in _pieces(texts.tolist()):
                per = sum(shared.value[g] for g in grams)
                np.add.at(total, owner, np.add.reduceat(per, begins, axis=0, dtype=np.float64))
            best = total.argmax(1)
            post = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
            yield pd.DataFrame({"lang": np.array(langs, object)[best], "score": post})

    return predict(text)


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """docs with `lang_pred` and `score` (columns of these names are replaced).

    `und` with score 0 where the text is null or has no letter (\\p{L}), and everywhere if
    there is nothing to learn from. Equal texts get equal values; lang, source and doc_id are
    no inputs of a prediction. An empty table stays empty, other columns pass through.
    """
    langs, prob = fit_languages(learn_from.select("doc_id", "text", "lang"))
    docs = docs.drop("lang_pred", "score")
    if not langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select(F.struct("*").alias("row"), has.alias("has"), language(docs.sparkSession, langs, prob, F.col("text")).alias("p"))
    return out.select("row.*", F.when(F.col("has"), F.col("p.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("has"), F.col("p.score")).otherwise(0.0).alias("score"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.drop("lang"), docs.where(learnable(F.col("doc_id"), 4, 2)))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
