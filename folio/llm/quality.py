"""Quality classifier by compression: dictionaries of good and bad text, and a calibrated size difference."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import table

#: Bounds of what the classifier is fitted on: labelled rows of each class, and bytes of their texts (the text that passes the bound is the last).
FIT_ROWS, FIT_BYTES = 2_000, 16 << 20
#: Size of a dictionary, compression level, and folds of the rows that the curve is fitted over.
DICT_BYTES, LEVEL, FOLDS = 65_536, 3, 3


@dataclass(frozen=True)
class Dictionaries:
    """Content of the dictionaries of good and of bad text; empty: none."""

    good: bytes
    bad: bytes

    def packers(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        """Compressors with the good and with the bad dictionary, for use in one thread."""
        return _packer(self.good), _packer(self.bad)


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, and the logistic curve from the size difference to a probability of class 1."""

    words: Dictionaries
    slope: float
    intercept: float

    def curve(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.intercept, -30, 30)))


def _packer(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(content)  # of a trained dictionary, or of raw content
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def differences(packers: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor], texts: list[str | None]) -> np.ndarray:
    """(size under bad - size under good) / sqrt(bytes + 1) of each whole text."""
    good, bad = packers
    raw = [(t or "").encode() for t in texts]
    return np.array([(len(bad.compress(r)) - len(good.compress(r))) / np.sqrt(len(r) + 1) for r in raw])


def _dictionary(samples: list[bytes], total: int) -> bytes:
    """A zstandard dictionary trained on about `total` bytes of the samples; where they are too few to train on, their last bytes themselves."""
    chosen, n = [], 0
    for s in samples:
        chosen.append(s)
        n += len(s)
        if n >= total:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, chosen).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(chosen)[-DICT_BYTES:]


def build_dictionaries(good: list[str], bad: list[str]) -> Dictionaries:
    """From equal bytes of both classes (the smaller class gives the bound), so that neither compresses better for its size."""
    raw = [[b for t in texts if (b := t.encode())] for texts in (good, bad)]
    total = min(sum(map(len, r)) for r in raw)
    return Dictionaries(*(_dictionary(r, total) for r in raw)) if total else Dictionaries(b"", b"")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of most likelihood with a slight pull to 0, by Newton's steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """doc_id, text, quality of the rows to fit on: of each class the first by hash of the id, FIT_ROWS and about FIT_BYTES of them at most."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for q in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * FIT_ROWS rows at most
    once = docs.where("text IS NOT NULL").join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    before = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = once.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < FIT_BYTES)
    rows = held.select("doc_id", "text", "quality").toPandas()
    return rows.sort_values("doc_id", key=lambda s: s.map(lambda i: zlib.crc32(f"fit {i}".encode())), ignore_index=True)


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on labels(doc_id, quality) of docs(doc_id, text).

    Of each class the FIT_ROWS labelled ids that come first by hash are used, as far as
    their whole texts have about FIT_BYTES; this bounded sample is all that goes to the driver.
    The curve is fitted on differences of every row under dictionaries of the other FOLDS - 1
    folds, then the dictionaries are built from all rows. Labels other than 0 and 1, null ids
    and null texts are left out; an id with several labels counts as the lowest of them, one
    with several texts as the least of them. Where a class has no row, or only one with text, the score is the
    smoothed share of class 1 (0.5 without labels), as there is nothing to compare.
    """
    rows = _sample(docs, labels)
    y = rows["quality"].to_numpy(float)
    texts = rows["text"].tolist()
    pick = lambda keep, q: [t for t, k, c in zip(texts, keep, y, strict=True) if k and c == q]
    fold, x = np.zeros(len(y), int), np.zeros(len(y))
    for q in (0, 1):  # folds of equal shares of each class
        own = np.flatnonzero(y == q)
        fold[own] = np.arange(len(own)) % FOLDS
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(Dictionaries(b"", b""), 0.0, float(np.log(p / (1 - p))))
    for k in range(FOLDS):
        own = fold == k
        x[own] = differences(build_dictionaries(pick(~own, 1), pick(~own, 0)).packers(), [t for t, o in zip(texts, own, strict=True) if o])
    every = np.ones(len(y), bool)
    return QualityModel(build_dictionaries(pick(every, 1), pick(every, 0)), *_logistic(x, y))


def quality_score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Probability of class 1 of each whole text; null counts as empty. The model, about 2 * DICT_BYTES, is broadcast;
    a task makes its compressors once."""
    shared = spark.sparkContext.broadcast((model.words.good, model.words.bad, model.slope, model.intercept))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad, slope, intercept = shared.value
        own = QualityModel(Dictionaries(good, bad), slope, intercept)
        packers = own.words.packers()
        for texts in batches:
            yield pd.Series(own.curve(differences(packers, texts.tolist())))

    return score(text)


def learnable(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a row may be learned from: crc32(doc_id as text) mod folds is not `held`; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))


def classify(docs: DataFrame, fit_on: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` (1 from the threshold on), replacing columns of these names.

    Every row is scored by its whole text alone; repeated rows get equal scores, an empty
    table stays empty. Labels of the held-out fold (crc32 mod 5 = 0) are never learned from.
    """
    model = fit_quality(fit_on.select("doc_id", "text"), labels.select("doc_id", "quality").where(learnable(F.col("doc_id"), 5, 0)))
    scored = docs.drop("score", "predicted").withColumn("score", quality_score(docs.sparkSession, model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
