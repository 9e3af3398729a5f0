"""Target-distribution importance resampling: hashed word n-grams weigh each document towards a target corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import table, written
from folio.llm.shingles import blocks

#: Bytes of text that are worked on together (a longer text alone), and words whose features are made at once.
PIECE, WORDS = 1 << 20, 1 << 18
#: Features longer than this many bytes go through zlib one by one: a matrix of a few long rows saves nothing.
LONG = 256
_POLY = 0xEDB88320  # fixed value: CRC-32's polynomial, reversed


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    return c


TABLE = _crc_table()
#: Bytes of a word once A-Z are lower-cased: all but [\x00-\x2F\x3A-\x60\x7B-\x7F].
_WORD = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


def _by_length(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length, and the places that have it."""
    length = length.astype(np.uint16 if length.max(initial=0) < 1 << 16 else np.int64)  # short numbers are sorted by digits
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for i, n in enumerate(sizes.tolist()):
        yield n, order[first[i] : first[i + 1] if i + 1 < len(first) else len(order)]


def crc_columns(a: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices a[start : start + length]: slices of equal length are the rows of a
    matrix, and all rows' CRCs take in one column at a time."""
    out = np.zeros(len(start), np.uint32)
    for n, rows in _by_length(length):
        if n > LONG:
            raw = memoryview(a)
            out[rows] = [zlib.crc32(raw[s : s + n]) for s in start[rows].tolist()]
            continue
        for part in np.array_split(rows, max(1, -(-len(rows) * n // (4 * PIECE)))):
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in a[start[part] + np.arange(n)[:, None]]:
                crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def _distinct(a: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct slice of a, and the number of its slice for each one given."""
    firsts, number, made = [np.zeros(0, np.int64)], np.zeros(len(start), np.int64), 0
    for n, rows in _by_length(length):
        if n > LONG:
            seen: dict[bytes, int] = {}
            own = np.array([seen.setdefault(a[s : s + n].tobytes(), len(seen)) for s in start[rows].tolist()])
        else:  # eight bytes after the other: the number of what came before, with the next eight
            wide = np.zeros((len(rows), -(-n // 8) * 8), np.uint8)
            wide[:, :n] = a[start[rows][:, None] + np.arange(n)]
            own = np.zeros(len(rows), np.int64)
            for eight in wide.view(np.uint64).T:
                _, next_ = np.unique(eight, return_inverse=True)
                _, own = np.unique(own * (next_.max() + 1) + next_, return_inverse=True)
        at = np.unique(own, return_index=True)[1]
        firsts.append(rows[at])
        number[rows] = own + made
        made += len(at)
    return np.concatenate(firsts), number


def _word_places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased and side by side; start, end and text number of each word in them."""
    raw = [t.encode("utf-8").lower() if t else b"" for t in texts]  # lower() of bytes changes A-Z only
    a = np.frombuffer(b" ".join(raw), np.uint8)
    edge = np.diff(np.concatenate([[False], _WORD[a], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, start, end, np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")


def features(texts: list[str | None], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features (runs of one and of two words) of the whole texts, the number of each feature's text, and
    those of the words among them; WORDS words at a time, and the one that follows for its pair."""
    a, starts, ends, owners = _word_places(texts)
    for at in range(0, len(starts), WORDS):
        start, size, owner = starts[at : at + WORDS + 1], (ends - starts)[at : at + WORDS + 1], owners[at : at + WORDS + 1]
        first, word = _distinct(a, start, size)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair, pairs = np.unique(word[same] * len(first) + word[same + 1], return_inverse=True)
        left, right = (first[x] for x in np.divmod(pair, len(first)))
        wide = size[left] + 1 + size[right]
        begin = np.cumsum(wide) - wide
        b = np.full(int(wide.sum()), 0x20, np.uint8)  # the distinct pairs' bytes side by side: word, space, word
        for words, to in ((left, begin), (right, begin + size[left] + 1)):
            n = size[words]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            b[np.repeat(to, n) + step] = a[np.repeat(start[words], n) + step]
        ones = crc_columns(a, start[first], size[first]) % np.uint32(n_buckets)
        twos = crc_columns(b, begin, wide) % np.uint32(n_buckets)
        yield np.concatenate([ones[word[:WORDS]], twos[pairs]]).astype(np.int64), np.concatenate([owner[:WORDS], owner[same]]), owner[:WORDS]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), PIECE):
            yield batch.slice(part.start, part.stop - part.start)


def bucket_counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n of the features of docs(text): a task adds up its own texts, so at most n_buckets rows leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for part in _pieces(batches):
            for bucket, _, _ in features(part.column("text").to_pylist(), n_buckets):
                total += np.bincount(bucket, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int) -> list[int]:
    """For each bucket floor(1000 ln((t + 1) (S + n_buckets) / ((s + 1) (T + n_buckets)))), with s of S features of docs
    and t of T of target in it: n_buckets numbers for the driver."""
    both = [bucket_counts(d, n_buckets).withColumn("side", F.lit(i)) for i, d in enumerate((docs, target))]
    table_ = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    n = both[0].unionByName(both[1]).groupBy("bucket").agg(*[F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).cast("double").alias(c) for i, c in enumerate("st")])
    n = written(table_.join(n, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "st"]), "gain-counts")
    sums = n.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + float(n_buckets)) / ((F.col("s") + 1) * (F.col("all_t") + float(n_buckets)))
    found = n.join(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")).collect()
    out = [0] * n_buckets
    for r in found:
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row of docs(doc_id, text); ids stay Arrow columns and come through whole."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for part in _pieces(batches):
            n, words, total = np.zeros((3, part.num_rows), np.int64)
            for bucket, owner, own in features(part.column("text").to_pylist(), len(table_)):
                n += np.bincount(owner, minlength=len(n))
                words += np.bincount(own, minlength=len(n))
                np.add.at(total, owner, table_[bucket])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(words), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "n_words", "weight"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times the Gumbel variate of an id: reruns draw the same."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def _ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows with `rank` (1, 2, ... by score downwards, ties to the smaller doc_id), null beyond `draw`.

    A range shuffle puts each range of (score, doc_id) into one partition, with a salt, so that
    many rows of one id and score may be split too; a row's rank is its place in its sorted
    partition behind the partitions before. One number for each partition is broadcast."""
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_salt")]
    at = F.monotonically_increasing_id()
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("_salt").withColumns({"_part": F.shiftright(at, 33), "_no": at.bitwiseAND((1 << 33) - 1)}), "drawn-order")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + F.col("_no") + 1
    return dealt.join(F.broadcast(offsets), "_part").select(*rows.columns, F.when(rank <= draw, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs(doc_id, text): those with a rank are drawn.

    A document's weight is the floored mean of its features' gains towards target(text), and its
    score adds Gumbel noise of its id, so that the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). floor(percent * N / 100) of the N documents
    with `least_words` words or more are drawn.

    Features are counted over all rows and whole texts, in two passes: counts, then weights.
    Distinct words and pairs of about a megabyte of text at a time are grouped by their length
    into byte matrices, whose CRCs take in a column at a time. A null or empty text has no
    features and weight 0; a null id counts as no digits and comes last among ties; repeated
    rows are rows of their own, with ranks next to each other; an empty table gives an empty
    one, an empty target is one without features. Other columns aren't read. No text is
    shuffled; a task holds an Arrow batch and one piece, or one text.
    """
    rows = weights(docs, gains(docs, target, n_buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows, "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    ranked = _ranked(able, able.count() * percent // 100)
    out = ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH RECURSIVE k AS (SELECT range AS b, range AS c, 0 AS i FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLY}) ELSE c >> 1 END, i + 1 FROM k WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM k WHERE i = 8),
w AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {_SQL_WORDS} FROM benchmark),
f AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(CAST(len(ws) AS BIGINT) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM d, crc),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT r, count(*) AS n, CAST(floor(sum(gain) / count(*)::DOUBLE) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
s AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS able,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN m USING (r) WHERE side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= (SELECT count(*) FROM s WHERE able) * 25 // 100 THEN k END AS rank FROM o
"""
