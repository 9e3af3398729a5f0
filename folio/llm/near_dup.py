"""Near-duplicate documents: SetSketch registers, bands, joint likelihood, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fingerprint, table, written
from folio.llm.shingles import M, Shingler, band_keys, blocks, likely, mix64, sketch

#: Registers in a band. 32 bands of 5 miss a pair of similarity 0.8 once in 300,000 cases.
ROWS = 5
#: Members of a bucket up to which all pairs across components are tried at once; block of the exact
#: tiles beyond; members tried against a larger bucket in one round, and rounds before the tiles.
SMALL, TILE = 24, 1_000
#: Bits of the filter that goes before the shuffle of texts: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Shingles in a block of a tile: long texts make smaller blocks.
TILE_SHINGLES = 2_000_000
PIVOTS, PIVOT_ROUNDS = 4, 2


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t1, t2 (of the text), n (shingles), s1, s2 (of the set), registers, bands of each row.

    Ids stay Arrow columns, so that large ones beside nulls come through whole. A task holds one
    Arrow batch (64 MB by Spark's default) and the sets of a million characters or of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for part in blocks(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 1_000_000):
                p = batch.slice(part.start, part.stop - part.start)
                sets = [shingler.set_of(t) for t in p.column("text").to_pylist()]
                regs = sketch(sets)
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([mix64(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(list(band_keys(regs, ROWS)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([p.column(c) for c in ("doc_id", "t1", "t2")] + own, names=["doc_id", "t1", "t2", "n", "s1", "s2", "registers", "bands"])

    t1, t2 = fingerprint(F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", t1.alias("t1"), t2.alias("t2"))
    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, registers binary, bands array<long>")


def _maybe(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose registers don't rule out a similarity of `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                yield pdf.loc[likely(x, y, pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float), least), ["a", "b"]]

    for s in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}")), s)
    return pairs.mapInPandas(run, "a long, b long")


def _sifted(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows whose t1 falls on a bit that a t1 of used sets: all that a join needs, and few others.

    The bitmap has FILTER_BITS bits and comes as rows of 4 KB, so its broadcast has a fixed bound; as
    it fills up it lets more rows pass, but never stops one that is needed."""
    spot = F.pmod("t1", F.lit(FILTER_BITS))
    bits = used.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    at = F.bitmap_bit_position(F.col("spot"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    found = rows.withColumn("spot", spot).withColumn("part", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "part")
    return found.where(hit).select(*rows.columns)


def _texts(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the classes that share a bucket with another: what is verified later reads only these."""
    used = written(classes.select("node", "t1", "t2").join(rows.select("node").distinct(), "node", "left_semi"), "near-used")
    t1, t2 = fingerprint(F.coalesce("text", F.lit("")))
    found = _sifted(docs.select("text", t1.alias("t1"), t2.alias("t2")), used).join(used, ["t1", "t2"])
    return written(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs with den * |intersection| >= num * |union|, on the full shingle sets. Texts
    travel, not sets, as they are smaller, and stay in their Arrow batch; a task holds two sets,
    and that of the last `a` is kept for its next pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, a = Shingler(k), None, None
        for batch in batches:
            keep = []
            for node, x, y in zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
                if node != last:
                    last, a = node, shingler.set_of(x.as_py())
                keep.append(_linked(a, shingler.set_of(y.as_py()), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = texts.join(written(used, "near-used"), "node", "left_semi")
    for s in "ba":
        pairs = pairs.join(held.select(F.col("node").alias(s), F.col("text").alias(f"s{s}")), s)
    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of the nodes of edges(a, b): label is the least node of the component.

    Rounds of least neighbour's label, then label of label, until nothing changes; every round
    is a written table. `labels` of earlier edges are merged in.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
    if labels is not None:
        old = labels.where("node <> label")
        both = both.union(old.select("node", "label")).union(old.select("label", "node"))
    both = written(both.distinct(), "near-links")
    now = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "near-labels")
    while True:
        near = both.join(now.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("label"))
        step = written(now.union(near).groupBy("node").agg(F.min("label").alias("label")), "near-step")
        up = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = written(up.select("node", F.coalesce("next", "label").alias("label")), "near-labels")
        if not new.join(now.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count():
            return new
        now = new


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _likely_in_tile(lo: pd.DataFrame, hi: pd.DataFrame, least: float) -> Iterator[tuple[int, int]]:
    """Places (in lo, in hi) of the members whose labels differ and whose registers don't rule out a similarity of `least`."""
    x, y = (np.frombuffer(b"".join(d["registers"]), np.uint16).reshape(-1, M) for d in (lo, hi))
    ll, hl = lo["label"].to_numpy(), hi["label"].to_numpy()
    band = int(np.flatnonzero(band_keys(x[:1], ROWS)[0] == lo["key"].iat[0])[0]) if len(x) else 0
    for at in range(0, len(x), 64):
        near = (x[at : at + 64, None, :] == y[None]).sum(2) >= 0.55 * M
        r, c = np.nonzero(near & (ll[at : at + 64, None] != hl[None]))
        # a pair that agrees in an earlier band too is left to the bucket of that band
        before = (x[at + r, : band * ROWS] == y[c, : band * ROWS]).reshape(len(r), band, ROWS).all(2).any(1)
        r, c = r[~before], c[~before]
        ok = likely(x[at + r], y[c], lo["n"].to_numpy(float)[at + r], hi["n"].to_numpy(float)[c], least)
        yield from zip((at + r[ok]).tolist(), c[ok].tolist(), strict=True)


def _tiles(rows: DataFrame, classes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links across components in buckets of any size: each bucket is dealt into blocks of about
    TILE members (fewer, if their texts are long), and each pair of blocks is one group, so a task holds two blocks.
    Registers go through all tiles first, and say which members may have a partner in which tile;
    only the texts of those are sent to it, where the likely pairs are verified by their sets.
    What a tile has already joined is skipped, so it returns fewer links than it has labels."""
    rows = rows.join(classes.select("node", "n", "registers"), "node")
    held = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(held, "key")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = written(rows.withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j")}).drop("blocks", "j"), "near-tiles")

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf[pdf["i"] == pdf["p"]], pdf[pdf["i"] == pdf["q"]]
        pairs = list(_likely_in_tile(lo, hi, num / den))
        found = {lo["node"].iat[r] for r, _ in pairs} | {hi["node"].iat[c] for _, c in pairs}
        return pdf.loc[pdf["node"].isin(found), ["key", "p", "q", "node"]]

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf[pdf["i"] == pdf["p"]], pdf[pdf["i"] == pdf["q"]]
        shingler, sets, up, out = Shingler(k), {}, {}, []
        text = dict(zip(pdf["node"], pdf["text"], strict=True))

        def of(node: int) -> np.ndarray:
            if node not in sets:
                sets[node] = shingler.set_of(text[node])
            return sets[node]

        def top(label: int) -> int:
            while up.setdefault(label, label) != label:
                up[label] = label = up[up[label]]
            return label

        ll, hl = lo["label"].to_numpy(), hi["label"].to_numpy()
        for r, c in _likely_in_tile(lo, hi, num / den):
            if (s := top(ll[r])) != (t := top(hl[c])) and _linked(of(a := lo["node"].iat[r]), of(b := hi["node"].iat[c]), num, den):
                up[s] = t
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    at = ["key", "p", "q"]
    some = written(rows.groupBy(*at).applyInPandas(sift, "key long, p int, q int, node long"), "near-sifted")
    return rows.join(some, [*at, "node"]).join(texts, "node").groupBy(*at).applyInPandas(tile, "a long, b long")


def _against_pivots(active: DataFrame) -> DataFrame:
    """Pairs (a, b) of a few members of each bucket's largest component with the bucket's members of others.

    The members are those that come first by hash, so that buckets of the same texts choose the same."""
    cells = active.groupBy("key", "label").agg(F.count("*").alias("m"), *[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node")).alias(f"p{i}") for i in range(PIVOTS)])
    largest = cells.groupBy("key").agg(F.max(F.struct("m", "label", *[f"p{i}" for i in range(PIVOTS)])).alias("x"))
    pivots = written(largest.select("key", F.col("x.label").alias("pl"), F.array_distinct(F.array(*[F.col(f"x.p{i}.node") for i in range(PIVOTS)])).alias("pivots")), "near-pivots")
    tries = active.join(pivots, "key").where("label <> pl").select("node", F.explode("pivots").alias("pivot"))
    return tries.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, t1, t2, component for every row of docs(doc_id, text).

    Two texts are linked when den * |A & B| >= num * |A | B| for their sets of k-word shingles
    (A-Z lower-cased; a shorter text is one shingle; without words: none, and no link).
    component_id is the least doc_id reachable; kept says that it is the row's own. Repeated
    rows share one component; of rows with the same least id all are kept; a null id is
    never the least unless the component has no other, and then it is kept only if it stands
    for itself (no words). Ids of any size come through whole. An empty table gives no rows. Other columns aren't read. component
    numbers the components whatever their ids (null without words), so that those of null ids
    or of repeated ids can be told apart.

    Rows with equal sets are one class, so copies cost nothing beyond their sketch. In a
    bucket of equal bands every class is first tried against the bucket's least class; what
    then lies in different components is tried further: all pairs of a small bucket, a few
    members of the largest component against the others in a large one, and at last exact
    tiles. Pairs inside a component are never tried: they change nothing.
    """
    least = num / den
    all_ = written(sketches(docs, k), "near-sketches")
    one = all_.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("root"), *[F.first(c).alias(c) for c in ("n", "t1", "t2", "registers", "bands")])
    classes = written(one.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    members = classes.select("node", F.explode("bands").alias("key"))
    leads = written(members.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1"), "near-leads")
    rows = written(members.join(leads, "key"), "near-buckets")
    texts = _texts(docs, classes, rows)

    def linked(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        some = written(_maybe(written(pairs.distinct(), "near-pairs"), classes, least), "near-likely")
        return joined(_verified(some, texts, k, num, den), labels) if some.limit(1).count() else labels

    def joined(edges: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        edges = written(edges, "near-edges")
        return components(edges, labels) if edges.limit(1).count() else labels

    def open_buckets(active: DataFrame, labels: DataFrame | None) -> DataFrame:
        marked = written(_labelled(active, labels), "near-marked")
        several = marked.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).where("l0 <> l1").select("key", "c")
        return written(marked.join(written(several, "near-several"), "key"), "near-open")

    labels = linked(rows.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")), None)
    active = open_buckets(rows.select("key", "node"), labels)
    small = active.where(F.col("c") <= SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = small.join(other, "key").where("node < b AND label <> lb").select(F.col("node").alias("a"), "b")
    active = active.where(F.col("c") > SMALL).drop("c")
    for _ in range(PIVOT_ROUNDS):
        labels = linked(pairs.unionByName(_against_pivots(active)), labels)
        active = open_buckets(active.select("key", "node"), labels).drop("c")
        if not active.limit(1).count():
            break
        pairs = pairs.limit(0)
    else:
        labels = joined(_tiles(active, classes, texts, k, num, den).distinct(), labels)
    own = classes.select("node", "s1", "s2", "root")
    if labels is None:
        roots = own.select("*", F.col("node").alias("label"), F.col("root").alias("component"))
    else:
        own = written(_labelled(own, labels), "near-own")
        roots = own.groupBy("label").agg(F.min("root").alias("component")).join(own, "label")
    roots = written(roots.select("s1", "s2", "label", "component"), "near-roots")
    out = all_.select("doc_id", "n", "s1", "s2", "t1", "t2").join(roots, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("doc_id") == F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept"), "t1", "t2", F.col("label").alias("component"))


def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4).drop("t1", "t2", "component")


def similarity_sql(k: int) -> str:
    leads = " || ' ' || ".join(["w", *[f"lead(w, {j}) OVER o" for j in range(1, k)]])
    return rf"""
WITH RECURSIVE a AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT doc_id, {leads} AS sh FROM w WHERE n >= {k} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, sh FROM g WHERE sh IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM a WHERE len(ws) BETWEEN 1 AND {k - 1}),
s AS (SELECT a.doc_id, count(e.sh) AS n FROM a LEFT JOIN e USING (doc_id) GROUP BY a.doc_id),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS shared FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
h AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT doc_id, n AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM s JOIN r ON r.x = doc_id GROUP BY doc_id, n
"""


SQL = similarity_sql(4)
