"""Training-data operators: SQL where it can express them, brute force, round trips and held-out accuracy elsewhere, and edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import ann, chat_format, langid, line_dedup, media, mixing, near_dup, packing, quality, registry, sharding
from folio.llm.shingles import Shingler, sketch

SF = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines long, r1 string"
LONG = " ".join(f"w{i}" for i in range(6000))
EDGE_ROWS = [
    (1, None, "en", "a", 0, 0.0, 1, "x"), (2, "", None, None, 0, 0.0, 1, "x"), (3, "  \t\n ", "en", "a", 4, 0.0, 1, "x"), (4, "One two", "de", "b", 7, 0.0, 1, "x"),
    (5, "one two", "de", "b", 7, 0.0, 1, "x"), (5, "one two", "de", "b", 7, 0.0, 1, "x"), (None, "null id here you are", None, "a", 9, 0.0, 1, "x"), (6, LONG, "fr", None, 9, 0.0, 1, "x"),
    (7, LONG + " more", "fr", "a", 9, 0.0, 1, "x"), (8, "\n\n", "fr", "a", 9, None, None, None), (9, "12 34 !!", "fr", "a", 9, None, None, None),
]


def plain(v):
    v = None if pd.isna(v) else getattr(v, "item", lambda: v)()
    return repr(int(v) if isinstance(v, float) and v.is_integer() else v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_empty_tables(spark, edge):
    none = edge.where("false")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    outs = [
        line_dedup.dedup_lines(none), near_dup.near_duplicates(none), quality.classify(none, none, spark.createDataFrame([], "doc_id long, quality int")), langid.identify(none, none),
        media.media_column(none), chat_format.format_chat(turns), packing.pack(none), mixing.queue(none), mixing.mix(none), sharding.shard(none), ann.neighbours(vec, "vec_id", "embedding", F.col("vec_id") % 50 == 0),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_lines_edge(edge):
    out = line_dedup.dedup_lines(edge, min_docs=3, batches=3).toPandas()
    assert len(out) == len(EDGE_ROWS) and {"lang", "source", "score", "r1"} <= set(out.columns)
    got = {(None if pd.isna(r.doc_id) else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.itertuples()}
    assert {(1, 1, 0, ""), (3, 2, 0, "  \t\n "), (4, 1, 1, ""), (5, 1, 1, ""), (8, 3, 0, "\n\n"), (None, 1, 0, "null id here you are")} <= got


def test_near_dup_edge(edge):
    out = near_dup.near_duplicates(edge).toPandas()
    assert len(out) == len(EDGE_ROWS)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.itertuples() if not pd.isna(r.doc_id)}
    assert by[1] == (0, 1, True) and by[3] == (0, 3, True) and by[4] == (1, 4, True) and by[5] == (1, 4, False)
    assert by[6] == (5996, 6, True) and by[7] == (5997, 6, False)


def test_near_dup_finds_chains_and_groups_beyond_small_buckets(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(90):  # more than SMALL near copies, many pairs of them under 0.8
        w = list(base)
        for j in rng.choice(120, 4, replace=False):
            w[j] = f"e{rng.integers(1_000_000)}"
        texts.append(" ".join(w))
    out = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).toPandas()
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert dict(zip(out["doc_id"], out["component_id"])) == {i: top(i) for i in range(len(sets))}


def test_filter_before_the_shuffle_keeps_all_that_is_needed(spark):
    rows = spark.range(50_000).select(F.xxhash64("id").alias("t1"), "id")
    used = rows.where("id % 20 = 3")
    got = near_dup._sifted(rows, used)
    assert got.join(used, "id", "left_semi").count() == used.count()
    assert got.count() < 1.1 * used.count()
    assert near_dup._sifted(rows, used.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    s = Shingler(3)
    a, b = s.set_of(" ".join(f"a{i}" for i in range(400))), s.set_of(" ".join(f"a{i}" for i in range(40, 440)))
    ra, rb, both = sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((ra == rb).mean() - j) < 0.15


def test_nearest_recall_and_edge(spark):
    got = ann.op2_nearest(spark, SF).toPandas()
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = n = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]])
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine["score"], s[[int(np.flatnonzero(ids == i)[0]) for i in mine["vec_id"]]], atol=1e-12)
        hits, n = hits + len(want & set(mine["vec_id"])), n + 5
    assert hits / n >= 0.9
    bad = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (50, [0.0, 1.0])]
    for names in (("vec_id", "embedding"), ("v", "d"), ("id", "asked"), ("list", "codes")):
        df = spark.createDataFrame(bad, f"{names[0]} long, {names[1]} array<float>")
        out = ann.neighbours(df, *names, F.col(names[0]) % 50 == 0)
        assert sorted(map(tuple, out.collect())) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 9)) for r in ann.neighbours(huge, "vec_id", "embedding", F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


@pytest.mark.parametrize("kind", ["wide", "copies"])
def test_nearest_where_codes_are_coarse_or_rows_are_copies(spark, kind):
    """Vectors of many components, whose codes tell little, and groups of equal vectors, of which the smallest ids count."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(8_000, 384 if kind == "wide" else 100))
    if kind == "copies":
        v[:3_200], v[3_200:4_800] = v[0], v[3_200]
        v = v[rng.permutation(len(v))]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    got = ann.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(v), 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & set(got.vec_id[got.query_id == q]))
    assert hits / 800 >= 0.93


def test_nearest_where_the_codes_decide(spark):
    """20,000 vectors without clusters: recall, how much is reranked, and independence of partitions."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(20_000, 32)).astype(np.float32)
    v[10_000:] += 0.8 * v[:10_000]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<float>")
    found = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    cost = found.agg(F.sum("reranked").alias("r"), F.sum("visited").alias("v")).first()
    assert cost["r"] < 0.1 * cost["v"] and cost["v"] < 0.9 * 200 * len(v)
    got = ann.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(v), 100):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got.vec_id[got.query_id == q]))
    assert hits / 1_000 >= 0.9
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = ann.neighbours(df.repartition(5), "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = ["query_id", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))


def test_quality_held_out_and_edge(spark, edge):
    sf = "/root/testdata/sf0.01"
    out = quality.op4_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = out[out["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]).all()
    good, bad = held["score"][held["quality"] == 1], held["score"][held["quality"] == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    scored = quality.classify(edge, edge, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")).toPandas()
    assert len(scored) == len(EDGE_ROWS) and scored["score"].between(0, 1).all() and scored["score"].nunique() == 1


def test_quality_on_few_labels_and_long_texts_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    long = docs.where("doc_id < 3").select((F.col("doc_id") + 10_000).alias("doc_id"), F.repeat("text", F.lit(300)).alias("text"))
    docs = docs.select("doc_id", "text").unionByName(long).unionByName(spark.createDataFrame([(20_000, None), (20_001, "")], "doc_id long, text string"))
    labels = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(10_000, 1), (10_001, 0), (20_000, 1)], "doc_id long, quality int"))
    model = quality.fit_quality(docs, labels.where(quality.learnable(F.col("doc_id"), 5, 0)))
    assert 10_000 in set(quality._sample(docs, labels)["doc_id"])
    out = quality.classify(docs, docs, labels).toPandas()
    assert out["score"].nunique() > 150 and out["score"].between(0, 1).all()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        good, bad = (len(p.compress(raw)) for p in model.words.packers())
        want = 1 / (1 + np.exp(-np.clip(model.slope * (bad - good) / np.sqrt(len(raw) + 1) + model.intercept, -30, 30)))
        assert abs(out["score"][out["doc_id"] == r["doc_id"]].iloc[0] - want) < 1e-12


def test_language_held_out_and_edge(spark, edge):
    sf = "/root/testdata/sf0.01"
    out = langid.op5_language_id(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    assert (out["lang_pred"] == out["lang"])[out["held_out"]].mean() > 0.97
    got = langid.identify(edge, edge).toPandas()
    und = {r.doc_id for r in got.itertuples() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8, 9} and got["score"].between(0, 1).all()


def test_language_equals_brute_force(spark):
    texts = {"de": ["der Hund und die Katze", "das ist ein Haus"], "en": ["the dog and the cat", "this is a house"], "fr": ["le chien et le chat", "c'est une maison là"]}
    learn = [(i, t, k) for k, ts in texts.items() for i, t in enumerate(ts)]
    ask = [(i, t) for i, t in enumerate(["the house", "ein Hund", "une chatte", "ß", "x" * 40, "Das Haus is une"])]
    out = langid.identify(spark.createDataFrame(ask, "doc_id long, text string"), spark.createDataFrame(learn, "doc_id long, text string, lang string")).toPandas()

    def grams(text):
        c = [ord(x) for x in f" {text.lower()} "]
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                if n > 1 or i < len(c) - 2:  # single marks: those of the text and the leading space
                    h = sum((c[i + k] + k + 1) * int(langid._MULTIPLIERS[k]) for k in range(n)) % 2**64
                    yield (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64) >> 49
    counts = {k: Counter(g for t in ts for g in grams(t) if True) for k, ts in texts.items()}
    for i, t in ask:
        held = {}
        for k, c in counts.items():
            total = sum(c.values()) + 0.5 * langid.BUCKETS
            held[k] = sum(np.log((c[g] + 0.5) / total) for g in grams(t))
        best = max(held, key=held.get)
        post = 1 / sum(np.exp(x - held[best]) for x in held.values())
        row = out[out["doc_id"] == i].iloc[0]
        assert row["lang_pred"] == best and abs(row["score"] - post) < 1e-3


def test_long_texts_are_cut_without_loss():
    text = "abc déf " * 90_000
    pieces = list(langid._pieces([text, "x"]))
    n = sum((g[0] < langid.BUCKETS).sum() for g, _, _ in pieces)
    assert len(pieces) > 1 and n == len(text) + 1 and {int(o) for _, _, w in pieces for o in w} == {0, 1}


def test_media_round_trip_and_retry(spark, edge, tmp_path):
    out = media.media_column(edge).toPandas()
    want = Counter()
    for r in EDGE_ROWS:
        raw = (r[1] or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        want[(r[0], len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out.itertuples()) == want
    media.write_media(edge, f"file://{tmp_path}/m")
    small = media.read_media(spark, f"file://{tmp_path}/m", range_bytes=8_000, batch_bytes=1)
    assert small.count() == len(EDGE_ROWS)
    media.write_media(edge.limit(2), f"file://{tmp_path}/m")  # a second commit adds to the first
    assert media.read_media(spark, f"file://{tmp_path}/m", range_bytes=9_000).count() == len(EDGE_ROWS) + 2
    names = {r["archive"] for r in small.collect()}
    assert all((tmp_path / "m" / f"{n}.idx").exists() for n in names)
    reader = media.ArchiveReader(f"file://{tmp_path}/m", 1 << 20, 1 << 20, 3)
    part = next(p for p in reader.partitions() if p.archive)

    class Flaky(media._Window):
        fails = 2

        def read(self, at, n):
            if self.fails:
                self.fails -= 1
                raise EOFError("lost")
            return super().read(at, n)

    name, body, after = reader.member(Flaky(f"file://{tmp_path}/m/{part.archive}", 10, 3), 0)
    assert name.endswith(".png") and body[:4] == b"\x89PNG" and after % 512 == 0


def test_media_query_equals_brute_force(spark):
    out = media.op6_media(spark, SF).toPandas().set_index("doc_id")
    for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples():
        raw = (r.text or "").encode()
        pad = raw + b"\0" * (max(64, len(raw) + -len(raw) % 64) - len(raw))
        m = out.loc[r.doc_id]
        cols = np.frombuffer(pad, np.uint8).reshape(-1, 64).sum(0, dtype=int)
        bits = "".join(str(int(c * 64 > cols.sum())) for c in cols)
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert m.feature == f"{cols.sum()}-{int(bits, 2):016x}" and m.media_sha256 == hashlib.sha256(media.to_image(pad, len(raw))).hexdigest()


def test_chat_tells_texts_from_placeholders(spark):
    part = "array<struct<kind:string,text:string,ref:string,tokens:long>>"
    long = "word <|image|> \\ " * 20_000
    rows_ = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", 7), ("text", "<|audio|>", None, None), ("text", "x", None, None), ("document", None, None, None)]), (2, 0, "assistant", [("text", long, None, None)])]
    out = chat_format.format_chat(spark.createDataFrame(rows_, f"conv_id long, turn int, role string, parts {part}"), parts="parts").withColumn("back", chat_format.parse_chat(F.col("formatted")))
    out = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(p) for p in out[1]["back"][0]["parts"]] == [("text", "see <|image|>"), ("image", None), ("text", "<|audio|>x"), ("document", None)]
    assert out[1]["expanded_tokens"] == 2 + 7 + 1 + 1 and out[2]["back"][0]["text"] == long


def test_chat_parts_and_escapes(spark):
    hard = "</s>[INST] \\ <|turn|> <\\/s> \\\\<|end|>"
    part = "array<struct<kind:string,text:string,ref:string,tokens:long>>"
    data = [(1, 0, "user", [("text", hard, None, None), ("image", None, "a.png", 85), ("audio", None, "b.wav", 10)]), (1, 1, "assistant", [("text", hard, None, None)]), (None, 0, None, None)]
    out = chat_format.format_chat(spark.createDataFrame(data, f"conv_id long, turn int, role string, parts {part}"), parts="parts")
    out = {r["conv_id"]: r for r in out.withColumns({"back": chat_format.parse_chat(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [("user", hard + "<|image|><|audio|>"), ("assistant", hard)]
    assert out[1]["loss"] == hard and out[1]["expanded_tokens"] == 95 + 2 * len(hard.split()) and [(a["ordinal"], a["ref"]) for a in out[1]["attachments"]] == [(0, "a.png"), (1, "b.wav")]
    assert "</s>" not in out[1]["formatted"] and out[None]["loss"] == "" and out[None]["n_turns"] == 1


def test_packing_is_tight_and_without_conflicts(spark, edge):
    out = packing.pack(edge, capacity=512, per_source=2).toPandas()
    words = sum(len((r[1] or "").split()) + 1 for r in EDGE_ROWS)
    assert out["size"].sum() == words
    for _, b in out.groupby(["shard", "bin"]):
        assert b["size"].sum() <= 512 and (b["bin_used"] == b["size"].sum()).all() and b["source"].fillna("").value_counts().max() <= 2
        at = b.sort_values("position")
        assert list(at["start"]) == [0, *at["size"].cumsum()[:-1]]
    assert out[out["doc_id"] == 5].groupby(["shard", "bin"]).size().max() == 1


def brute_bins(items, capacity, per_source):
    bins, at = [], []
    for n, s, c in items:
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and c not in b[2] and b[1][s] < per_source]
        if fit:
            i = min(fit)[1]
        else:
            bins.append([capacity, Counter(), set()])
            i = len(bins) - 1
        bins[i][0] -= n
        bins[i][1][s] += 1
        bins[i][2].add(c)
        at.append(i)
    return at


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(5)
    items = sorted(((int(rng.integers(1, 60)), int(rng.integers(4)), int(rng.integers(80))) for _ in range(400)), reverse=True)
    bins = packing.Bins(100, 2)
    assert [bins.put(*i)[0] for i in items] == brute_bins(items, 100, 2)


def test_packing_hangs_on_the_rows_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).select("doc_id", "text", "source")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(7, "same same", None)] * 60, docs.schema))
    first, second = (packing.pack(d, 2_048, shard_rows=40).toPandas() for d in (docs, docs.repartition(9, "source").orderBy(F.rand(3))))
    assert rows(first) == rows(second) and first["shard"].nunique() > 4 and first[first["doc_id"] == 7]["shard"].nunique() > 2


def test_packing_query_is_tight(spark):
    out = packing.op8_packing(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: len((r.text or "").split()) + 1 for r in docs.itertuples()}
    assert out.groupby("doc_id")["size"].sum().to_dict() == want
    used = out.groupby(["shard", "bin"])["size"].sum()
    assert used.max() <= 4_096 and (used.sum() / (4_096 * len(used)) > 0.95 or len(used) <= -(-used.sum() // 4_096) + 2)


def brute_mix(items, share=1.5, most=2):
    """items (id, source, size) with unique ids -> copies taken of each id, by the queue as it is described."""
    sources = sorted({s for _, s, _ in items}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total, copies = sum(n for _, _, n in items), []
    for s in sources:
        own, up = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, t, n in items if t == s), 0
        for j in range(most):
            for key, i, n in own:
                up += n
                copies.append(((2 * up - n) / 2 / weight[s], sources.index(s), key, j, i, n))
    taken, up = Counter(), 0
    for *_, i, n in sorted(copies):
        up += n
        taken[i] += 2 * up - n <= 2 * share * total
    return taken


def test_mixing_equals_brute_force_and_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = [(r["doc_id"], r["source"], len((r["text"] or "").split(None))) for r in docs.select("doc_id", "source", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text")).collect()]
    out = mixing.op9_mixing(spark, "/root/testdata/sf0.01").toPandas()
    want, size = brute_mix(items), {i: n for i, _, n in items}
    assert all(r.size == size[r.doc_id] and r.taken == r.size * want[r.doc_id] for r in out.itertuples())
    source = {i: s for i, s, _ in items}
    for s, g in out.groupby(out["doc_id"].map(source)):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() and g["target"].iloc[0] <= 2 * g["source_size"].iloc[0] + 1e-6
    assert abs(out["taken"].sum() - 1.5 * out["size"].sum()) <= out["size"].max()


def test_mixing_edge(spark, edge):
    plan = mixing.queue(edge).toPandas()
    assert len(plan) == 2 * len(EDGE_ROWS) and set(plan["taken"]) == {0, 1}
    taken = (plan["size"] * plan["taken"]).sum()
    assert abs(taken - 1.5 * plan["size"][plan["copy"] == 0].sum()) <= plan["size"].max()
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() == plan["taken"].sum()
    same = spark.createDataFrame([(1, "a b", "x")] * 7 + [(2, "c", "y")], "doc_id long, text string, source string")
    assert mixing.mix(same).count() == mixing.queue(same).where("taken = 1").count()


@pytest.fixture(scope="module")
def clashing(edge):
    """Columns with names that operators might use inside, and of types that can't be compared."""
    extra = {c: F.lit(f"own {c}") for c in ("_r1", "_n", "_d1", "_p", "_slot", "_total", "row", "v", "r2", "kept", "virtual", "copy", "c1", "h1", "drop", "has", "p")}
    return edge.withColumns(extra | {"m": F.create_map(F.lit("k"), F.array(F.create_map(F.lit(1), F.col("text")))), "a.b": F.lit(1)})


def test_columns_of_clashing_names_pass_through(spark, clashing):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    outs = {
        "lines": line_dedup.dedup_lines(clashing, batches=2), "lang": langid.identify(clashing, clashing), "quality": quality.classify(clashing, clashing, labels), "mix": mixing.mix(clashing),
    }
    for name, out in outs.items():
        for r in out.select(*[f"`{c}`" for c in clashing.columns if c not in ("score", "n_lines")]).collect():
            assert all(r[c] == f"own {c}" for c in ("_r1", "_n", "_d1", "_p", "_slot", "row", "v", "p")), name
            assert r["m"] == {"k": [{1: r["text"]}]} and r["a.b"] == 1
    assert packing.pack(clashing).count() >= len(EDGE_ROWS) and near_dup.near_duplicates(clashing).count() == sharding.shard(clashing, 3).count() == len(EDGE_ROWS)
    assert media.media_column(clashing).count() == len(EDGE_ROWS)


def test_line_runs_go_on_in_another_session(spark, tmp_path):
    batch = lambda xs: spark.createDataFrame([(x, -x, n) for x, n in xs], "h1 long, h2 long, n long")
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", 5, buckets=3)
    runs.add(batch([(1, 2), (2, 6), (3, 1)]))
    runs.add(batch([(1, 2), (2, 1), (4, 1)]))
    assert [len(x) for x in runs.levels] == [0, 1]  # compacted
    runs.close()
    again = line_dedup.LineRuns.open(spark, f"file://{tmp_path}/runs")
    again.add(batch([(1, 1), (4, 3)]))
    assert {tuple(r) for r in again.frequent().collect()} == {(1, -1), (2, -2)}
    plan = batch([(1, 1)]).repartition(3, "h1", "h2").join(again._read(again.levels[1][0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("Physical Plan")[1].count("Exchange") == 1  # the batch moves, the run doesn't
    again.close()


def test_sharding_laws(spark, edge):
    for docs, n in ((edge, len(EDGE_ROWS)), (spark.read.parquet(f"{SF}/documents.parquet"), 200), (spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(100)], "doc_id long, text string"), 100)):
        out = sharding.shard(docs, 8).toPandas()
        sizes = out.groupby("shard").size().reindex(range(8), fill_value=0)
        assert len(out) == n and sizes.max() - sizes.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    apart = out[out["doc_id"] < 60].groupby("shard").size()
    assert len(apart) <= 6  # 60 equal texts in shards of 12 or 13


def test_sharding_fills_no_more_shards_than_a_large_group_needs(spark):
    text = F.when(F.col("doc_id") < 350, "x").otherwise(F.col("doc_id").cast("string"))
    out = sharding.shard(spark.range(1_000).withColumnRenamed("id", "doc_id").withColumn("text", text), 8)
    assert sorted(out.where("doc_id < 350").groupBy("shard").count().toPandas()["count"]) == [100, 125, 125]
    assert set(out.groupBy("shard").count().toPandas()["count"]) == {125}


def test_sharding_follows_links_between_different_texts(spark):
    docs = [(i, f"t{i}") for i in range(400)] + [(7, "t7"), (None, "n"), (None, None)]
    rings = [(i, i // 4 * 4 + (i + 1) % 4) for i in range(200)]
    links = spark.createDataFrame([*rings, (None, 3), (3, None), (5, 9_999), (6, 6)], "a long, b long")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    out = sharding.shard(docs, 8, links=links).cache()
    rows = out.toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 403 and len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    found = sharding.cut_links(out, spark.createDataFrame(rings, "a long, b long")).first()
    at = rows.groupby("doc_id")["shard"].apply(list)
    assert found["links"] == 202 and found["cut"] == sum(x != y for a, b in rings for x in at[a] for y in at[b])
    assert found["cut"] < 101  # dealt at random, seven of eight are cut
    assert sharding.shard(docs, 8, links=links.where("a < 0")).count() == 403
    assert sharding.shard(docs.where("doc_id < 0"), 8, links=links).count() == 0


def test_sharding_votes_against_brute_force(spark):
    rng = random.Random(5)
    cells = {(g, s): rng.randint(1, 9) for g in range(12) for s in range(4) if rng.random() < 0.6}
    edges = {(a, b): rng.randint(1, 3) for a in range(12) for b in range(12) if rng.random() < 0.3}
    want = {(g, s): [n, 0] for (g, s), n in cells.items()}
    for (a, b), w in edges.items():
        for s in range(4):
            if (b, s) in cells:
                want.setdefault((a, s), [0, 0])[1] += w * cells[b, s]
    cell_rows = spark.createDataFrame([(g, -g, s, n) for (g, s), n in cells.items()], "g1 long, g2 long, label int, n long")
    edge_rows = spark.createDataFrame([(a, -a, b, -b, w) for (a, b), w in edges.items()], "a1 long, a2 long, b1 long, b2 long, w long")
    votes = sharding._votes(cell_rows, edge_rows)
    assert {(r["g1"], r["label"]): [r["n"], r["votes"]] for r in votes.collect()} == want
    leaves = {}
    for r in sharding._wishes(votes, [20] * 4, [0, 1, 3], 2).collect():
        assert r["label"] != r["best"] and r["best"] != 2 and r["n"] > 0
        leaves[r["g1"], r["label"]] = leaves.get((r["g1"], r["label"]), 0) + r["n"]
    assert leaves and all(n <= cells[k] for k, n in leaves.items())


def test_sharding_brings_links_together_without_any_slack(spark):
    out = sharding.shard(spark.createDataFrame([(i, f"t{i // 2}") for i in range(800)], "doc_id long, text string"), 16)
    cut = sharding.cut_edges(out).first()
    assert cut["edges"] == 400 and cut["cut"] <= 20 and set(out.groupBy("shard").count().toPandas()["count"]) == {50}


def test_quotas_keep_capacity():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 8))
        capacity = rng.integers(0, 50, n).tolist()
        loads = [int(rng.integers(0, c + 1)) for c in capacity]
        wishes = {}
        for a in range(n):
            left = loads[a]
            for b in range(n):
                if a != b and left and rng.random() < 0.5:
                    wishes[a, b] = int(rng.integers(1, left + 1))
                    left -= wishes[a, b]
        may = sharding.quotas(wishes, loads, capacity)
        for (a, b), f in may.items():
            assert 0 < f <= wishes[a, b]
            loads[a], loads[b] = loads[a] - f, loads[b] + f
        assert all(x <= c for x, c in zip(loads, capacity, strict=True))
    assert sharding.quotas({(0, 1): 9, (1, 2): 9, (2, 0): 9}, [10] * 3, [10] * 3) == {(0, 1): 9, (1, 2): 9, (2, 0): 9}


def test_words_of_very_long_texts_are_hashed_alike(monkeypatch):
    from folio.llm import shingles

    text = "ab Cd " * 500 + "e" * 300 + " " + "f g " * 400
    whole = Shingler(3).words(text)
    monkeypatch.setattr(shingles, "PIECE", 256)
    cut = Shingler(3).words(text)
    assert len(cut) == len(whole) == len(text.split()) and (np.delete(cut, 1000) == np.delete(whole, 1000)).all()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).toPandas()
    scored = quality.classify(docs, docs, spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert set(kept["doc_id"]) == set(scored["doc_id"][scored["score"] >= 0.3])
    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    held = defaultdict(set)
    for r in docs.toPandas().itertuples():
        for x in r.text.split("\n"):
            held[key(x)].add(r.doc_id)
    deduped = corpus_pipeline.lines(spark, docs, SF).toPandas().set_index("doc_id")
    for r in docs.toPandas().itertuples():
        ascii_only = [x for x in r.text.split("\n")]
        want = "\n".join(x for x in ascii_only if not key(x) or len(held[key(x)]) < 10)
        assert deduped.loc[r.doc_id, "text"] == want and deduped.loc[r.doc_id, "n_chars"] == len(want)


def test_pipeline_rows_equal_brute_force(spark):
    """run() on whole tables, every stage in plain Python but for the scores and the dictionaries behind them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.classify(docs, docs, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "score").toPandas()
    keep = set(scores["doc_id"][scores["score"] >= 0.3])
    rows_ = [r for r in docs.toPandas().itertuples() if r.doc_id in keep]
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for r in rows_:
        for x in (r.text or "").split("\n"):
            held[key(x)].add(r.doc_id)
    text = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not key(x) or len(held[key(x)]) < 10) for r in rows_}
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if w] for i, t in text.items()}
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    near = {i: i for i in sets}

    def top(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            near[y] = x
    alone = [i for i in text if i not in sets or top(i) == i]
    source = {r.doc_id: r.source for r in rows_}
    size = {i: len(words[i]) for i in alone}
    taken = brute_mix([(i, source[i], size[i]) for i in alone])
    want = Counter()
    for i, n in taken.items():
        for piece in range(-(-(size[i] + 1) // 4096)):
            want[i, piece, min(4096, size[i] + 1 - piece * 4096), source[i]] += n
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(out["doc_id"], out["piece"], out["size"], out["source"])) == +want
    for _, b in out.groupby(["shard", "bin"]):
        assert b["size"].sum() <= 4096 and b["doc_id"].value_counts().max() == 1 and b["source"].value_counts().max() <= 8


def test_pipeline_keeps_one_row_of_each_group_whatever_its_ids(spark):
    words = lambda x, n=30: " ".join(f"{x}{i}" for i in range(n))
    rows_ = [
        (None, words("unique"), "en", "a", 1), (None, words("other"), "en", "a", 2),  # null ids without copies
        (None, words("null"), "en", "a", 3), (None, words("null"), "de", "a", 3), (None, words("null", 31), "en", "a", 4),  # a group of null ids only
        (None, words("mixed"), "en", "a", 5), (9, words("mixed"), "en", "a", 5), (7, words("mixed", 31), "en", "a", 6),  # the least id stays
        (1, words("again"), "fr", None, 7), (1, words("again"), None, "b", 7), (1, words("again"), "fr", "b", 7), (1, words("again"), "fr", "b", 7),  # repeated rows
        (1, words("same"), "en", "a", 8),  # an id used twice
        (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, None, "en", "a", 0),  # no words: no group
    ]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in corpus_pipeline.near_dups(spark, docs, SF).collect()]
    nulls = [r for r in out if r[0] is None and r[1] and r[1].startswith("null0")]
    assert len(nulls) == 1 and nulls[0] in ((None, words("null"), "de", "a", 3), rows_[4])
    assert Counter(out) == Counter([rows_[0], rows_[1], nulls[0], rows_[7], rows_[10], rows_[12], *rows_[13:]])
    assert corpus_pipeline.near_dups(spark, docs.where("false"), SF).count() == 0


BIG = 2**53


def test_large_ids_beside_nulls_come_through_whole(spark):
    text = " ".join(f"w{i}" for i in range(40))
    data = [(None, text, "a"), (BIG + 1, text, "a"), (BIG + 3, text + " x", "a"), (BIG + 5, "other words here", None), (None, None, "b"), (BIG + 7, "", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1)
    near = {tuple(r) for r in near_dup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()}
    assert near == {(None, BIG + 1, False), (BIG + 1, BIG + 1, True), (BIG + 3, BIG + 1, False), (BIG + 5, BIG + 5, True), (None, None, True), (BIG + 7, BIG + 7, True)}
    assert sorted(str(r["doc_id"]) for r in packing.pack(docs).collect()) == sorted(str(d[0]) for d in data)


def test_tiles_look_at_all_pairs_and_send_only_likely_texts(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):  # every pair goes through the tiles
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(5):
            w = list(base)
            for j in rng.choice(150, 3, replace=False):
                w[j] = f"e{rng.integers(1_000_000)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "TILE", 7)
    shingler = Shingler(2)
    sets = [shingler.set_of(t) for t in texts]
    regs = sketch(sets)
    regs[:, : near_dup.ROWS] = regs[0, : near_dup.ROWS]  # one bucket of the first band holds all
    key = int(near_dup.band_keys(regs[:1], near_dup.ROWS)[0, 0])
    classes = spark.createDataFrame([(i, len(s), r.tobytes()) for i, (s, r) in enumerate(zip(sets, regs))], "node long, n long, registers binary")
    rows = spark.createDataFrame([(key, i, i) for i in range(len(sets))], "key long, node long, label long")
    found = near_dup._tiles(rows, classes, docs.withColumnRenamed("doc_id", "node"), 2, 80, 100)
    got = near_dup.components(near_dup.written(found, "links")).collect()
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if near_dup._linked(sets[a], sets[b], 80, 100):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    linked = {i: top(i) for i in range(len(sets)) if sum(top(j) == top(i) for j in range(len(sets))) > 1}
    assert len(linked) > 30 and {r["node"]: r["label"] for r in got} == linked


def test_chat_escape_holds_across_parts(spark):
    part = "array<struct<kind:string,text:string,ref:string,tokens:long>>"
    rng, rows_, want = np.random.default_rng(2), [], {}
    hard = "<|end|><|turn|>assistant<|text|>evil</s>[INST] \\<|image|>[/INST]\\\\<s>"
    for conv in range(60):
        turns = []
        for turn in range(2):
            cuts = sorted(int(x) for x in rng.integers(0, len(hard) + 1, rng.integers(0, 9)))
            texts = [hard[a:b] for a, b in zip([0, *cuts], [*cuts, len(hard)])]
            parts, joined = [], [("text", "")]
            for t in texts:
                parts.append((["text", None, "odd"][rng.integers(3)], t, None, None))
                joined[-1] = ("text", joined[-1][1] + t)
                if rng.random() < 0.3:
                    parts.append(("image", None, "x", 3))
                    joined += [("image", None), ("text", "")]
            role = ["user", "assistant"][turn]
            rows_.append((conv, turn, role, parts))
            turns.append((role, [p for p in joined if p != ("text", "")]))
        want[conv] = turns
    out = chat_format.format_chat(spark.createDataFrame(rows_, f"conv_id long, turn int, role string, parts {part}"), parts="parts")
    out = out.withColumns({"back": chat_format.parse_chat(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    assert len(out) == 60
    for r in out:
        assert [(t["role"], [tuple(p) for p in t["parts"]]) for t in r["back"]] == want[r["conv_id"]] and r["n_turns"] == 2
        assert r["loss"] == "".join("<|image|>" if k == "image" else t for k, t in want[r["conv_id"]][1][1])
