"""WARC bundles, fill-in-middle and importance resampling: round trips, brute force and edge cases."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import fim, importance, warc
from tests.llm.test_operators import EDGE, EDGE_ROWS, SF

PAGES = "page_id long, url string, html string, record_id int, size string, k string"
BIG = 2**53 + 1


def b32(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE)


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é世</p>" * 300_000
    rows = [(1, "http://a/", "x", 1, "s", "k"), (2, "http://b/\r\nWARC-Type: x", "x", 1, "s", "k"), (BIG, None, long, 1, None, None), (BIG + 2, "u", long, 1, None, None), (None, "n", long, 1, None, None)]
    rows += [(3, "e", None, 1, None, None), (4, "e", "", 1, None, None), (None, None, "only null ids", 1, None, None), (None, None, "only null ids", 1, None, None)] + [(9, "same", "again and again", 1, None, None)] * 7
    return spark.createDataFrame(rows, PAGES)


def brute_warc(rows, least):
    out, by = [], {}
    for page, url, html, *_ in rows:
        by.setdefault(html or "", []).append(page)
    for html, ids in by.items():
        n, digest = len(html.encode()), b32(html)
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(order):
            first = k == 0 or n < least
            out.append((i, n, digest, "response" if first else "revisit", None if first else order[0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 2, 10**9])
def test_warc_equals_brute_force(spark, pages, least):
    got = warc.archived(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_warc([tuple(r) for r in pages.collect()], least)


def test_warc_of_no_pages(spark, pages):
    assert warc.archived(pages.where("false")).count() == 0


def test_records_are_found_by_id_and_only_their_frames_are_read(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, frame_bytes=4_000)
    every = {r["record_id"]: r for r in warc.read_warc(spark, path, range_bytes=5_000).collect()}
    at = warc.places(spark, path).collect()
    assert len(every) == pages.count() and {r["record_id"] for r in at} == set(every) and len({(r["archive"], r["frame"]) for r in at}) > 2
    some = spark.createDataFrame([(k,) for k in sorted(every)[::2]] + [("urn:uuid:00000000-0000-0000-0000-000000000000",)], "record_id string")
    got = warc.fetch(spark, path, some).collect()
    assert len(got) == len(sorted(every)[::2]) and all(tuple(r) == tuple(every[r["record_id"]]) for r in got)
    assert {r["refers_to"] for r in every.values() if r["record_type"] == "revisit"} <= {k for k, r in every.items() if r["record_type"] == "response"}
    r = next(r for r in every.values() if r["page_id"] == 2)
    assert r["url"] == "http://b/%0D%0AWARC-Type:%20x"


def test_bundles_are_zstandard_files_and_damage_is_noticed(tmp_path):
    import zstandard

    w = warc.BundleWriter(str(tmp_path), 3_000, 3)
    rows = [{"page_id": i, "record_id": f"urn:uuid:{i:08x}-0000-0000-0000-000000000000", "record_type": "response", "url": "u", "refers_to": None, "digest": b32("x" * i), "payload": b"x" * i, "size": i} for i in range(60)]
    m = w.write(iter([pa.RecordBatch.from_pylist(rows)]))
    raw = (tmp_path / m.archive).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # any reader skips the index and the table
    assert whole == b"".join(warc.to_record(r) for r in rows) and len(raw) == m.size
    bundle = warc.OpenBundle(str(tmp_path / m.archive))
    assert len(bundle.begin) > 5 and sum(len(bundle.frame(i)) for i in range(len(bundle.begin))) == len(whole)
    p = bundle.index()[7]
    assert warc.from_record(bundle.frame(int(p["frame"]))[int(p["offset"]) :])[0]["page_id"] == 7
    bad = bytearray(warc.to_record(rows[50]))
    bad[-10] = ord("y")
    with pytest.raises(ValueError, match="damaged"):
        warc.from_record(bytes(bad))


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return len(units), "plain", text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    letters = list("abZ <>PSM\\$\n\r\u0000é世\U0001f600{}1")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)] + [None, "", "x" * 300_000, "a b\n" * 200_000, "<P", "a<S>b", "  \u0085\r\n"] * 3
    docs = spark.createDataFrame([(None if i % 50 == 0 else i * BIG, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["i"]: r for r in fim.fill_in_middle(docs).withColumns({"back": fim.restore(F.col("output"), F.col("form")), "i": F.monotonically_increasing_id()}).collect()}
    assert len(rows) == len(texts)
    for (i, r), t in zip(sorted(rows.items()), texts, strict=True):
        assert (r["n"], r["form"], r["output"]) == brute_fim(r["doc_id"], t) and r["back"] == (t or "")
    assert len({r["form"] for r in rows.values()}) == 3


def test_fill_in_middle_edge_and_marks(spark, edge):
    assert fim.fill_in_middle(edge).count() == len(EDGE_ROWS) and fim.fill_in_middle(edge.where("false")).count() == 0
    own = ("[pre$1]", "[suf\\]", "[mid]")
    out = fim.fill_in_middle(edge, plain_rate=0, spm_rate=50, marks=own).withColumn("back", fim.restore(F.col("output"), F.col("form"), own)).collect()
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and sorted(r["back"] for r in out) == sorted(r[1] or "" for r in EDGE_ROWS)
    for bad in (("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(edge, marks=bad)


def brute_buckets(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(x.encode()) % n for x in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute_resample(docs, target, n, least, percent, seed):
    own = [(i, *brute_buckets(t, n)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in brute_buckets(x, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + n) / ((s[b] + 1.0) * (T + n)))) for b in range(n)]
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    order = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(order[: len(order) * percent // 100], 1):
        x[4] = k
    return sorted(str(tuple(x[:5])) for x in out)


@pytest.mark.parametrize("words", [importance.WORDS, 7])
def test_features_equal_brute_force(monkeypatch, words):
    monkeypatch.setattr(importance, "WORDS", words)
    rng = np.random.default_rng(1)
    letters = list("abcXYZ é世 ,.0_`~\x00\x7f\n") + [" ", "a"] * 4
    texts = [None, "", " ", "A", "a b"] + ["".join(rng.choice(letters, rng.integers(0, 300))) for _ in range(150)] + ["x" * 400 + " " + "y" * 400 + " " + "x" * 400]
    got, n = [[] for _ in texts], np.zeros(len(texts), int)
    for bucket, owner, own in importance.features(texts, 997):
        for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
            got[o].append(b)
        n += np.bincount(own, minlength=len(texts))
    for t, g, k in zip(texts, got, n, strict=True):
        assert (k, sorted(g)) == (brute_buckets(t, 997)[0], sorted(brute_buckets(t, 997)[1]))


def test_crcs_by_column():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, 5_000, dtype=np.uint8)
    start = rng.integers(0, 4_000, 300)
    length = np.minimum(rng.integers(0, 40, 300) ** 2, 5_000 - start)
    assert importance.crc_columns(a, start, length).tolist() == [zlib.crc32(a[s : s + n].tobytes()) for s, n in zip(start, length)]


def test_resampling_equals_brute_force(spark, edge):
    docs = [(r[0], r[1]) for r in EDGE_ROWS] + [(BIG + i, f"alpha beta gamma {i} " * (1 + i % 9)) for i in range(60)] + [(None, "alpha delta " * 20)] * 5 + [(77, "same words " * 15)] * 9
    target = ["alpha beta", None, "", "gamma " * 50]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, goal, n_buckets=500, least_words=10, percent=60, seed=3).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_resample(docs, target, 500, 10, 60, 3)
    assert importance.resample(frame.where("false"), goal).count() == 0
    none = importance.resample(edge, goal.where("false")).collect()
    assert sorted(str(tuple(r)) for r in none) == brute_resample([(r[0], r[1]) for r in EDGE_ROWS], [], 10_000, 20, 25, 7)


def test_importance_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = importance.op13_importance(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_resample(docs, target, 10_000, 20, 25, 7)
