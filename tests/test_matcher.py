"""Searches of many queries: the automaton, and what Python workers make of it."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import matcher, search
from tests.test_scale import plan


def places(text, q):
    """Where q begins in text, overlapping or not."""
    return [i for i in range(len(text) - len(q) + 1) if text.startswith(q, i)]


def apart(at, n):
    out = []
    for i in at:
        if not out or i >= out[-1] + n:
            out.append(i)
    return out


LONG = "ab" * 40
STRINGS = ["a", "ab", "aba", "aa", "é", "\U0001f600b", "b\n", LONG, LONG[1:], LONG + "c", "c" + LONG, "x" * 33, "not there", " ", "éa" * 20]


def texts(rng):
    some = ["".join(rng.choice(list("aabé \n\U0001f600c"), n)) for n in (0, 1, 5, 300, 40, 3_000)]
    return [*some, None, LONG * 3, "c" + LONG + "c", "", "x" * 70, "\U0001f600b" * 9, "éa" * 30, "b", "\na", LONG[:50], LONG[50:] + LONG]


@pytest.mark.parametrize(("window", "keys", "hits"), [(1 << 20, matcher.KEYS, 4 << 20), (257, (8, 4), 50), (64, (3,), 1)])
def test_the_automaton_finds_what_a_scan_finds(monkeypatch, window, keys, hits):
    monkeypatch.setattr(matcher, "WINDOW", window)
    monkeypatch.setattr(matcher, "KEYS", keys)
    monkeypatch.setattr(search, "HITS", hits)
    m, held = matcher.matcher(STRINGS), texts(np.random.default_rng(3))
    want = {(k, i): at for i, t in enumerate(held) for k, q in enumerate(STRINGS) if t and (at := places(t, q))}
    for column in (pa.array(held, pa.string()), pa.array(["before", *held], pa.large_string())[1:]):
        got = sorted(x for a in matcher.matches(m, *matcher.bytes_of(column)) for x in zip(*(c.tolist() for c in a), strict=True))
        assert got == sorted((k, i, j) for (k, i), at in want.items() for j in at)
        which, of = matcher.strings_of(m, *matcher.bytes_of(column))
        assert sorted(zip(which.tolist(), of.tolist(), strict=True)) == sorted(want)
        rows = [x for w, o, at in search._placed(m, column) for x in zip(w.tolist(), o.tolist(), at.to_pylist(), strict=True)]
        assert sorted(rows) == sorted((k, i, apart(at, len(STRINGS[k]))) for (k, i), at in want.items())


def test_too_large_an_automaton_is_none(monkeypatch):
    monkeypatch.setattr(matcher, "TABLE", 2_000)
    assert matcher.matcher([f"word{i}" for i in range(300)]) is None and matcher.matcher(["ab", "cd"]) is not None


def fold(s):
    return s.replace("\u00a0", " ").lower()


def many(spark, more):
    """More queries than are broadcast, with some of the same string."""
    return spark.createDataFrame([(2**60 + k, q) for k, q in enumerate([f"word{i}" for i in range(90)] + more)], "query_id long, q string")


PAGES = [(1, 0, "The word7 WORD71 é\u00a0end aaaa"), (None, 3, "word1"), (2**60 + 1, 1, None), (2**60 + 1, 2, ""), (5, 0, "wor"), (5, 1, "d8"), (6, 0, "a long one indeed, word8 a long one indeed, and so on")]
MORE = ["THE", "the", "x", "é ", "not there", "a long one indeed, word8 a long one", "", "aa", "aa", "\U0001f600b"]


def test_pages_meet_many_queries_without_a_row_for_each_gram(spark, monkeypatch):
    pages, q = spark.createDataFrame(PAGES, "doc_id long, page_no int, text string"), many(spark, MORE)
    want = [(d, p, r["query_id"]) for d, p, t in PAGES for r in q.collect() if t and r["q"] and fold(r["q"]) in fold(t)]
    got = search.search_pages(pages, q)
    assert "explode" not in plan(got) and not re.search("Aggregate|Join", plan(got))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    monkeypatch.setattr(search, "MARKS", 1)
    monkeypatch.setattr(search, "ROWS", 2)
    assert sorted(map(tuple, search.search_pages(pages, q).collect()), key=key) == sorted(want, key=key)
    assert search.search_pages(pages, q.where("q = 'aa'")).dtypes == got.dtypes


def test_queries_too_many_for_the_automaton_meet_pages_by_grams(spark, monkeypatch):
    pages, q = spark.createDataFrame(PAGES, "doc_id long, page_no int, text string"), many(spark, MORE)
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, search.search_pages(pages, q).collect()), key=key)
    monkeypatch.setattr(search, "HELD_CHARS", 10)
    assert sorted(map(tuple, search.search_pages(pages, q).collect()), key=key) == want


def test_hits_of_many_queries_are_placed_without_a_row_for_each_gram(spark, monkeypatch):
    pages, q = spark.createDataFrame(PAGES, "doc_id long, page_no int, text string"), many(spark, MORE)
    want = []
    for d, p, t in PAGES:
        for r in q.collect():
            if t and r["q"]:
                at = apart(places(fold(t), fold(r["q"])), len(r["q"]))
                want += [(d, p, t, r["query_id"], i, x, x + len(r["q"])) for i, x in enumerate(at)]
    rows = pages.withColumn("raw", F.col("text"))
    got = search.search_hits(rows, q, "raw")
    assert "explode(concat" not in plan(got) and not re.search("Aggregate|Join", plan(got))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    for name, bound in (("BACK", 1), ("ROWS", 2), ("AT_ONCE", 1), ("HITS", 1)):
        monkeypatch.setattr(search, name, bound)
    assert sorted(map(tuple, search.search_hits(rows, q, "raw").collect()), key=key) == sorted(want, key=key)
    assert search.search_hits(rows, q.where("q = 'aa'"), "raw").dtypes == got.dtypes


def test_a_page_of_many_hits_is_not_gone_through_for_all_strings_each_time(monkeypatch):
    n, real = [], search.matches
    monkeypatch.setattr(search, "HITS", 1_000)
    monkeypatch.setattr(search, "matches", lambda *a: (n.append(len(x[0])) or x for x in real(*a)))
    strings = ["a" * i for i in range(1, 31)]
    m, page = matcher.matcher(strings), pa.array(["a" * 5_000])
    got = {k: at for w, _, at in search._placed(m, page) for k, at in zip(w.tolist(), at.to_pylist(), strict=True)}
    assert got == {k: list(range(0, 5_000 - k, k + 1)) for k in range(30)}
    assert sum(n) < 3 * 30 * 5_000
