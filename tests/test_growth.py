"""What must not grow faster than the input: steps that once held rows times rows, or shuffled every word."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import lang, layout, outline, search, words
from folio.sources.tables import line_pages, lines
from folio.streaming import commands
from tests.test_scale import SF, plan


def test_a_target_of_many_relations_is_looked_up_once(spark, monkeypatch):
    held, cut = {}, outline.cut
    monkeypatch.setattr(outline, "cut", lambda df, name: held.setdefault(name, cut(df, name)))
    catalog = spark.range(300).select(F.lit("a").alias("archive"), F.col("id").alias("entry_no"), F.concat(F.lit("/en/"), "id").alias("name"))
    rels = spark.range(200).select(F.lit("a").alias("archive"), "id", F.lit("x/image").alias("type"), F.when(F.col("id") < 150, "./en").otherwise("/7").alias("target"))
    got = outline.resolve_relations(rels, catalog).collect()
    assert held["targets"].count() == held["first"].count() == 2
    assert {(r["id"], r["name"]) for r in got} == {(i, "/en/0" if i < 150 else "/en/7") for i in range(200)}


def test_previews_are_made_where_the_page_lies(spark):
    pages = spark.createDataFrame([(1, 0, "one the two\nthe end " * 30), (None, 1, "The"), (2**60 + 1, 0, "")], "doc_id long, page_no int, text string")
    got = search.search_previews(pages, spark.createDataFrame([(1, "the"), (2, "end")], "query_id int, q string"))
    assert "Window" not in plan(got) and "array_append" not in plan(got)
    rows = got.collect()
    assert sum(r["hits"] for r in rows) == 60 + 1 + 30 and {r["doc_id"] for r in rows} == {1, None}


def test_a_stream_of_texts_meets_many_queries_without_a_row_for_each_gram(spark):
    qs = [f"word{i}" for i in range(90)] + ["THE", "the", "x", "é ", "not there", "a long one indeed", "", "\U0001f600b"]
    docs = [(1, "The word7 word71 é end"), (2, None), (2**60 + 1, "a long one indeed, word8"), (4, ""), (5, "wor"), (6, "ax\U0001f600b")]
    q = spark.createDataFrame(list(enumerate(qs)), "query_id int, q string")
    found = commands.stream_search(spark.createDataFrame(docs, "doc_id long, text string"), q)
    assert "explode(concat" not in plan(found)
    want = sorted((d, k) for d, text in docs for k, s in enumerate(qs) if s and text and s.lower() in text.lower())
    assert sorted(map(tuple, found.collect())) == want


def test_pairs_are_counted_within_a_text(spark):
    docs = [(1, "en", "the then"), (2, "de", "der den"), (2, "de", "there"), (None, "en", "the"), (3, None, None), (4, "en", "x"), (2**60 + 1, "fr", "\U0001f600den"), (5, "en", "zzq")]
    profiles = spark.createDataFrame([("en", 1, "th", 4), ("en", 2, "he", 3), ("de", 1, "de", 4), ("de", 2, "en", 1), ("fr", 1, "th", 4), ("fr", 2, "he", 3), (None, 1, "zz", 9)], "lang string, rank int, bigram string, n long")
    out = lang.detect_language(spark.createDataFrame(docs, "doc_id long, lang string, text string"), profiles)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    # 1: th and he twice, three more once; both texts of 2 are one
    assert got.keys() == {1, 2, 2**60 + 1} and got[1] == ("en", round(14 / 11**0.5 / 5, 6)) and got[2**60 + 1][0] == "de"
    assert got[2][0] == "de" and not re.search("explode\\(zip_with", plan(lang.detect_language(spark.createDataFrame(docs[:1], "doc_id long, lang string, text string"), profiles)))


def test_profiles_are_counted_without_a_row_for_each_pair(spark):
    docs = spark.createDataFrame([("en", "Aab"), ("en", "ab"), (None, "aa\U0001f600"), ("de", ""), ("de", None)], "lang string, text string")
    out = lang.bigram_profiles(docs)
    assert "explode(zip_with" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("en", 1, "ab", 2), ("en", 2, "aa", 1), (None, 1, "aa", 1), (None, 2, "a\U0001f600", 1)], key=str)


def test_words_of_odd_lines_lie_where_they_are(spark):
    texts = {1: "  a  é\U0001f600 b \n\n   \nc", 2: "", 3: None, 4: "\n".join(f"w{i}  x" if i % 3 else "" for i in range(45)), 5: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    want = []
    for d, text in texts.items():
        start, idx = 0, {}
        for no, line in enumerate((text or "").split("\n")):
            size, off = 24 if no % 20 == 0 else 14 if len(line) < 40 else 10, 0
            for k, w in enumerate(line.split(" ")):
                if w:
                    i = idx[no // 20] = idx.get(no // 20, -1) + 1
                    u0 = size * (6 * off + k // 5 + 12 * (k // 11))
                    want.append((d, no // 20, no, i, w, start + off, u0, u0 + 6 * size * len(w), size, no % 20 == 0, round(no % 20 / 20, 6)))
                off += len(w) + 1
            start += len(line) + 1
    for boxes in (layout.word_boxes(lines(docs)), layout.flat_words(words.page_words(line_pages(docs)))):
        assert sorted(map(tuple, boxes.collect())) == sorted(want) and len(want) > 60


def hits_and_words():
    """Hits and words in no order; words may overlap, be empty and lie on several lines."""
    rng = np.random.default_rng(5)
    hits = [(d, p, q, i, int(lo), int(lo + n)) for d in (1, 2) for p in range(4) for q in range(3) for i, (lo, n) in enumerate(zip(rng.integers(-5, 300, 8), rng.integers(0, 60, 8))) if p != 2]
    boxes = [(d, p, float(t) if t else None, 10 * i - 900, 10 * i + int(t), int(pos), "x" * int(n)) for d in (1, 2) for p in range(4) for i, (t, pos, n) in enumerate(zip(rng.integers(0, 3, 50), rng.integers(0, 310, 50), rng.integers(0, 30, 50))) if p != 3]
    return hits, boxes


HIT, SPOT = "doc_id long, page_no int, query_id int, hit_no int, pos0 long, end0 long", "doc_id long, page_no int, top double, u0 long, u1 long, pos long, ch string"


def test_boxes_of_hits_are_found_where_the_page_lies(spark):
    assert not re.search("Exchange hash|Sort|Aggregate", plan(layout.REGISTERED["search_hit_boxes"][0](spark, SF)))
    hits, boxes = hits_and_words()
    want = {}
    for d, p, q, i, lo, hi in hits:
        for e, s, top, u0, u1, pos, ch in boxes:
            if (d, p) == (e, s) and lo < hi and ch and pos < hi and lo < pos + len(ch):
                a, b = want.get((d, p, q, i, top), (u0, u1))
                want[d, p, q, i, top] = min(a, u0), max(b, u1)
    got = layout.search_hit_boxes(spark.createDataFrame(hits, HIT).repartition(3), spark.createDataFrame(boxes, SPOT).repartition(2)).collect()
    assert len(got) == len(want) > 100 and {tuple(r)[:5]: tuple(r)[5:] for r in got} == want


def test_edges_of_hits_are_found_where_the_page_lies(spark):
    assert not re.search("Exchange hash|Sort|Aggregate", plan(layout.REGISTERED["hit_spans_columns"][0](spark, SF)))
    hits, boxes = hits_and_words()
    want = []
    for d, p, q, i, *ends in hits:
        held = [max(((pos, u0) for e, s, _, u0, _, pos, ch in boxes if (d, p) == (e, s) and pos <= at <= pos + len(ch)), default=None) for at in ends]
        if None not in held and held[0][1] < -600 < held[1][1]:
            want.append((d, p, q, i, held[0][1], held[1][1]))
    got = layout.hit_spans_columns(spark.createDataFrame(hits, HIT).repartition(3), spark.createDataFrame(boxes, SPOT).repartition(2), -600).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def by_pages(rows):
    """Rows (doc_id, page_no, …) by page, in their order."""
    out = {}
    for r in sorted(rows):
        out.setdefault(r[:2], []).append(r[2:])
    return out


BOX = "doc_id long, page_no int, idx int, ch string, u0 long, u1 long, size int, bold boolean, top double, line_no int"


def some_boxes():
    rng = np.random.default_rng(3)
    out = []
    for page in range(5):
        x, top = 0, 0.0
        for i in range(40 if page else 1):
            size = int(rng.choice([10, 10, 10, 14]))
            if rng.random() < 0.15:
                x, top = 0, top + float(rng.choice([0.005, 0.01, 0.02, 0.05, -0.05]))
            x += int(rng.choice([0, 15, 30, 90, 200]))
            out.append((1, page, i, str(rng.choice(["a", "é", "\U0001f600b", "", "cd e"])), x, x + 40, size, i % 2 == 0, top, i))
            x += 40
    return out


def brute_spans(boxes):
    out = []
    for page, rows in by_pages(boxes).items():
        spans = []
        for i, (_, ch, u0, u1, size, bold, top, line_no) in enumerate(rows):
            gap = abs(u0 - rows[i - 1][3])
            if i and (size, top) == (rows[i - 1][4], rows[i - 1][6]) and gap < 8 * size:
                s = spans[-1]
                s[0], s[1], s[2] = s[0] + " " * (gap >= 1.5 * size) + ch, min(s[1], u0), max(s[2], u1)
            else:
                spans.append([ch, u0, u1, size, bold, top, line_no])
        out += [(*page, k, *s) for k, s in enumerate(spans)]
    return out


def test_spans_are_made_where_the_page_lies(spark):
    assert not re.search("Exchange|Window", plan(layout.REGISTERED["group_spans"][0](spark, SF)))
    boxes = some_boxes()
    got = layout.group_spans(spark.createDataFrame(boxes, BOX).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_spans(boxes)) and len(got) > 40
    none = layout.group_spans(spark.createDataFrame([(1, 0, i, None, 10 * i, 10 * i, None, None, None, None) for i in range(2)] + [(2, 0, 0, None, 0, 0, 1, True, 0.0, 0)], BOX)).collect()
    assert sorted((r["doc_id"], r["span_no"], r["text"]) for r in none) == [(1, 0, ""), (1, 1, ""), (2, 0, "")]


def brute_lines(spans):
    out = []
    for page, rows in by_pages(spans).items():
        made = []
        for i, (_, text, _, _, size, _, top, _) in enumerate(rows):
            away = (top - rows[i - 1][6]) * 480
            if i and not abs(away) > 0.9 * size:
                made[-1][2:] = [made[-1][2] + 1, made[-1][3] + " " + text]
            else:
                block = made[-1][0] + (away > 1.5 * size or away < -0.5 * size) if i else 0
                made.append([block, made[-1][1] + 1 if i else 0, 1, text])
        out += [(*page, *m) for m in made]
    return out


def test_lines_and_blocks_are_made_where_the_page_lies(spark):
    assert not re.search("Exchange|Window", plan(layout.REGISTERED["group_lines_blocks"][0](spark, SF)))
    spans = brute_spans(some_boxes())
    got = layout.group_lines_blocks(spark.createDataFrame(spans, BOX.replace("idx int, ch", "span_no int, text")).repartition(3)).collect()
    want = brute_lines(spans)
    assert sorted(map(tuple, got)) == sorted(want) and max(r[2] for r in want) > 2


def test_nested_pages_are_made_where_they_lie(spark):
    assert not re.search("Exchange|Window", plan(layout.REGISTERED["nested_page"][0](spark, SF)))
    rows = [(1, p, b, b * 3 + i, f"{b}.{i}" if i else None) for p in (1, 0, 7) for b in range(3) for i in range(p + 1)]
    got = layout.nested_page(spark.createDataFrame(rows[::-1], "doc_id long, page_no int, block int, line int, text string").repartition(3)).collect()
    assert {r["page_no"]: r["blocks"] for r in got} == {p: [[f"{b}.{i}" if i else None for i in range(p + 1)] for b in range(3)] for p in (0, 1, 7)}


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_terms_are_sorted_not_their_prefixes(spark, monkeypatch, size):
    made, real = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name="cut": made.append(df) or real(df, name))
    rng = np.random.default_rng(size)
    terms = {"".join(rng.choice(list("abé\U0001f600"), n)): int(rng.integers(1, 6)) for n in rng.integers(1, 22, 300)} | {"a": 9, "ab": 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = spark.createDataFrame(list(terms.items()), "term string, hits long").repartition(5)
        got = [tuple(r) for r in search.prefix_index(rows, 3).collect()]
        halves = [rows.where(F.col("term") < "b"), rows.where(F.col("term") >= "b").unionByName(rows.where("term = 'a'"))]
        grown = [tuple(r) for r in search.grow_prefix_index(halves[0], search.prefix_index(halves[0], 3), halves[1], 3)[1].collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def brute(counts):
        prefixes = {t[:i] for t in counts for i in range(min(len(t), 16) + 1)}
        best = {p: sorted((-n, t.encode(), t) for t, n in counts.items() if t.startswith(p))[:3] for p in prefixes}
        return sorted((p, i + 1, t, -n) for p, b in best.items() for i, (n, _, t) in enumerate(b))

    assert sorted(got) == brute(terms) and sorted(grown) == brute(terms | {"a": 18})
    assert not any("Generate explode" in df._jdf.queryExecution().optimizedPlan().toString() for df in made)
