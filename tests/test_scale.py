"""Folds and rounds against brute force, and plans that must not hold every row of one side against every row of the other."""

import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import layout, meta, outline, paging, palette, raster, search, styles
from folio.operators.intervals import meeting
from folio.sources import manifest
from folio.sources.tables import doc_pages, lines

SF = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("simple")
    return out.getvalue()


def pages_of(events, height=100):
    return [(no, start, h, frags) for no, start, h, frags in paging.fold_with_notes(events, height)]


def line(n, before=0, after=0, h=10):
    return (paging.LINE, None, n * h, n * h + h, before, after)


def note(no, lines, h=10, first=0):
    return [(paging.NOTE, no, first + k * h, first + k * h + h, None, None) for k in range(lines)] + [(paging.NOTE_END, no, None, None, None, None)]


def test_notes_share_a_page_below_a_margin():
    # 3 lines (30) + margin 12 + note of 3 lines (30) = 72, two more lines end at 92, a third doesn't fit
    assert pages_of([line(0), line(1), line(2), *note(5, 3), line(3), line(4), line(5)]) == [(0, 0, 50, [(5, 0, 30)]), (1, 50, 10, [])]


def test_notes_spill_to_later_pages():
    # 2 lines, margin, 6 lines of the note fill 92; 9 more go on; 8 of them fill a page of their own at 92, then text follows on what is left
    got = pages_of([line(0), line(1), *note(7, 16), line(2)])
    assert got == [(0, 0, 20, [(7, 0, 60)]), (1, 20, 0, [(7, 60, 80)]), (2, 20, 10, [(7, 140, 20)])]
    assert pages_of([line(0), line(1), *note(7, 16)])[-1] == (2, 20, 0, [(7, 140, 20)])  # nothing follows: a page of its own


def test_a_note_without_room_takes_its_line_along():
    got = pages_of([*(line(i) for i in range(9)), *note(1, 2), line(9)])
    assert got == [(0, 0, 80, []), (1, 80, 20, [(1, 0, 20)])]
    assert pages_of([line(0, h=95), *note(1, 2)]) == [(0, 0, 95, [(1, 0, 10)]), (1, 95, 0, [(1, 10, 10)])]  # the only line of its page stays


def test_second_notes_forced_pages_and_high_fragments():
    assert pages_of([line(0), *note(1, 2), *note(2, 2), line(1)]) == [(0, 0, 20, [(1, 0, 20), (2, 0, 20)])]
    assert pages_of([line(0), line(1, before=2), line(2, after=2), line(3, before=1), line(4)]) == [(0, 0, 10, []), (1, 10, 40, [])]
    assert pages_of([line(0), *note(1, 1, h=100), line(1)]) == [(0, 0, 20, [])]  # as high as a page: not shown
    assert pages_of([]) == [] and pages_of([line(1), line(0), line(2)]) == [(0, 10, 20, [])]  # a table cell is skipped


def test_only_the_first_reference_takes_space(spark):
    rows = spark.createDataFrame([(1, i, i * 10, i * 10 + 10, 0, 0) for i in range(6)], "doc_id long, line_no int, start long, end long, before int, after int")
    refs = spark.createDataFrame([(1, 1, 0, 4), (1, 3, 0, 4), (1, 3, 1, 9)], "doc_id long, line_no int, ord int, note_id long")
    notes = spark.createDataFrame([(1, 4, 0, 0, 10), (1, 9, 0, 50, 60), (1, 9, 1, 60, 70), (2, 4, 0, 0, 10)], "doc_id long, note_id long, k int, start long, end long")
    got = paging.paginate_with_notes(rows, refs, notes, 100).orderBy("page_no", "frag_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 50, 0, 4, 0, 10), (1, 0, 0, 50, 1, 9, 50, 20), (1, 1, 50, 10, None, None, None, None)]


def brute_cut(colors, n, least):
    """One box at a time: the heaviest that can be split, of equal ones the less deep."""
    boxes = [("", colors)]
    while len(boxes) < n:
        able = []
        for path, cells in boxes:
            spread = [max(c[0][i] for c in cells) - min(c[0][i] for c in cells) for i in range(3)]
            if len(cells) > 1 and max(spread) > least:
                able.append((-sum(w for _, w in cells), len(path), path, cells, spread))
        if not able:
            break
        _, _, path, cells, spread = min(able, key=lambda b: b[:3])
        axis = 1 if spread[1] == max(spread) else 0 if spread[0] == max(spread) else 2
        cells = sorted(cells, key=lambda c: (c[0][axis], c[0]))
        total, low, k = sum(w for _, w in cells), 0, 0
        while k < len(cells) - 1 and 2 * low < total:
            low += cells[k][1]
            k += 1
        boxes = [b for b in boxes if b[0] != path] + [(path + "0", cells[:k]), (path + "1", cells[k:])]
    return {(c, path) for path, cells in boxes for c, _ in cells}


@pytest.mark.parametrize(("n", "least"), [(1, 0), (5, 0), (16, 0), (40, 0), (16, 90)])
def test_median_cut_equals_brute_force(spark, n, least):
    rng = np.random.default_rng(n)
    data, images = [], {}
    for image in range(3):
        px = [tuple(int(v) for v in p) for p in rng.integers(0, [256, 60, 12] if image else [4, 4, 4], (300, 3))] + [(9, 9, 9)] * (0 if image < 2 else 2_000)
        data += [(image, i % 50, i // 50, *p) for i, p in enumerate(px)]
        images[image] = [(c, px.count(c)) for c in sorted(set(px))]
    cells = palette.median_cut(spark.createDataFrame(data, "image_id int, x int, y int, r int, g int, b int"), n, least).collect()
    for image, colors in images.items():
        assert {((r["r"], r["g"], r["b"]), r["box"]) for r in cells if r["image_id"] == image} == brute_cut(colors, n, least)
    assert sum(r["n"] for r in cells) == len(data)


def test_palette_and_nearest_colors(spark):
    px = spark.createDataFrame([(1, i, 0, *c) for i, c in enumerate([(0, 0, 0), (0, 0, 0), (2, 1, 0), (250, 250, 250), (255, 255, 255)])], "image_id int, x int, y int, r int, g int, b int")
    got = palette.quantize(px, 2).orderBy("x").collect()
    assert [(r["idx"], r["pr"], r["pg"], r["pb"]) for r in got] == [(0, 0, 0, 0)] * 3 + [(1, 252, 252, 252)] * 2
    assert palette.quantize(px.where("false"), 4).count() == 0


def test_many_queries_meet_pages_by_grams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    pages = doc_pages(docs)
    words = docs.select(F.explode(F.split("text", " ")).alias("q")).distinct().limit(300)
    odd = spark.createDataFrame([("é",), ("e",), (". ",), ("zzzz not there",), ("",), ("\U0001f600",), ("THE",), ("\\E.*",)], "q string")
    q = words.union(odd).select(F.xxhash64("q").alias("query_id"), "q")
    few = [search.search_pages(pages, q.where(F.pmod("query_id", F.lit(8)) == i)) for i in range(8)]
    want = sorted(tuple(r) for f in few for r in f.collect())
    many = search.search_pages(pages, q)
    assert sorted(map(tuple, many.collect())) == want and len(want) > 300
    assert not re.search("CartesianProduct|NestedLoop", plan(many))


def test_no_registered_search_needs_a_cartesian_product(spark):
    for name in ("search_pages_pack", "search_hits_pack", "suggest", "prefix_index", "grow_prefix_index"):
        assert not re.search("CartesianProduct|NestedLoop", plan(search.REGISTERED[name][0](spark, SF))), name


def test_prefixes_longer_than_the_stem(spark):
    terms = spark.createDataFrame([("abcdefghijklmnopqr", 3), ("abcdefghijklmnopqz", 5), ("abcdefghijklmnop", 1), ("b", 9)], "term string, hits long")
    ask = spark.createDataFrame([("abcdefghijklmnopq",), ("abcdefghijklmnop",), ("",), ("x",)], "prefix string")
    got = search.lookup(search.prefix_index(terms, 2), terms, ask, 2).orderBy("prefix", "rank").collect()
    assert [tuple(r) for r in got] == [("", 1, "b", 9), ("", 2, "abcdefghijklmnopqz", 5), ("abcdefghijklmnop", 1, "abcdefghijklmnopqz", 5), ("abcdefghijklmnop", 2, "abcdefghijklmnopqr", 3), ("abcdefghijklmnopq", 1, "abcdefghijklmnopqz", 5), ("abcdefghijklmnopq", 2, "abcdefghijklmnopqr", 3)]


def brute_union(boxes):
    boxes = [(*b, 1) for b in boxes]
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j, b in enumerate(boxes) if j > i and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]), None)
            if j is not None:
                b = boxes.pop(j)
                boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4])
                break
        else:
            return sorted(boxes)


@pytest.mark.parametrize("fold", [512, 3])
def test_unions_of_images_equal_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(layout, "FOLD", fold)
    rng = np.random.default_rng(2)
    pages = {}
    for page in range(3):
        x, y = rng.integers(0, 2_000, (2, 60))
        w, h = (rng.integers(0, 400, (2, 60)) ** (1 if page else 0.7)).astype(int)
        pages[page] = [(float(a), float(b), float(a + c), float(b + d)) for a, b, c, d in zip(x, y, w, h)]
    pages[3] = [(0.0, 0.0, 10.0, 1.0), (9.0, 0.0, 10.0, 10.0), (0.0, 9.0, 10.0, 10.0), (3.0, 3.0, 4.0, 4.0), (20.0, 20.0, 20.0, 30.0)] + [(50.0, 50.0, 60.0, 60.0)] * 5
    rows = [(1, p, *b) for p, bs in pages.items() for b in bs]
    got = layout.merge_overlapping_images(spark.createDataFrame(rows, "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")).collect()
    for p, bs in pages.items():
        flat = [b for b in bs if b[0] < b[2] and b[1] < b[3]]
        mine = sorted(tuple(r)[2:] for r in got if r["page_no"] == p)
        assert [b for b in mine if b[0] < b[2] and b[1] < b[3]] == brute_union(flat)
        assert sum(b[4] for b in mine) == len(bs)


def test_nearest_glyphs_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    boxes = [(1, p, i, "\n" if i % 7 == 0 else f"c{i}", int(x), int(y), int(x + w), int(y + h)) for p in range(2) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 6_000 if p else 300, (2, 40)), *rng.integers(1, 300, (2, 40))))]
    points = [(1, p, k, int(x), int(y)) for p in range(2) for k, (x, y) in enumerate(rng.integers(0, 6_000, (50, 2)))] + [(2, 0, 0, 5, 5)]
    got = layout.glyph_near(spark.createDataFrame(boxes, "doc_id long, page_no int, idx int, ch string, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(points, "doc_id long, page_no int, point_id int, x int, y int"), cell=64).collect()
    want = []
    for d, p, k, x, y in points:
        near = [(max(0, b[4] - x, x - b[6]) ** 2 + max(0, b[5] - y, y - b[7]) ** 2, b[2], b[3]) for b in boxes if (b[0], b[1]) == (d, p) and b[3] != "\n"]
        if near:
            far, idx, ch = min(near)
            want.append((d, p, k, ch, idx, far))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_glyphs_by_ordinal_skip_newlines_both_ways(spark):
    boxes = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "\n"), (1, 0, 2, "\n"), (1, 0, 3, "b")], "doc_id long, page_no int, idx int, ch string")
    points = spark.createDataFrame([(1, 0, k) for k in range(5)], "doc_id long, page_no int, at int")
    back = {r["at"]: r["ch"] for r in layout.glyph_at(boxes, points).collect()}
    ahead = {r["at"]: r["ch"] for r in layout.glyph_at(boxes, points, forward=True).collect()}
    assert back == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"} and ahead == {0: "a", 1: "b", 2: "b", 3: "b"}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_meeting_intervals_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    a, b = ([(int(k), i, int(lo), int(lo + n)) for i, (k, lo, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-50, 300, 60), rng.integers(-2, 40, 60)))] for _ in range(2))
    got = meeting(spark.createDataFrame(a, "k long, i int, lo long, hi long"), spark.createDataFrame(b, "k long, j int, a long, b long"), ["k"], ("lo", "hi"), ("a", "b"), width).select("i", "j").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_long_documents_are_looked_up_in_stretches(spark):
    n = 300_000
    pages = spark.range(n // 20).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"), (F.col("id") * 800).alias("start"), (F.col("id") * 800 + 799).alias("end"))
    pos = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 40 + 1).alias("pos"))
    got = paging.page_of(pos, pages).agg(F.count("*").alias("n"), F.sum("page_no").alias("s")).first()
    assert (got["n"], got["s"]) == (n, 20 * sum(range(n // 20)))  # all pairs would be 4.5 billion rows
    notes = spark.range(n // 10).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("num"), (F.col("id") * 10).alias("target"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 10 == 3, "").otherwise("x").alias("line"))
    assert outline.resolve_notes(notes, rows).where("body = 'x x x'").count() == n // 10


def test_rules_of_many_declarations_keep_their_order(spark):
    css = ".a{" + "".join(f"p{i}:1;" for i in range(2_500)) + "color:red} .a{color:blue}"
    got = styles.cascade(styles.parse_style_rules(spark.createDataFrame([(1, css)], "page_id long, css string"))).where("prop = 'color'").collect()
    assert [r["value"] for r in got] == ["blue"]


def test_headings_and_links_with_inner_markup(spark):
    html = "<H2 id=x><b>bold</b> x &amp; y</H2><h3>\n a\n b </h3><header>no</header><h1>open <i>i</i></h2><A class='c' HREF='/p?a=1&amp;b'><img src=q>in <b>ner</b></A><a href=\"it's\">t</a><abbr href='/no'>n</abbr>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [tuple(r)[2:] for r in outline.extract_headings(page).orderBy("ord").collect()] == [(2, "bold x & y"), (3, "a b"), (1, "open i")]
    assert [tuple(r)[2:] for r in outline.links(page).orderBy("ord").collect()] == [("/p?a=1&b", "in ner"), ("it's", "t")]


def test_torn_missing_and_extra_files_are_found(spark, tmp_path):
    path = tmp_path / "out"
    made = manifest.write_manifest(spark.range(40).repartition(4), f"file://{path}")
    names = sorted(r["name"] for r in made.collect())
    assert len(names) == 4 and manifest.verify_files(spark, f"file://{path}").count() == 0 and manifest.verified(spark, f"file://{path}").count() == 40
    raw = (path / names[0]).read_bytes()
    for crc in path.glob(".*.crc"):
        crc.unlink()
    (path / names[0]).write_bytes(raw[:-5])
    (path / names[1]).write_bytes((path / names[1]).read_bytes()[:-5] + b"12345")
    (path / names[2]).rename(path / "part-new.parquet")
    got = {r["name"]: r["status"] for r in manifest.verify_files(spark, f"file://{path}").collect()}
    assert got == {names[0]: "torn", names[1]: "changed", names[2]: "missing", "part-new.parquet": "extra"}


def test_a_null_on_the_left_wins_too(spark):
    kind = "key string, name string, value string"
    got = meta.union(spark.createDataFrame([("1", "a", None)], kind), spark.createDataFrame([("1", "a", "x"), ("1", "b", "y")], kind)).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("1", "a", None), ("1", "b", "y")]


def test_least_differences_equal_brute_force_without_a_copy_for_each_neighbour(spark):
    """Images with gaps; the rows that are shuffled are no more than the pixels and their copies along one axis."""
    rng = np.random.default_rng(4)
    a, b = ([(i, x, y, int(r)) for i in range(2) for x in range(9) for y in range(11) for r in rng.integers(0, 256, 1) if rng.random() < 0.6] for _ in range(2))
    made = [spark.createDataFrame(p, "image_id long, x int, y int, r int") for p in (a, b)]
    out = raster.local_min(*made)
    want = {}
    for i, x, y, r in a:
        near = [(r - r2) ** 2 for j, u, v, r2 in b if i == j and abs(x - u) <= 2 and abs(y - v) <= 2]
        want[i] = want.get(i, 0) + (min(near) if near else 0)
    assert {r["image_id"]: r["sse"] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_boxes_are_made_once_for_all_rectangles(spark):
    boxes = spark.createDataFrame([(1, 0, 0, "a", 0, 60, 0.0)], "doc_id long, page_no int, idx int, ch string, u0 int, u1 int, top double").repartition(3)
    rects = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "rect_id int, x0 double, y0 double, x1 double, y1 double").repartition(4)
    out = layout.text_in_rect(boxes, rects)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 1, 1, "a")]
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_pages_of_few_images_take_no_rounds_and_others_no_broadcast(spark, monkeypatch):
    made, real = [], layout.cut

    def noted(df, name="cut"):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(layout, "cut", noted)
    # each union meets the next box only when it has grown: many passes over one page
    rows = [(1, 0, 10.0 * i, 10.0 * (i % 7), 10.0 * i + 12, 10.0 * (i % 7) + 35) for i in range(40)]
    kind = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double"
    want = brute_union([r[2:] for r in rows])
    few = layout.merge_overlapping_images(spark.createDataFrame(rows, kind)).collect()
    assert sorted(tuple(r)[2:] for r in few) == want and [name for name, _ in made] == ["boxes"]
    monkeypatch.setattr(layout, "FOLD", 2)
    many = layout.merge_overlapping_images(spark.createDataFrame(rows, kind)).collect()
    assert sorted(tuple(r)[2:] for r in many) == want and not any("Broadcast" in p for _, p in made)


def test_files_are_summed_by_more_than_one_task(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(f"file://{tmp_path}/out")
    out = manifest.one_list(manifest.file_sums(spark, f"file://{tmp_path}/out"))
    assert "Coalesce" not in plan(out) and out.rdd.getNumPartitions() == 1 and out.count() == 4


def test_running_sums_of_long_arrays(spark):
    from folio.functions.arrays import STEP, running

    arrays = [[], [5], list(range(STEP)), list(range(STEP + 1)), [3] * (2 * STEP), [i % 7 for i in range(3_001)]]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>").select("i", running(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [[sum(a[:k]) for k in range(len(a) + 1)] for a in arrays]


def test_pages_and_their_words_are_counted_where_they_lie(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"Word {i} é \U0001f600" for i in range(2_000))), (2, ""), (3, None), (4, "\n" * 40)], "doc_id long, text string")
    for made in (lines(docs), doc_pages(docs), search.term_page_index(doc_pages(docs)), search.search_hits(doc_pages(docs), spark.createDataFrame([(1, "d")], "query_id int, q string"))):
        assert not re.search("Exchange hash|Sort |Aggregate", plan(made))
    got = [tuple(r) for r in doc_pages(docs).orderBy("doc_id", "page_no").collect()]
    texts, want = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] is not None}, []
    for d, text in texts.items():
        parts, at = text.split("\n"), 0
        for k in range(0, len(parts), 20):
            page = "\n".join(parts[k : k + 20])
            want.append((d, k // 20, page, at, at + len(page)))
            at += len(page) + 1
    assert got == want
    terms = {(r["term"], r["doc_id"], r["page_no"]): r["n"] for r in search.term_page_index(doc_pages(docs)).collect()}
    assert terms == {("word", 1, k): 20 for k in range(100)} | {("é", 1, k): 20 for k in range(100)}


def test_words_of_pages_are_sorted_once(spark):
    boxes = layout.word_boxes(lines(spark.createDataFrame([(1, "a  b\n\nc d")], "doc_id long, text string")))
    assert [(r["idx"], r["ch"], r["pos"]) for r in boxes.orderBy("idx").collect()] == [(0, "a", 0), (1, "b", 3), (2, "c", 6), (3, "d", 8)]
    # one sort of lines, one of words (each shown once)
    assert len(re.findall(r"\bSort \[", plan(layout.group_spans(boxes)).split("Initial Plan")[0])) <= 2


@pytest.mark.parametrize("held", [100_000, 0])
def test_many_queries_write_no_grams_of_pages(spark, monkeypatch, held):
    names, real = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name="cut": names.append(name) or real(df, name))
    monkeypatch.setattr(search, "HELD", held)
    pages = spark.createDataFrame([(i, 0, f"page{i} of x{i % 7} and more é{i % 3}") for i in range(30)], "doc_id long, page_no int, text string")
    qs = [f"page{i}" for i in range(60)] + ["x3", "é1 ", "e", "é2"] + [f"x{i}" for i in range(7)] * 2
    got = search.search_hits(pages, spark.createDataFrame(list(enumerate(qs)), "query_id int, q string")).collect()
    want = [(r["doc_id"], k, r["text"].count(q)) for r in pages.collect() for k, q in enumerate(qs) if q in r["text"]]
    assert sorted({(r["doc_id"], r["query_id"]) for r in got}) == sorted((d, k) for d, k, _ in want) and len(got) == sum(n for *_, n in want)
    assert "grams" not in names and "counts" in names


def test_few_points_of_a_page_meet_its_boxes_without_a_grid(spark, monkeypatch):
    names, real = [], layout.cut
    monkeypatch.setattr(layout, "cut", lambda df, name="cut": names.append(name) or real(df, name))
    boxes = [(1, p, i, "\n" if i == 0 else f"c{i}", 70 * i, 40 * p, 70 * i + 60, 40 * p + 30) for p in range(2) for i in range(30)]
    points = [(1, p, k, 997 * k % 2_500, 61 * k) for p in range(3) for k in range(8)]
    got = layout.glyph_near(spark.createDataFrame(boxes, "doc_id long, page_no int, idx int, ch string, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(points, "doc_id long, page_no int, point_id int, x int, y int"))
    assert "near" not in names and "Generate explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for d, p, k, x, y in points:
        near = [(max(0, b[4] - x, x - b[6]) ** 2 + max(0, b[5] - y, y - b[7]) ** 2, b[2], b[3]) for b in boxes if b[1] == p and b[3] != "\n"]
        want += [(d, p, k, ch, idx, far) for far, idx, ch in ([min(near)] if near else [])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
