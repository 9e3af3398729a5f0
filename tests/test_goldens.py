"""Goldens on inline rows: previews, folds, outlines of any depth, natural order, formats, streams against batch."""

import re
from functools import cmp_to_key

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import lang, layout, meta, outline, paging, raster, search, styles
from folio.streaming import commands


def previews(text, q, words):
    """The windows in plain Python, as the operator describes them."""
    hits, at = [], text.find(q)
    while at >= 0:
        hits.append(at)
        at = text.find(q, at + len(q))
    out, start, end = [], None, None
    for pos in hits:
        if start is not None and start <= pos <= end:
            end = max(end, pos + len(q))
            end = next((i for i in range(end, len(text)) if text[i] == " "), end)
            out[-1] = (start, end, out[-1][2] + 1)
            continue
        after = 0 if start is None else end + 1
        back, n, extra = pos, 0, 0
        while n < words:
            back -= 1
            if back <= 0 or back <= after:
                back, extra = max(0, back), words - n
                break
            n += text[back] == " "
        front, n = pos + len(q), 0
        while n < words + extra:
            front += 1
            if front >= len(text):
                front = len(text)
                break
            n += text[front] == " "
        start, end = back, front
        out.append((start, end, 1))
    return [(text[a:b].replace("\n", " "), n) for a, b, n in out]


def test_previews_equal_the_scan(spark):
    texts = ["hit at the start and a hit", " ".join(f"w{i}" if i % 13 else "hit" for i in range(90)), "a hit b hit c\nhit d e f g h i j k l m n hit o hit", "hithit hit", "no match", "x " * 40 + "hit", "hit"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")
    q = spark.createDataFrame([(1, "hit"), (2, "w1")], "query_id int, q string")
    for words in (2, 7):
        got = {}
        for r in search.search_previews(pages, q, words).orderBy("no").collect():
            got.setdefault((r["doc_id"], r["query_id"]), []).append((r["preview"], r["hits"]))
        want = {(i, k): p for i, t in enumerate(texts) for k, s in ((1, "hit"), (2, "w1")) if (p := previews(t, s, words))}
        assert got == want


def test_pages_of_lines_of_any_height(spark):
    lines = [(1, 0, 0, 30, 0, 0), (1, 1, 30, 70, 0, 0), (1, 2, 70, 90, 0, 2), (1, 3, 90, 95, 0, 0), (1, 4, 92, 300, 0, 0), (1, 5, 95, 120, 2, 0), (1, 6, 120, 125, 0, 2), (1, 7, 125, 130, 1, 0), (2, 0, 0, 500, 0, 0)]
    out = paging.paginate_heights(spark.createDataFrame(lines, "doc_id long, line_no int, start long, end long, before int, after int"), 80)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 70), (1, 1, 70, 90), (1, 2, 90, 95), (1, 3, 95, 130), (2, 0, 0, 500)]


def test_nearest_page_directions(spark):
    ranges = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 12, 20)], "doc_id long, page_no int, start long, end long")
    pos = spark.createDataFrame([(1, p) for p in (0, 9, 10, 12, 25)], "doc_id long, pos long")
    got = {d: [r["page_no"] for r in paging.nearest_page(pos, ranges, d).orderBy("pos").collect()] for d in (-1, 0, 1)}
    assert got == {0: [0, 0, 1, 1, 1], 1: [1, 1, 1, 1, 1], -1: [0, 0, 0, 0, 1]}


def test_outlines_of_any_depth(spark):
    levels = [1, 2, 3, 4, 5, 6, 7, 8, 7, 2, 9]
    heads = spark.createDataFrame([(1, i, i * 10, k, f"h{i}") for i, k in enumerate(levels)], "doc_id long, ord int, pos long, level int, title string")
    got = {r["ord"]: (r["parent"], r["child_no"]) for r in outline.outline_parents(heads).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (3, 0), 5: (4, 0), 6: (5, 0), 7: (6, 0), 8: (5, 1), 9: (0, 1), 10: (9, 0)}
    pos = spark.createDataFrame([(1, 75), (1, 85), (1, 95), (1, 500), (2, 0)], "doc_id long, pos long")
    chapters = {(r["doc_id"], r["pos"]): r["chapter"] for r in outline.chapter_of(pos, heads).collect()}
    assert chapters[1, 75] == " / ".join(f"h{i}" for i in range(8)) and chapters[1, 85] == " / ".join(f"h{i}" for i in (0, 1, 2, 3, 4, 5, 8))
    assert chapters[1, 95] == "h0 / h9" and chapters[1, 500] == "h0 / h9 / h10" and chapters[2, 0] == ""
    assert outline.outline_parents(heads.where("false")).count() == 0 and outline.chapter_of(pos, heads.where("false")).count() == 5


def test_natural_order_equals_brute_force(spark):
    names = ["img10.jpg", "IMG2.jpg", "img 02b.jpg", "a" + "9" * 25 + ".jpg", "a" + "9" * 24 + "8.jpg", "a1" + "0" * 30 + ".jpg", "a7.txt", "b.jpg", "b0.jpg", "a.jpg"]

    def parts(n):
        return [int(x) if x.isdigit() else x for x in re.findall(r"[0-9]+|[^0-9]", n.lower().replace(" ", ""))]

    def less(a, b):
        for x, y in zip(parts(a), parts(b)):
            if x != y:
                return -1 if (x < y if type(x) is type(y) else str(x)[0] < str(y)[0]) else 1
        return len(parts(a)) - len(parts(b))

    rows = spark.createDataFrame([("z", i, n) for i, n in enumerate(names)], "archive string, entry_no int, name string")
    got = [r["name"] for r in meta.catalog_pages(rows).orderBy("page_no").collect()]
    assert got == sorted([n for n in names if n.endswith(".jpg")], key=cmp_to_key(less))


def test_numeric_entities_and_characters(spark):
    df = spark.createDataFrame([("&amp;lt; &#233; &#x20AC;&#x1F600; &am &#; &#xD800; a&#65;b; 5",)], "c string")
    assert df.select(T.decode_entities(F.col("c"))).first()[0] == "&lt; é €😀 &am &#; &#xD800; aAb; 5"
    assert df.select(T.count_chars(F.lit("a.b, c!"), T.PUNCT)).first()[0] == 3
    assert df.select(T.reorder_indic(F.lit("िक েক"))).first()[0] == "कि কে"


def test_format_census(spark):
    files = [("a/x.jpg", b"\xff\xd8\xff\xe0" + b"0" * 9), ("a/y.png", b"\xff\xd8\xff"), ("b.png", bytes.fromhex("89504E470D0A1A0A")), ("c.webp", b"RIFF1234WEBPxx"), ("d.cbz", b"PK\x03\x04"), ("e", b""), ("f.jpg", None)]
    out = {(r["ext"], r["sniffed"], r["agrees"], r["n"]) for r in meta.format_census(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert out == {("jpg", "jpg", True, 1), ("png", "jpg", False, 1), ("png", "png", True, 1), ("webp", "webp", True, 1), ("cbz", "cbz", True, 1), ("", "unknown", False, 1), ("jpg", "unknown", False, 1)}


def test_group_hook(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int")
    out = meta.with_group_fn(df, ["k"], lambda p: p.groupby("k", as_index=False)["v"].sum(), "k int, v long")
    assert sorted(map(tuple, out.collect())) == [(1, 5), (2, 5)]


def test_styles_of_levels(spark):
    rows = spark.createDataFrame([(1, "p", p, v) for p, v in (("display", "block"), ("font-family", "x"), ("margin-top", "0"), ("margin-left", "1px"), ("text-indent", "0"), ("color", "red"))], "page_id long, selector string, prop string, value string")
    kept = {n: {r["prop"] for r in styles.select_by_level(rows, n).collect()} for n in range(1, 6)}
    assert kept == {1: {"display"}, 2: {"display", "font-family"}, 3: {"display", "margin-left", "text-indent"}, 4: {"display", "font-family", "margin-left", "text-indent"}, 5: {"display", "font-family", "margin-top", "margin-left", "text-indent", "color"}}


def _streamed(spark, tmp_path, df, build, name):
    df.write.parquet(str(tmp_path / name))
    stream = build(commands.stream_corpus(spark, str(tmp_path / name), df.schema))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.awaitTermination(90)
    return sorted(map(tuple, spark.table(name).collect()))


def test_stream_search_and_pairs_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cat"), (2, "a dog"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "the"), (2, "DOG"), (3, "")], "query_id int, q string")
    assert _streamed(spark, tmp_path, docs, lambda d: commands.stream_search(d, q), "found") == sorted(map(tuple, commands.stream_search(docs, q).collect())) == [(1, 1), (2, 2)]
    events = [(1, 7, 48, "2024-01-01 00:00:00"), (2, 7, 49, "2024-01-01 00:00:09"), (3, 7, 49, "2024-01-01 05:00:00"), (4, 8, 48, "2024-01-01 00:00:00")]
    cmds = spark.createDataFrame(events, "event_id long, user_id long, cmd int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    pairs = lambda d: commands.stream_pairs(d.where("cmd = 48"), d.where("cmd = 49"))
    assert _streamed(spark, tmp_path, cmds, pairs, "pairs") == sorted(map(tuple, pairs(cmds).collect())) == [(7, 1, 2, 9.0)]


def test_crop_bounds_of_drawn_pages(spark):
    def page(no, w, h, ink):
        return [(no, x, y, *([0] * 3 if ink(x, y) else [255] * 3)) for y in range(h) for x in range(w)]

    box = lambda x, y: 20 <= x < 44 and 20 <= y < 35 and (x + y) % 2 == 0
    rows = page(1, 64, 50, box) + page(2, 64, 50, lambda x, y: False) + page(3, 200, 200, lambda x, y: 60 <= x < 150 and 50 <= y < 120 and x % 2 == 0)
    rows += page(4, 200, 200, lambda x, y: x % 2 == 0)
    px = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")
    got = {r["image_id"]: (r["l"], r["t"], r["r"], r["b"]) for r in raster.crop_bounds(px).collect()}
    assert got == {i: scanned([r for r in rows if r[0] == i]) for i in (1, 2, 3, 4)}
    assert got[3] == (55, 40, 155, 130) and got[4] == (0, 0, 200, 200)


def scanned(rows):
    """The four margins of one image in plain Python, strip by strip."""
    lum = {(x, y): (r + g + b) // 3 for _, x, y, r, g, b in rows}
    w, h = max(x for x, _ in lum) + 1, max(y for _, y in lum) + 1
    inner = lambda x, y: w < 100 * x < 99 * w and h // 100 < y and 100 * y < 99 * h
    edge = {(x, y) for x, y in lum if inner(x, y) and abs(lum[x, y] - lum[x - 1, y]) > 8}
    up = lambda a, b: -(-a // b)
    mx, my, lx, ly = up(w * 5, 100), up(h * 5, 100), up(w * 9, 10), up(h * 9, 10)

    def scan(strips, step):
        whites = 0
        for k, (xs, ys) in enumerate(strips):
            if sum((x, y) in edge for x in xs for y in ys) < len(xs) * len(ys) // 100:
                whites += 1
            else:
                return step * max(k - 1, 0)
        return step * max(whites - 1, 0)

    left = scan([(range(x, x + 5), range(my, h - my)) for x in range(0, lx, 5)], 5)
    top = scan([(range(left, w - mx), range(y, y + 10)) for y in range(0, ly, 10)], 10)
    right = w - scan([(range(x, x + 5), range(top, h - my)) for x in range(w - 5, w - lx, -5)], 5)
    bottom = h - scan([(range(left, right), range(y, y + 10)) for y in range(h - 10, h - ly, -10)], 10)
    return *((left, top, right, bottom) if left < right else (0, top, w, bottom)),


def test_segments_of_values(spark):
    px = [(1, x, 0, 7, 7, 7) for x in range(5)] + [(2, x, 0, v, v, v) for x, v in enumerate([10] * 30 + [12] * 10 + [200] * 20)]
    out = raster.segment_histogram(spark.createDataFrame(px, "image_id int, x int, y int, r int, g int, b int"), 2)
    assert sorted((r["image_id"], r["value"], r["n"], r["segment"], r["center"]) for r in out.collect()) == [(1, 7, 5, 0, 7), (2, 10, 30, 0, 11), (2, 12, 10, 0, 11), (2, 200, 20, 1, 200)]


def test_images_that_meet(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 0, 8, 8, 20, 20), (1, 0, 18, 0, 30, 9), (1, 0, 40, 40, 50, 50), (1, 1, 0, 0, 5, 5), (1, 1, 0, 0, 5, 5)]
    out = layout.merge_overlapping_images(spark.createDataFrame(rows, "doc_id long, page_no int, x0 int, y0 int, x1 int, y1 int"))
    assert sorted((r["page_no"], r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) for r in out.collect()) == [(0, 0, 0, 30, 20, 3), (0, 40, 40, 50, 50, 1), (1, 0, 0, 5, 5, 2)]


def test_nested_page(spark):
    rows = [(1, 0, 0, 1, "b"), (1, 0, 0, 0, "a"), (1, 0, 1, 2, "c"), (1, 1, 0, 0, "d")]
    out = layout.nested_page(spark.createDataFrame(rows, "doc_id long, page_no int, block int, line int, text string"))
    assert {r["page_no"]: r["blocks"] for r in out.collect()} == {0: [["a", "b"], ["c"]], 1: [["d"]]}


def test_reading_order(spark):
    he, sign = "אבג", "िकत"
    row = spark.range(1).select(*[T.rtl_runs(F.lit(t)) for t in (f"ab {he}, 12 c", he, "abc", "")], T.reorder_indic(F.lit(sign))).first()
    assert tuple(row) == ("ab  21 ," + he[::-1] + "c", he[::-1], "abc", "", "कित")


def test_breaks_without_patterns(spark):
    words = spark.createDataFrame([("basket",), ("father",), ("radio",), ("bcd",), ("письмо",)], "word string")
    assert sorted(map(tuple, lang.hyphenate_rules(words).collect())) == [("basket", 3), ("radio", 2), ("письмо", 4)]


def test_edits_in_order(spark):
    meta_ = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x")], "doc_id long, tag string, value string")
    edits = [(1, 1, "add", "y"), (1, 2, "add", "z"), (2, 1, "add", "y"), (2, 2, "set", "s"), (2, 3, "add", "t"), (3, 1, "set", "s"), (3, 2, "delete", "")]
    out = meta.apply_edits(meta_, spark.createDataFrame([(d, "a", n, op, v) for d, n, op, v in edits], "doc_id long, tag string, seq int, op string, value string"))
    assert sorted((r["doc_id"], r["value"]) for r in out.collect()) == [(1, "x"), (1, "y"), (1, "z"), (2, "s"), (2, "t")]


def test_typed_values(spark):
    rows = spark.createDataFrame([("1", "a", "1"), ("2", "a", "#00ff10"), ("3", "a", "0xA"), ("4", "a", "NO"), ("5", "a", "#x")], "key string, name string, value string")
    got = [tuple(r)[2:] for r in meta.typed(rows).orderBy("key").collect()]
    assert got == [(1, None, True), (None, 0xFF10, None), (None, 10, None), (None, None, False), (None, None, None)]
    assert meta.with_defaults(rows.where("key = '5'"), 4, 5, True).select("number", "color", "flag").first() == (4, 5, True)


def test_stateful_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:{i // 60:02d}", i % 3, "ab"[i * i % 7 % 2], i * 5 % 4, 1) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, content string, flag long, duration long").withColumn("ts", F.to_timestamp("ts"))
    for part, cut in enumerate(("ts < '2024-01-01 00:20:00'", "ts >= '2024-01-01 00:20:00'")):
        df.where(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, f in (("count", commands.stream_counter), ("runs", commands.stream_runs)):
        q = f(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at-{name}").start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.table("count").collect())) == sorted(map(tuple, commands.resettable_counter(df).collect()))
    batch = commands.merge_equal_runs(df)
    closed = batch.join(batch.groupBy("user_id").agg(F.max("run").alias("last")), "user_id").where("run < last").select("user_id", "run", "content", "n", "duration")
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, closed.collect()))
