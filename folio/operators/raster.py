"""Comparisons and statistics of images held as rows of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import other_pixels, pixels, read_corpus, with_

KEY = ["image_id", "x", "y"]


def edge_map(px: DataFrame, step: int = 8) -> DataFrame:
    """image_id, x, y, edge: whether the luma differs from the left neighbour's by more than step; never in the border of 1 %."""
    luma = F.expr("(r + g + b) div 3")
    rows = px.withColumn("luma", luma)
    left = F.lag("luma").over(Window.partitionBy("image_id", "y").orderBy("x"))
    rows = rows.select(*KEY, F.coalesce(F.abs(F.col("luma") - left) > step, F.lit(False)).alias("edge")).join(sizes(px), "image_id")
    border = (100 * F.col("x") <= F.col("w")) | (100 * F.col("x") >= 99 * F.col("w")) | (F.col("y") <= F.expr("h div 100")) | (100 * F.col("y") >= 99 * F.col("h"))
    return rows.select(*KEY, (F.col("edge") & ~border).alias("edge"))


def sizes(px: DataFrame) -> DataFrame:
    """image_id, w, h."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def crop_bounds(px: DataFrame) -> DataFrame:
    """image_id, l, t, r, b in pixels: where each margin ends.

    Strips (5 columns or 10 rows) are taken from each edge inwards, up to 90 % of the image and
    without the margins of 5 %; one is white with fewer edge pixels than 1 % of its area. The
    bound lies a strip before the first dark one; nothing is cut where the first is dark. Left,
    top, right, bottom each leave out what the ones before have cut; a box that is turned
    round stands for the whole side."""
    edges = edge_map(px).where("edge")
    out = sizes(px).withColumns({"mx": F.ceil(F.col("w") * 5 / 100), "my": F.ceil(F.col("h") * 5 / 100), "lx": F.ceil(F.col("w") * 9 / 10), "ly": F.ceil(F.col("h") * 9 / 10)})
    x, y, w, h = (F.col(c) for c in "xywh")
    #            bound, step, strip of a pixel, strips, from, to (of the other axis)
    scans = (
        ("l", 5, F.floor(x / 5), F.ceil(F.col("lx") / 5), y, F.col("my"), h - F.col("my")),
        ("t", 10, F.floor(y / 10), F.ceil(F.col("ly") / 10), x, F.col("l"), w - F.col("mx")),
        ("r", 5, F.floor((w - 1 - x) / 5), F.ceil(F.col("lx") / 5) - 1, y, F.col("t"), h - F.col("my")),
        ("b", 10, F.floor((h - 1 - y) / 10), F.ceil(F.col("ly") / 10) - 1, x, F.col("l"), F.col("r")),
    )
    for name, step, strip, strips, across, lo, hi in scans:
        least = F.floor((hi - lo) * step / 100)
        rows = edges.join(out, "image_id").where((across >= lo) & (across < hi) & (strip < strips))
        dark = rows.groupBy("image_id", strip.alias("k"), least.alias("least")).agg(F.count("*").alias("n")).where("n >= least")
        first = dark.groupBy("image_id").agg(F.min("k").alias("k"))
        out = out.join(first, "image_id", "left")
        cut = step * F.greatest(F.when(least < 1, 0).otherwise(F.coalesce("k", strips)) - 1, F.lit(0))
        out = out.withColumn(name, {"r": w - cut, "b": h - cut}.get(name, cut)).drop("k")
        # a row for each image; each bound reads the ones before twice, so they are settled
        out = _settled(out)
    whole_x, whole_y = F.col("l") >= F.col("r"), F.col("t") >= F.col("b")
    return out.select("image_id", *[F.when(turned, full).otherwise(F.col(c)).alias(c) for c, turned, full in (("l", whole_x, F.lit(0)), ("t", whole_y, F.lit(0)), ("r", whole_x, w), ("b", whole_y, h))])


def _settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint where the session names a folder for them, else as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def segment_histogram(px: DataFrame, k: int = 4, rounds: int = 6, still: int = 5) -> DataFrame:
    """image_id, value, n, segment, center of each luma value: weighted means of k segments in one dimension.

    Even seeds, the nearest centre in order (of equally near ones the lower), whole-number centres, `rounds` rounds or
    less than `still` of movement in all. A fold over the 256 bins, at most, of each image."""
    bins = px.groupBy("image_id", F.expr("(r + g + b) div 3").cast("int").alias("value")).agg(F.count("*").alias("n"))
    held = bins.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("bins"))
    lo, span = F.col("bins")[0]["value"], F.element_at("bins", -1)["value"] - F.col("bins")[0]["value"]
    seeds = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (lo + F.floor((2 * i + 1) * span / (2 * k))).cast("long"))

    def nearest(v: Column, centers: Column) -> Column:
        away = F.transform(centers, lambda c: F.abs(v - c))
        return (F.array_position(away, F.array_min(away)) - 1).cast("int")

    def round_(acc: Column, _: Column) -> Column:
        zero = F.lit(0).cast("long")
        placed = F.transform("bins", lambda b: F.struct(b["n"].alias("n"), b["value"].alias("value"), nearest(b["value"], acc["now"]).alias("at")))
        sums = F.transform(F.array(placed), lambda p: F.transform(acc["now"], lambda c, i: F.aggregate(F.filter(p, lambda b: b["at"] == i), F.struct(zero.alias("n"), zero.alias("s")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["s"] + b["n"] * b["value"]).alias("s")), lambda a: F.when(a["n"] > 0, F.floor((a["s"] + F.floor(a["n"] / 2)) / a["n"])).otherwise(c))))[0]
        moved = F.struct(acc["now"].alias("was"), sums.alias("now"))
        done = F.aggregate(F.zip_with(acc["was"], acc["now"], lambda x, y: F.abs(x - y)), zero, lambda a, x: a + x) < still
        return F.when(acc["was"].isNotNull() & done, acc).otherwise(moved)

    start = F.struct(F.lit(None).cast("array<bigint>").alias("was"), seeds.alias("now"))
    rows = held.select("image_id", "bins", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("x"))
    placed = F.transform("bins", lambda b: F.struct(b["value"].alias("value"), b["n"].alias("n"), nearest(b["value"], F.col("x.was")).alias("segment")))
    rows = rows.select("image_id", "x.now", F.explode(placed).alias("b"))
    return rows.select("image_id", "b.*", F.get("now", F.col("b.segment")).cast("int").alias("center"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY, *[F.col(c).alias(f"{c}2") for c in "rgb"]), KEY)


def image_psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, psnr in dB; 99 for equal images."""
    sse = sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "rgb")
    s = _both(a, b).groupBy("image_id").agg(F.sum(sse).alias("sse"), (F.count("*") * 3).alias("n"))
    return s.select("image_id", F.when(F.col("sse") == 0, 99.0).otherwise(F.round(10 * F.log10(255.0 * 255.0 * F.col("n") / F.col("sse")), 6)).alias("psnr"))


def diff_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).groupBy("image_id").agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}2"))).alias(f"max_{c}") for c in "rgb"])


def similar_within(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    close = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"]) <= most
    return _both(a, b).groupBy("image_id").agg(F.bool_and(close).alias("similar"))


def color_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def local_min(a: DataFrame, b: DataFrame, radius: int = 2) -> DataFrame:
    """image_id, sse: for each pixel of a the least squared difference of red to b within the radius, summed.

    Pixels of b are copied to the columns beside them; along a column a window takes in the rows above and below."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    beside = b.select("image_id", "x", "y", F.col("r").alias("r2"), F.explode(steps).alias("dx")).select("image_id", (F.col("x") + F.col("dx")).alias("x"), "y", "r2")
    both = a.select(*KEY, "r").unionByName(beside, allowMissingColumns=True)
    around = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = both.withColumn("near", F.collect_list("r2").over(around)).where(F.col("r").isNotNull() & (F.size("near") > 0))
    d = F.array_min(F.transform("near", lambda r2: (F.col("r") - r2) * (F.col("r") - r2)))
    best = rows.groupBy(*KEY).agg(F.min(d).alias("d"))
    return best.groupBy("image_id").agg(F.sum("d").alias("sse"))


#: The hat-shaped weights of a window of 7.
HAT = (1, 2, 3, 4, 3, 2, 1)


def image_ssim(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, ssim in dB of red: weighted moments of each pixel's window of 7 by 7, clipped at the edges; too dark windows count as equal.

    Columns, then rows: two sums over 7 neighbours, each within a line of pixels, instead of 49 copies."""
    j = a.select(*KEY, F.col("r").cast("long").alias("p")).join(b.select(*KEY, F.col("r").cast("long").alias("q")), KEY)
    rows = j.select(*KEY, F.lit(1).cast("long").alias("w"), "p", "q", (F.col("p") * F.col("p")).alias("pp"), (F.col("p") * F.col("q")).alias("pq"), (F.col("q") * F.col("q")).alias("qq"))
    for by, along in (("y", "x"), ("x", "y")):
        o = Window.partitionBy("image_id", by).orderBy(along)
        sums = [sum((h * F.coalesce(F.lag(c, 3 - i).over(o) if i < 3 else F.lead(c, i - 3).over(o) if i > 3 else F.col(c), F.lit(0)) for i, h in enumerate(HAT)), F.lit(0)).alias(c) for c in ("w", "p", "q", "pp", "pq", "qq")]
        rows = rows.select(*KEY, *sums)
    n, x, y = (F.col(c).cast("double") for c in ("w", "p", "q"))
    c1, c2, xx, yy = 20 * n * n, 60 * n * n, x * x, y * y
    num = (2 * F.greatest(F.lit(0.0), F.col("pq") * n - x * y) + c2) / 256
    den = (F.col("pp") * n - xx + F.col("qq") * n - yy + c2) / 256
    one = F.when(xx + yy >= 64 * n * n, (2 * x * y + c1) * F.floor(num) / ((xx + yy + c1) * F.floor(den))).otherwise(1.0)
    s = rows.groupBy("image_id").agg(F.avg(F.round(one, 9).cast("decimal(20,9)")).cast("double").alias("s"))
    return s.select("image_id", F.when(F.col("s") < 1, F.round(-10 * F.log10(1 - F.col("s")), 5)).otherwise(99.0).alias("ssim"))


def to_luma(r: str, g: str, b: str) -> Column:
    return F.expr(f"({r} + {g} + {b}) div 3")


def to_luma_709(r: str, g: str, b: str) -> Column:
    """Luminance by the weights of BT.709, rounded: in ten-thousandths, so that it is exact."""
    return F.expr(f"(2126 * {r} + 7152 * {g} + 722 * {b} + 5000) div 10000")


def invert(px: DataFrame) -> DataFrame:
    """px with each channel's distance from 255."""
    return px.withColumns({c: 255 - F.col(c) for c in "rgb"})


def diff_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, x, y, r: the difference of red, scaled so that the image's largest becomes 255."""
    d = F.abs(F.col("r") - F.col("r2"))
    rows = _both(a, b).select(*KEY, d.alias("d"))
    most = rows.groupBy("image_id").agg(F.max("d").alias("most"))
    factor = F.expr("CASE WHEN most > 0 THEN 16711680 div most ELSE 0 END")
    return rows.join(most, "image_id").select(*KEY, F.floor((F.col("d") * factor + 32768) / 65536).alias("r"))


def _a(s, d):
    return pixels(read_corpus(s, d, "embeddings"))


def _ab(f):
    return lambda s, d: f(_a(s, d), other_pixels(_a(s, d)))


_P = with_("pixels").rstrip()
_J = "FROM pixels a JOIN pixels_b b USING (image_id, x, y)"

#: Rounds of the weighted means, a row of centres for each image and round.
_SEGMENTS = f"""{_P.replace("WITH ", "WITH RECURSIVE ", 1)}, h AS (SELECT image_id, (r + g + b) // 3 AS value, count(*) AS n FROM pixels GROUP BY ALL),
st AS (SELECT image_id, 0 AS turn, NULL::BIGINT[] AS was, list_transform(range(4), lambda i: CAST(min(value) + (2 * i + 1) * (max(value) - min(value)) // 8 AS BIGINT)) AS now FROM h GROUP BY image_id UNION ALL
  SELECT image_id, any_value(turn) + 1, any_value(now), list(CAST(CASE WHEN w > 0 THEN (t + w // 2) // w ELSE now[i] END AS BIGINT) ORDER BY i) FROM (
    SELECT image_id, turn, now, i, coalesce(sum(n) FILTER (WHERE z = i), 0) AS w, coalesce(sum(n * value) FILTER (WHERE z = i), 0) AS t FROM (
      SELECT st.*, value, n, list_position(list_transform(now, lambda c: abs(value - c)), list_min(list_transform(now, lambda c: abs(value - c)))) AS z FROM st JOIN h USING (image_id)
      WHERE turn < 6 AND (was IS NULL OR list_sum(list_transform(range(1, 5), lambda j: abs(was[j] - now[j]))) >= 5)) q, range(1, 5) u(i) GROUP BY image_id, turn, now, i) GROUP BY image_id),
f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY turn DESC) = 1),
a AS (SELECT image_id, value, n, now, list_position(list_transform(was, lambda c: abs(value - c)), list_min(list_transform(was, lambda c: abs(value - c)))) AS z FROM h JOIN f USING (image_id))
SELECT image_id, CAST(value AS INTEGER) AS value, n, CAST(z - 1 AS INTEGER) AS segment, CAST(now[z] AS INTEGER) AS center FROM a"""

REGISTERED = {
    "luma": (lambda s, d: _a(s, d).select(*KEY, to_luma("r", "g", "b").alias("mean"), to_luma_709("r", "g", "b").alias("luma")), f"{_P} SELECT image_id, x, y, CAST((r + g + b) // 3 AS BIGINT) AS mean, CAST((2126 * r + 7152 * g + 722 * b + 5000) // 10000 AS BIGINT) AS luma FROM pixels"),
    "invert": (lambda s, d: invert(_a(s, d)), f"{_P} SELECT image_id, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM pixels"),
    "edge_map": (lambda s, d: edge_map(_a(s, d)), f"""{_P}, e AS (SELECT image_id, x, y, coalesce(abs((r + g + b) // 3 - lag((r + g + b) // 3) OVER (PARTITION BY image_id, y ORDER BY x)) > 8, false) AS edge, max(x) OVER (PARTITION BY image_id) + 1 AS w, max(y) OVER (PARTITION BY image_id) + 1 AS h FROM pixels)
SELECT image_id, x, y, edge AND NOT (100 * x <= w OR 100 * x >= 99 * w OR y <= h // 100 OR 100 * y >= 99 * h) AS edge FROM e"""),
    "crop_bounds": (lambda s, d: crop_bounds(_a(s, d)), None),
    "segment_histogram": (lambda s, d: segment_histogram(_a(s, d)), _SEGMENTS),
    "image_psnr": (_ab(image_psnr), f"{_P} SELECT image_id, CASE WHEN sum((a.r - b.r) * (a.r - b.r)) = 0 THEN 99.0 ELSE round(10 * log10(CAST(255 * 255 AS DOUBLE) * count(*) * 3 / sum((a.r - b.r) * (a.r - b.r))), 6) END AS psnr {_J} GROUP BY image_id"),
    "image_ssim": (_ab(image_ssim), f"""{_P}, j AS (SELECT a.image_id, a.x, a.y, CAST(1 AS BIGINT) AS w, CAST(a.r AS BIGINT) AS p, CAST(b.r AS BIGINT) AS q {_J}),
h AS (SELECT i - 4 AS o, v AS h FROM (SELECT unnest([1, 2, 3, 4, 3, 2, 1]) AS v, unnest(range(1, 8)) AS i)),
k AS (SELECT a.image_id, a.x, a.y, sum(u.h * t.h) AS w, sum(u.h * t.h * b.p) AS p, sum(u.h * t.h * b.q) AS q, sum(u.h * t.h * b.p * b.p) AS pp, sum(u.h * t.h * b.p * b.q) AS pq, sum(u.h * t.h * b.q * b.q) AS qq
  FROM j a, h u, h t JOIN j b ON b.image_id = a.image_id AND b.x = a.x + u.o AND b.y = a.y + t.o GROUP BY a.image_id, a.x, a.y),
f AS (SELECT image_id, w::DOUBLE AS n, p::DOUBLE AS x, q::DOUBLE AS y, pp::DOUBLE AS pp, pq::DOUBLE AS pq, qq::DOUBLE AS qq FROM k),
o AS (SELECT image_id, CASE WHEN x * x + y * y >= 64 * n * n THEN (2 * x * y + 20 * n * n) * floor((2 * greatest(0, pq * n - x * y) + 60 * n * n) / 256) / ((x * x + y * y + 20 * n * n) * floor((pp * n - x * x + qq * n - y * y + 60 * n * n) / 256)) ELSE 1 END AS s FROM f),
m AS (SELECT image_id, CAST(avg(round(s, 9)) AS DOUBLE) AS s FROM o GROUP BY image_id)
SELECT image_id, CASE WHEN s < 1 THEN round(-10 * log10(1 - s), 5) ELSE 99.0 END AS ssim FROM m"""),
    "diff_map": (_ab(diff_map), f"{_P}, d AS (SELECT image_id, x, y, abs(a.r - b.r) AS d {_J}), m AS (SELECT *, max(d) OVER (PARTITION BY image_id) AS most FROM d) SELECT image_id, x, y, CAST(floor((d * CASE WHEN most > 0 THEN 16711680 // most ELSE 0 END + 32768) / 65536.0::DOUBLE) AS BIGINT) AS r FROM m"),
    "diff_stats": (_ab(diff_stats), f"{_P} SELECT image_id, " + ", ".join(f"max(abs(a.{c} - b.{c})) AS max_{c}" for c in "rgb") + f" {_J} GROUP BY image_id"),
    "similar_within": (_ab(lambda a, b: similar_within(a, b, 1)), f"{_P} SELECT image_id, bool_and(greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) <= 1) AS similar {_J} GROUP BY image_id"),
    "color_histogram": (lambda s, d: color_histogram(_a(s, d)), f"{_P} SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL"),
    "image_local_min": (_ab(local_min), f"{_P}, m AS (SELECT a.image_id, a.x, a.y, min((a.r - b.r) * (a.r - b.r)) AS d FROM pixels a JOIN (SELECT image_id, x + dx AS x, y + dy AS y, r FROM pixels_b, range(-2, 3) u(dx), range(-2, 3) v(dy)) b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY ALL) SELECT image_id, CAST(sum(d) AS BIGINT) AS sse FROM m GROUP BY image_id"),
}
