"""Palettes of images by median cut, and the pixels they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.raster import color_histogram
from folio.sources.shared import cut
from folio.sources.tables import pixels, read_corpus, with_

IMAGE, BOX, COLOR = ["image_id"], ["image_id", "path"], ["r", "g", "b"]
#: Shares of red, green and blue in a sixteenth of the luminance that palettes are sorted by.
SHARES = (5, 9, 2)


def _spread(c: str):
    return F.max(c) - F.min(c)


def _first_splits(boxes: DataFrame, n: int) -> DataFrame:
    """The boxes(image_id, path, weight) of each image that are split in making n: the heaviest, of equal ones the less deep."""
    order = Window.partitionBy("image_id").orderBy(F.desc("weight"), F.length("path"), "path")
    return boxes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") < n).drop("rank")


def _halved(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """cells of the chosen boxes with a longer path: `0` for the colours before the weighted median along the axis, `1` for the others.

    A colour goes below if the weight before it is less than half, but for the last one. Weights add
    up in two levels, over the 256 values of the axis and over the colours of one value, so that no
    task holds a box."""
    rows = cells.join(chosen.select(*BOX, "weight", "axis"), BOX)
    rows = rows.withColumn("v", F.when(F.col("axis") == "g", F.col("g")).when(F.col("axis") == "r", F.col("r")).otherwise(F.col("b")))
    sums = rows.groupBy(*BOX, "v").agg(F.sum("n").alias("own"))
    before = Window.partitionBy(*BOX).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*BOX, "v", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*BOX, "v").orderBy(*COLOR).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, [*BOX, "v"])
    at = F.col("base") + F.col("part")
    low = (2 * at < F.col("weight")) & (at + F.col("n") < F.col("weight"))
    return rows.select("image_id", F.concat("path", F.when(low, "0").otherwise("1")).alias("path"), *COLOR, "n")


def median_cut(px: DataFrame, n: int = 16, least: int = 0) -> DataFrame:
    """image_id, r, g, b, n, box of each colour of each image: `box` is one of the n or fewer that the image's colours are cut into.

    The heaviest box that has several colours and is wider than `least` along some axis is
    split at the weighted median of its longest axis (green before red before blue), until there
    are n. As a half is lighter than the whole, the boxes split are the heaviest ones of the full
    tree of splits: all images and all boxes that may be among them are split at once, a level
    of the tree in each round, and the n - 1 heaviest are what counts. A round is a written table; a
    task holds 256 sums, the colours of one value, or an image's boxes, n at most in each round.
    An image of one colour has one box; no pixels give no rows."""
    cells = cut(color_histogram(px).select("image_id", F.lit("").alias("path"), *COLOR, "n"), "colors")
    done, leaves = None, None
    for _ in range(n):
        boxes = cells.groupBy(*BOX).agg(F.sum("n").alias("weight"), F.count("*").alias("colors"), *[_spread(c).alias(f"d{c}") for c in COLOR])
        wide = F.greatest("dr", "dg", "db")
        axis = F.when(F.col("dg") == wide, "g").when(F.col("dr") == wide, "r").otherwise("b")
        able = boxes.where((F.col("colors") > 1) & (wide > least)).select(*BOX, "weight", axis.alias("axis"))
        able = _first_splits(able if done is None else done.unionByName(able), n)
        chosen = cut(able if done is None else able.join(done.select(*BOX), BOX, "left_anti"), "splits")
        rest = cells.join(chosen.select(*BOX), BOX, "left_anti")
        leaves = rest if leaves is None else leaves.unionByName(rest)
        if not chosen.limit(1).count():
            break
        done = chosen if done is None else done.unionByName(chosen)
        cells = cut(_halved(cells, chosen), "cells")
    if done is None:
        return leaves.select("image_id", *COLOR, "n", F.col("path").alias("box"))
    # a cell may have gone deeper than the first n - 1 splits: its box is the shortest path that isn't one of them
    first = cut(_first_splits(done, n).select("image_id", F.col("path").alias("short")), "first")
    paths = leaves.select(*BOX).distinct()
    steps = paths.select(*BOX, F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.left("path", i))).alias("short"))
    box = steps.join(first, ["image_id", "short"], "left_anti").groupBy(*BOX).agg(F.min("short").alias("box"))
    return leaves.join(cut(box, "boxes"), BOX).select("image_id", *COLOR, "n", "box")


def palette(cells: DataFrame) -> DataFrame:
    """image_id, idx, pr, pg, pb, weight: the mean colour of each box of `median_cut`, rounded down, in the order of luminance."""
    mean = lambda c: F.expr(f"sum({c} * n) div sum(n)").cast("int").alias(f"p{c}")
    rows = cells.groupBy("image_id", "box").agg(*[mean(c) for c in COLOR], F.sum("n").alias("weight"))
    luma = F.floor(sum(F.col(f"p{c}") * k for c, k in zip(COLOR, SHARES, strict=True)) / sum(SHARES))
    order = Window.partitionBy("image_id").orderBy(luma, "pr", "pg", "pb", "box")
    return rows.select("image_id", (F.row_number().over(order) - 1).alias("idx"), "pr", "pg", "pb", "weight")


def color_index(cells: DataFrame, colors: DataFrame) -> DataFrame:
    """image_id, r, g, b, n, idx of cells(image_id, r, g, b, n): the nearest colour of the image's palette, of equally near ones the first.

    A palette is one row of the join, so that an image of many colours can be split among tasks."""
    held = cut(colors.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "pr", "pg", "pb"))).alias("p")), "palettes")
    far = lambda x: sum((F.col(c) - x[f"p{c}"]) * (F.col(c) - x[f"p{c}"]) for c in COLOR)
    nearest = F.array_min(F.transform("p", lambda x: F.struct(far(x).alias("d"), x["idx"].alias("idx"))))["idx"]
    return cells.join(held, "image_id").select("image_id", *COLOR, "n", nearest.alias("idx"))


def quantize(px: DataFrame, n: int = 16, least: int = 0) -> DataFrame:
    """image_id, x, y, idx, pr, pg, pb: each pixel's place in its image's palette of n colours at most, and that colour."""
    cells = cut(median_cut(px, n, least), "cut")
    colors = cut(palette(cells), "palette")
    index = color_index(cells, colors).join(colors, ["image_id", "idx"]).select("image_id", *COLOR, "idx", "pr", "pg", "pb")
    return px.join(cut(index, "index"), ["image_id", *COLOR]).select("image_id", "x", "y", "idx", "pr", "pg", "pb")


def _px(s, d):
    return pixels(read_corpus(s, d, "embeddings"))


def _cut_sql(n: int) -> str:
    return f"""{with_("pixels").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT image_id, '' AS path, r, g, b, count(*)::BIGINT AS n FROM pixels GROUP BY ALL UNION ALL
  SELECT image_id, path || CASE WHEN 2 * low < s AND low + n < s THEN '0' ELSE '1' END, r, g, b, n FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, path ORDER BY CASE WHEN dg >= greatest(dr, db) THEN g WHEN dr >= db THEN r ELSE b END, r, g, b) - n AS low FROM (
    SELECT *, count(*) OVER w AS k, sum(n) OVER w AS s, max(r) OVER w - min(r) OVER w AS dr, max(g) OVER w - min(g) OVER w AS dg, max(b) OVER w - min(b) OVER w AS db FROM c WINDOW w AS (PARTITION BY image_id, path)) WHERE k > 1)),
f AS (SELECT image_id, path, row_number() OVER (PARTITION BY image_id ORDER BY sum(n) DESC, length(path), path) AS rank FROM c GROUP BY image_id, path HAVING count(*) > 1),
t AS (SELECT image_id, path FROM f WHERE rank < {n}),
l AS (SELECT c.* FROM c LEFT JOIN t USING (image_id, path) LEFT JOIN t u ON u.image_id = c.image_id AND u.path = left(c.path, length(c.path) - 1) WHERE t.path IS NULL AND (c.path = '' OR u.path IS NOT NULL)),
m AS (SELECT image_id, path, CAST(sum(r * n) // sum(n) AS INTEGER) AS pr, CAST(sum(g * n) // sum(n) AS INTEGER) AS pg, CAST(sum(b * n) // sum(n) AS INTEGER) AS pb, CAST(sum(n) AS BIGINT) AS weight FROM l GROUP BY image_id, path),
p AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY (5 * pr + 9 * pg + 2 * pb) // 16, pr, pg, pb, path) - 1 AS INTEGER) AS idx, pr, pg, pb, weight FROM m)"""


REGISTERED = {
    "palette": (lambda s, d: palette(median_cut(_px(s, d))), f"{_cut_sql(16)} SELECT * FROM p"),
    "quantize": (lambda s, d: quantize(_px(s, d), 8), f"""{_cut_sql(8)}, i AS (SELECT x.image_id, x.r, x.g, x.b, min(((x.r - pr) * (x.r - pr) + (x.g - pg) * (x.g - pg) + (x.b - pb) * (x.b - pb)) * 1000 + idx) % 1000 AS idx FROM (SELECT DISTINCT image_id, r, g, b FROM pixels) x JOIN p USING (image_id) GROUP BY ALL)
SELECT image_id, x, y, CAST(idx AS INTEGER) AS idx, pr, pg, pb FROM pixels JOIN i USING (image_id, r, g, b) JOIN p USING (image_id, idx)"""),
}
