"""Outlines, links and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import SPACES, decode_entities, norm_spaces, strip_bracketed_number
from folio.operators.search import _BASE, _HITS, search_hits
from folio.operators.paging import positions
from folio.sources.shared import cut
from folio.sources.tables import doc_pages, lines, read_corpus, search_queries, with_

UP_TO = (Window.unboundedPreceding, 0)


def plain(c: Column) -> Column:
    """Text of a piece of html: tags go, entities are decoded, white space is collapsed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"<[^>]*>", "")), r"[\s\x{A0}]+", " "))


#: A heading ends at the next end tag of any heading, as browsers have it.
HEADING = r"(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]\s*>"
#: An anchor with its target in either kind of quotes, and what it holds.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*')[^>]*>(.*?)</a\s*>"""


def _found(pattern: str) -> Column:
    """(a, b): the two groups of each match in html."""
    return F.arrays_zip(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(c) for i, c in ((1, "a"), (2, "b"))])


def extract_headings(pages: DataFrame, most: int = 150) -> DataFrame:
    """page_id, ord, level, title of the h1 to h6 of html, in order; whatever the case of the tags and the markup inside."""
    rows = pages.select("page_id", F.posexplode(_found(HEADING)).alias("ord", "x"))
    return rows.select("page_id", "ord", F.col("x.a").cast("int").alias("level"), F.left(plain(F.col("x.b")), F.lit(most)).alias("title"))


def line_headings(rows: DataFrame, short: int = 40) -> DataFrame:
    """doc_id, ord, pos, level, title: short lines as headings of level 1 to 3."""
    rows = rows.where((F.col("len") < short) & (F.col("len") > 0))
    return rows.select("doc_id", F.col("line_no").alias("ord"), F.col("start").alias("pos"), (F.col("line_no") % 3 + 1).alias("level"), F.col("line").alias("title"))


def _levels(outline: DataFrame) -> list[int]:
    """The levels in use, in order: a number for each, so any depth of outline."""
    return sorted(r["level"] for r in outline.select("level").distinct().collect() if r["level"] is not None)


def outline_parents(outline: DataFrame) -> DataFrame:
    """doc_id, ord, level, parent, child_no: the last earlier heading of a lower level, and the number of the heading among its parent's. One sort for each document."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(w)) for k in _levels(outline)]
    rows = outline.select("doc_id", "ord", "level", F.greatest(F.lit(None).cast("int"), *above, F.lit(None).cast("int")).alias("parent"))
    return rows.withColumn("child_no", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("ord")) - 1)


def chapter_of(pos: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, pos, chapter: titles of the enclosing headings, `A / B`, of strictly growing level, of any depth."""
    rows = outline.select("doc_id", "pos", F.lit(0).alias("kind"), "level", "title").unionByName(pos.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")))
    w = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(*UP_TO)
    levels = _levels(outline)
    at = [F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w).alias(f"l{i}") for i, k in enumerate(levels)]
    rows = rows.select("*", *at).where("kind = 1")
    parts, last = [], F.lit(-1).cast("long")
    for i in range(len(levels)):  # a heading counts unless one of a lower level came after it
        parts.append(F.when(F.col(f"l{i}.pos") >= last, F.col(f"l{i}.title")))
        last = F.greatest(last, F.col(f"l{i}.pos"))
    return rows.select("doc_id", "pos", F.concat_ws(" / ", *parts).alias("chapter") if parts else F.lit("").alias("chapter"))


def hit_chapters(hits: DataFrame, outline: DataFrame) -> DataFrame:
    """hits(doc_id, pos, ...) with the chapter of each; every position is looked up once, however many hits it has."""
    return hits.join(chapter_of(hits.select("doc_id", "pos").distinct(), outline), ["doc_id", "pos"])


def outline_tiered(outline: DataFrame) -> DataFrame:
    """doc_id, ord, level, title of the first level that a document has any heading of."""
    first = F.min("level").over(Window.partitionBy("doc_id"))
    return outline.withColumn("first", first).where("level = first").select("doc_id", "ord", "level", "title")


def links(pages: DataFrame) -> DataFrame:
    """page_id, ord, href, text of the anchors of html; whatever the case of the tags, the quotes and the markup inside."""
    rows = pages.select("page_id", F.posexplode(_found(ANCHOR)).alias("ord", "x"))
    href = F.substring("x.a", F.lit(2), F.length("x.a") - 2)
    return rows.select("page_id", "ord", decode_entities(href).alias("href"), plain(F.col("x.b")).alias("text"))


def classify_links(rows: DataFrame) -> DataFrame:
    kind = F.when(F.startswith("href", F.lit("#")), "internal").when(F.col("href").rlike("^https?:"), "external").when(F.startswith("href", F.lit("/")), "site").otherwise("unknown")
    return rows.select("page_id", "ord", "href", kind.alias("kind"))


def resolve_links(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """page_id, ord, href, target: the first page whose path the link names, null if none."""
    to = anchors.groupBy("path").agg(F.min("page_id").alias("target"))
    return rows.join(to, rows["href"] == to["path"], "left").select(rows["page_id"], "ord", "href", "target")


def broken_links(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The links within the site (`#x`, `/x`) that name no page."""
    return rows.where(F.col("href").rlike("^[#/]")).join(anchors.select("path").distinct(), rows["href"] == F.col("path"), "left_anti")


def link_degrees(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """page_id, n_out, n_in of pages with a resolved link."""
    edges = resolve_links(rows, anchors).where("target IS NOT NULL")
    out = edges.groupBy("page_id").agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("target").alias("page_id")).agg(F.count("*").alias("i"))
    return out.join(into, "page_id", "full").select("page_id", F.coalesce("o", F.lit(0)).alias("n_out"), F.coalesce("i", F.lit(0)).alias("n_in"))


def note_refs(rows: DataFrame) -> DataFrame:
    """page_id, num, href: links whose text is a number, the first of each target."""
    refs = rows.withColumn("num", strip_bracketed_number(F.col("text"))).where("num IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("page_id", "href").orderBy("ord"))
    return refs.withColumn("n", first).where("n = 1").select("page_id", "num", "href")


def notes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs(doc_id, num, line_no, target) and notes(doc_id, num, line_no, line) of lines: line 9 n + 8 is the body of note n, referred to from line 3 n."""
    bodies = rows.where("line_no % 9 = 8").select("doc_id", F.floor(F.col("line_no") / 9).cast("int").alias("num"), "line_no", "line")
    return bodies.select("doc_id", "num", (3 * F.col("num")).alias("line_no"), F.col("line_no").alias("target")), bodies


def resolve_notes(refs: DataFrame, rows: DataFrame, most: int = 250) -> DataFrame:
    """doc_id, num, body: the target line and those behind it up to the next note or an empty line, joined by spaces; cut at `most` and marked `...`."""
    # as-of: a line belongs to the last target at or before it; one sort of a document's lines and targets
    both = rows.select("doc_id", "line_no", "line", F.lit(1).alias("kind")).unionByName(refs.select("doc_id", F.col("target").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(0).alias("kind")).distinct())
    w = Window.partitionBy("doc_id").orderBy("line_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("target", F.last(F.when(F.col("kind") == 0, F.col("line_no")), ignorenulls=True).over(w)).where("kind = 1 AND target IS NOT NULL")
    stops = j.where("trim(line) = ''").groupBy("doc_id", "target").agg(F.min("line_no").alias("stop"))
    held = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    body = F.array_join("h.line", " ")
    bodies = j.join(stops, ["doc_id", "target"], "left").where("stop IS NULL OR line_no < stop").groupBy("doc_id", "target").agg(held.alias("h"))
    out = refs.select("doc_id", "num", "target").join(bodies, ["doc_id", "target"])
    return out.select("doc_id", "num", F.when(F.length(body) > most, F.concat(F.left(body, F.lit(most)), F.lit("..."))).otherwise(body).alias("body"))


def allowed_notes(refs: DataFrame, asides: DataFrame) -> DataFrame:
    """The references whose target is one of asides(doc_id, target)."""
    return refs.join(asides, ["doc_id", "target"], "left_semi")


def reflow_text(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, page_no, html: paragraphs of the lines that drop_running_heads kept: spaces normalised, quotes made plain, markup escaped."""
    text = norm_spaces(F.translate("line", "\u2018\u2019\u201c\u201d", "''\"\""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    j = kept.select("doc_id", "page_no", F.col("block_no").alias("line_no")).join(rows.select("doc_id", "line_no", text.alias("p")), ["doc_id", "line_no"]).where("trim(p) <> ''")
    return j.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "p"))).alias("h")).select("doc_id", "page_no", F.array_join(F.transform("h", lambda x: F.concat(F.lit("<p>"), x["p"], F.lit("</p>"))), "").alias("html"))


def size_ladder(styles: DataFrame) -> DataFrame:
    """key, h1 to h6: thresholds at sixths between the default and the largest size of styles(key, size, is_default); null without a default or where it is the larger."""
    s = styles.groupBy("key").agg(F.max("size").alias("most"), F.max(F.when(F.col("is_default"), F.col("size"))).alias("base"))
    step = F.floor((F.col("most") - F.col("base")) / 6)
    return s.select("key", *[F.when(F.col("most") >= F.col("base"), F.col("base") + step * (6 - k)).alias(f"h{k}") for k in range(1, 7)])


def first_refs(rows: DataFrame) -> DataFrame:
    """page_id, n, href: distinct targets of a page in first-seen order."""
    once = rows.groupBy("page_id", "href").agg(F.min("ord").alias("ord"))
    return once.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1).alias("n"), "href")


def resolve_relations(rels: DataFrame, catalog: DataFrame) -> DataFrame:
    """id, name of image and thumbnail rels(archive, id, type, target): the first entry of its archive that contains the target.

    Each distinct target of an archive is looked up once, so what is held grows with the entries and not with entries
    times relations. The targets are written, so that Spark sees how few they are and leaves the entries where they lie."""
    target = F.regexp_replace("target", r"^(\./|/)", "")
    own = rels.where(F.col("type").rlike("image|thumbnail")).select("archive", "id", target.alias("target"))
    asked = cut(own.select("archive", "target").distinct(), "targets")
    found = catalog.join(asked, "archive").where(F.contains("name", F.col("target")))
    first = found.groupBy("archive", "target").agg(F.min_by("name", "entry_no").alias("name"), F.min("entry_no").alias("entry_no"))
    # an id may stand in several archives: the first of all entries found
    return own.join(cut(first, "first"), ["archive", "target"]).groupBy("id").agg(F.min_by("name", "entry_no").alias("name"))


def drop_running_heads(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page_no, block_no, n_lines, n_chars) without short single lines at the ends of pages of three blocks or more."""
    page = ["doc_id", "page_no"]
    up, down = Window.partitionBy(*page).orderBy("block_no"), Window.partitionBy(*page).orderBy(F.desc("block_no"))
    rows = blocks.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)}).withColumn("n", F.col("a") + F.col("z") - 1)
    head = (F.col("a") == 1) & (F.col("n_chars") < 20)
    foot = (F.col("z") == 1) & (F.col("n_chars") < 10)
    return rows.where(~((F.col("n") >= 3) & (F.col("n_lines") == 1) & (head | foot))).drop("a", "z", "n")


def doc_stats(docs: DataFrame) -> DataFrame:
    """source, lang, docs, chars, empty with subtotals (null: all)."""
    return docs.rollup("source", "lang").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.trim("text") == "").alias("empty"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """Each line of a page as its own block."""
    return rows.select("doc_id", F.floor(F.col("line_no") / 20).cast("int").alias("page_no"), F.col("line_no").alias("block_no"), F.lit(1).alias("n_lines"), F.col("len").alias("n_chars"))


def _lines(s, d):
    return lines(read_corpus(s, d, "documents").select("doc_id", "text"))


def _links(s, d):
    return links(read_corpus(s, d, "pages"))


def _anchors(s, d):
    return read_corpus(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/?#]*)", 1).alias("path"))


def _positions(s, d):
    return positions(read_corpus(s, d, "documents").select("doc_id", "text"))


def _hits(s, d):
    """Hits of the search queries, with offsets in the document."""
    pages = doc_pages(read_corpus(s, d, "documents").select("doc_id", "text"))
    hits = search_hits(pages, search_queries(s)).join(pages.select("doc_id", "page_no", "start"), ["doc_id", "page_no"])
    return hits.select("doc_id", (F.col("start") + F.col("pos")).alias("pos"), "query_id")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_decoded(c: str) -> str:
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        c = f"replace({c}, '{name}', {char})"
    return c


_PLAIN = lambda c: f"trim(regexp_replace({_sql_decoded(f"regexp_replace({c}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"
_ALL = lambda rx: f"unnest(regexp_extract_all(html, {_sql(rx)}, 1)) AS a, unnest(regexp_extract_all(html, {_sql(rx)}, 2)) AS b, generate_subscripts(regexp_extract_all(html, {_sql(rx)}, 1), 1) AS i"
_LK = f"links AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, {_sql_decoded('substring(a, 2, length(a) - 2)')} AS href, {_PLAIN('b')} AS text FROM (SELECT page_id, {_ALL(ANCHOR)} FROM pages))"
_AN = r"anchors AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^/?#]*)', 1) AS path FROM pages)"
_H = "heads AS (SELECT doc_id, line_no AS ord, start AS pos, line_no % 3 + 1 AS level, line AS title FROM lines WHERE len < 40 AND len > 0)"
_L = with_("lines").rstrip()
_HIT = """spots AS (SELECT doc_id, query_id, CAST(start + pos AS BIGINT) AS pos FROM (SELECT doc_id, page_no, query_id, pos FROM hits WHERE hit_no < k - 1) JOIN doc_pages USING (doc_id, page_no)),
x AS (SELECT p.doc_id, p.pos, max(h.pos) FILTER (WHERE level = 1) AS p1, max(h.pos) FILTER (WHERE level = 2) AS p2, max(h.pos) FILTER (WHERE level = 3) AS p3,
  arg_max(title, h.pos) FILTER (WHERE level = 1) AS t1, arg_max(title, h.pos) FILTER (WHERE level = 2) AS t2, arg_max(title, h.pos) FILTER (WHERE level = 3) AS t3
  FROM (SELECT DISTINCT doc_id, pos FROM spots) p LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.pos <= p.pos GROUP BY p.doc_id, p.pos)
SELECT doc_id, pos, query_id, concat_ws(' / ', t1, CASE WHEN NOT coalesce(p1 > p2, false) THEN t2 END, CASE WHEN NOT (coalesce(p1 > p3, false) OR coalesce(p2 > p3, false)) THEN t3 END) AS chapter FROM spots JOIN x USING (doc_id, pos)"""

_NOTE = "bodies AS (SELECT doc_id, CAST(line_no // 9 AS INTEGER) AS num, line_no AS target, line FROM lines WHERE line_no % 9 = 8)"
_KEPT = "kept AS (SELECT doc_id, line_no // 20 AS page_no, line_no FROM lines QUALIFY NOT (count(*) OVER (PARTITION BY doc_id, line_no // 20) >= 3 AND ((row_number() OVER (PARTITION BY doc_id, line_no // 20 ORDER BY line_no) = 1 AND len < 20) OR (row_number() OVER (PARTITION BY doc_id, line_no // 20 ORDER BY line_no DESC) = 1 AND len < 10))))"
_CAT = "cat AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, page_id AS entry_no, regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) AS name FROM pages)"


def _refs(s, d):
    return notes(_lines(s, d))[0]


def _catalog(s, d):
    host, rest = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    return read_corpus(s, d, "pages").select(host.alias("archive"), F.col("page_id").alias("entry_no"), rest.alias("name"))


def _rels(s, d):
    kind = F.when(F.col("entry_no") % 2 == 0, "x/image").when(F.col("entry_no") % 3 == 0, "x/thumbnail").otherwise("x/style")
    return _catalog(s, d).select("archive", F.col("entry_no").alias("id"), kind.alias("type"), F.concat(F.lit("."), F.regexp_extract("name", "^/[^/?#]*", 0)).alias("target"))


REGISTERED = {
    "note_refs": (lambda s, d: note_refs(_links(s, d).unionByName(read_corpus(s, d, "pages").select("page_id", F.explode(F.array(F.lit(900), F.lit(901), F.lit(902))).alias("ord")).select("page_id", "ord", F.concat(F.lit("#n"), ((F.col("page_id") + F.col("ord")) % 2).cast("string")).alias("href"), F.concat(F.lit("["), (F.col("ord") - 899).cast("string"), F.lit("]")).alias("text")))), f"WITH {_LK}, a AS (SELECT page_id, ord, href, text FROM links UNION ALL SELECT page_id, o, '#n' || ((page_id + o) % 2), '[' || (o - 899) || ']' FROM pages, (VALUES (900), (901), (902)) v(o)) SELECT page_id, TRY_CAST(regexp_extract(text, '^\\s*\\[?\\s*(\\d+)\\s*\\]?\\s*$', 1) AS INTEGER) AS num, href FROM a WHERE TRY_CAST(regexp_extract(text, '^\\s*\\[?\\s*(\\d+)\\s*\\]?\\s*$', 1) AS INTEGER) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY ord) = 1"),
    "resolve_notes": (lambda s, d: resolve_notes(_refs(s, d), _lines(s, d)), f"{_L}, {_NOTE}, n AS (SELECT *, lead(target) OVER (PARTITION BY doc_id ORDER BY target) AS nxt FROM bodies), j AS (SELECT n.doc_id, num, target, l.line_no, l.line, min(CASE WHEN trim(l.line) = '' THEN l.line_no END) OVER (PARTITION BY n.doc_id, target) AS stop FROM n JOIN lines l ON l.doc_id = n.doc_id AND l.line_no >= target AND (nxt IS NULL OR l.line_no < nxt)), b AS (SELECT doc_id, num, string_agg(line, ' ' ORDER BY line_no) AS body FROM j WHERE stop IS NULL OR line_no < stop GROUP BY doc_id, num) SELECT doc_id, num, CASE WHEN length(body) > 250 THEN left(body, 250) || '...' ELSE body END AS body FROM b"),
    "allowed_notes": (lambda s, d: allowed_notes(_refs(s, d), notes(_lines(s, d))[1].where(F.length("line") > 20).select("doc_id", F.col("line_no").alias("target"))).select("doc_id", "num"), f"{_L}, {_NOTE} SELECT doc_id, num FROM bodies WHERE length(line) > 20"),
    "reflow_text": (lambda s, d: reflow_text(_lines(s, d), drop_running_heads(blocks_of(_lines(s, d)))), f"{_L}, {_KEPT}, t AS (SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, line_no, replace(replace(replace(translate(translate(line, chr(8216) || chr(8217) || chr(8220) || chr(8221), chr(39) || chr(39) || chr(34) || chr(34)), '{SPACES}', '{' ' * len(SPACES)}'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS p FROM kept JOIN lines USING (doc_id, line_no)) SELECT doc_id, page_no, string_agg('<p>' || p || '</p>', '' ORDER BY line_no) AS html FROM t WHERE trim(p) <> '' GROUP BY doc_id, page_no"),
    "size_ladder": (lambda s, d: size_ladder(read_corpus(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("size"), (F.col("p_partkey") % 5 == 0).alias("is_default"))), "WITH a AS (SELECT p_brand AS key, max(p_size) AS most, max(p_size) FILTER (WHERE p_partkey % 5 = 0) AS base FROM part GROUP BY p_brand) SELECT key, " + ", ".join(f"CASE WHEN most >= base THEN CAST(base + (most - base) // 6 * {6 - k} AS BIGINT) END AS h{k}" for k in range(1, 7)) + " FROM a"),
    "first_image_refs": (lambda s, d: first_refs(_links(s, d)), f"WITH {_LK}, o AS (SELECT page_id, href, min(ord) AS ord FROM links GROUP BY ALL) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS n, href FROM o"),
    "resolve_relations": (lambda s, d: resolve_relations(_rels(s, d), _catalog(s, d)), f"WITH {_CAT}, r AS (SELECT archive, entry_no AS id, regexp_extract(name, '^/([^/?#]*)', 1) AS target FROM cat WHERE entry_no % 2 = 0 OR entry_no % 3 = 0) SELECT id, arg_min(name, entry_no) AS name FROM r JOIN cat USING (archive) WHERE contains(name, target) GROUP BY id"),
    "extract_headings": (lambda s, d: extract_headings(read_corpus(s, d, "pages")), f"SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, CAST(a AS INTEGER) AS level, left({_PLAIN('b')}, 150) AS title FROM (SELECT page_id, {_ALL(HEADING)} FROM pages)"),
    "outline_parents": (lambda s, d: outline_parents(line_headings(_lines(s, d))), f"{_L}, {_H}, o AS (SELECT h.doc_id, h.ord, h.level, (SELECT max(p.ord) FROM heads p WHERE p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level) AS parent FROM heads h) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, parent ORDER BY ord) - 1 AS INTEGER) AS child_no FROM o"),
    "chapter_of": (lambda s, d: chapter_of(_positions(s, d), line_headings(_lines(s, d))), f"""{_L}, {_H}, positions AS (SELECT doc_id, CAST(unnest(list_append(range(0, length(text), 250), length(text) + 1)) AS BIGINT) AS pos FROM documents),
x AS (SELECT p.doc_id, p.pos, max(h.pos) FILTER (WHERE level = 1) AS p1, max(h.pos) FILTER (WHERE level = 2) AS p2, max(h.pos) FILTER (WHERE level = 3) AS p3,
  arg_max(title, h.pos) FILTER (WHERE level = 1) AS t1, arg_max(title, h.pos) FILTER (WHERE level = 2) AS t2, arg_max(title, h.pos) FILTER (WHERE level = 3) AS t3
  FROM positions p LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.pos <= p.pos GROUP BY p.doc_id, p.pos)
SELECT doc_id, pos, concat_ws(' / ', t1, CASE WHEN NOT coalesce(p1 > p2, false) THEN t2 END, CASE WHEN NOT (coalesce(p1 > p3, false) OR coalesce(p2 > p3, false)) THEN t3 END) AS chapter FROM x"""),
    "hit_chapters": (lambda s, d: hit_chapters(_hits(s, d), line_headings(_lines(s, d))), f"{_BASE}, {_HITS}, {_H}, {_HIT}"),
    "outline_tiered": (lambda s, d: outline_tiered(line_headings(_lines(s, d))), f"{_L}, {_H} SELECT doc_id, ord, level, title FROM heads QUALIFY level = min(level) OVER (PARTITION BY doc_id)"),
    "classify_links": (lambda s, d: classify_links(_links(s, d)), f"WITH {_LK} SELECT page_id, ord, href, CASE WHEN href[1] = '#' THEN 'internal' WHEN regexp_matches(href, '^https?:') THEN 'external' WHEN href[1] = '/' THEN 'site' ELSE 'unknown' END AS kind FROM links"),
    "resolve_links": (lambda s, d: resolve_links(_links(s, d), _anchors(s, d)), f"WITH {_LK}, {_AN} SELECT page_id, ord, href, target FROM links LEFT JOIN (SELECT path, min(page_id) AS target FROM anchors GROUP BY path) ON href = path"),
    "broken_links": (lambda s, d: broken_links(_links(s, d), _anchors(s, d)), f"WITH {_LK}, {_AN} SELECT * FROM links WHERE href[1] IN ('#', '/') AND href NOT IN (SELECT path FROM anchors)"),
    "link_graph": (lambda s, d: link_degrees(_links(s, d), _anchors(s, d)), f"WITH {_LK}, {_AN}, e AS (SELECT page_id, target FROM links JOIN (SELECT path, min(page_id) AS target FROM anchors GROUP BY path) ON href = path) SELECT page_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT page_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY page_id"),
    "drop_running_heads": (lambda s, d: drop_running_heads(blocks_of(_lines(s, d))), f"{_L}, b AS (SELECT doc_id, line_no // 20 AS page_no, line_no AS block_no, 1 AS n_lines, len AS n_chars FROM lines) SELECT * FROM b QUALIFY NOT (count(*) OVER (PARTITION BY doc_id, page_no) >= 3 AND ((row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no) = 1 AND n_chars < 20) OR (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no DESC) = 1 AND n_chars < 10)))"),
    "doc_stats": (lambda s, d: doc_stats(read_corpus(s, d, "documents")), "SELECT source, lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE trim(text) = '') AS empty FROM documents GROUP BY ROLLUP (source, lang)"),
}
