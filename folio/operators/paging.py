"""Pages, positions and ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.intervals import meeting
from folio.sources.tables import doc_pages, lines, read_corpus, with_


def paginate(rows: DataFrame, height: int = 20) -> DataFrame:
    """doc_id, page_no, first_line, n_lines: pages of `height` equal lines over rows(doc_id, line_no, force).

    A forced line begins a page; so does each height-th line after one."""
    seg = F.sum(F.col("force").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("seg", seg)
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("doc_id", "seg").orderBy("line_no")) - 1) / height))
    pages = rows.groupBy("doc_id", "seg", "part").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1
    return pages.select("doc_id", no.alias("page_no"), "first_line", "n_lines")


def positions(docs: DataFrame, every: int = 250) -> DataFrame:
    """doc_id, pos: every so many offsets of a text, and one past its end."""
    n = F.length("text")
    return docs.select("doc_id", F.explode(F.array_append(F.filter(F.sequence(F.lit(0), n, F.lit(every)), lambda i: i < n), n + 1).cast("array<long>")).alias("pos"))


def page_of(pos: DataFrame, ranges: DataFrame, width: int = 1024) -> DataFrame:
    """doc_id, pos, page_no: the page with start <= pos < end, -1 if there is none. A position meets the pages of its stretch of the document alone."""
    own, pages = pos.select("doc_id", "pos", (F.col("pos") + 1).alias("_next")), ranges.select("doc_id", "page_no", "start", "end")
    hit = meeting(own, pages, ["doc_id"], ("pos", "_next"), ("start", "end"), width)
    return pos.join(hit.select("doc_id", "pos", "page_no"), ["doc_id", "pos"], "left").withColumn("page_no", F.coalesce("page_no", F.lit(-1)))


def spread_no(pages: DataFrame, columns: int = 2) -> DataFrame:
    """pages(..., page_no) with `spread`: the number of the screen that shows a page beside others, from 0; -1 for a page that isn't known."""
    return pages.withColumn("spread", F.when(F.col("page_no") < 0, -1).otherwise(F.floor(F.col("page_no") / columns)).cast("int"))


def nearest_page(pos: DataFrame, ranges: DataFrame, direction: int = 0) -> DataFrame:
    """doc_id, pos, page_no: the page that holds a position; with direction 1 the next one, with -1 the one before, as far as there are any.

    A position between two pages belongs to the later one, or with -1 to the earlier; one behind the last page to the last.
    As-of by one sort for each document; ranges(doc_id, page_no, start, end), end exclusive, pages from 0."""
    both = pos.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("long").alias("end"))
    both = both.unionByName(ranges.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), "page_no", F.col("end").cast("long").alias("end")))
    w = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("page_no", "end")), ignorenulls=True).over(w)
    most = F.max("page_no").over(Window.partitionBy("doc_id"))
    rows = both.withColumns({"p": last, "most": most}).where("kind = 1 AND most IS NOT NULL")
    held = F.col("pos") < F.col("p.end")
    here = F.coalesce(F.col("p.page_no"), F.lit(-1))
    at = F.when(held, here + direction).otherwise(here if direction < 0 else here + 1)
    return rows.select("doc_id", "pos", F.when(~held & (here == F.col("most")), here).otherwise(F.greatest(F.lit(0), F.least(at, "most"))).alias("page_no"))


def paginate_heights(rows: DataFrame, page_height: int) -> DataFrame:
    """doc_id, page_no, start, end of rows(doc_id, line_no, start, end, before, after): heights may differ.

    Lines fill a page up to page_height from its first line's start. A page is forced before a line marked always (2) before, or
    behind one marked always after unless either says avoid (1). A line that begins above the end of the last one, a table cell, is skipped.
    One fold over the lines of a document."""
    kind = "struct<first:bigint,last:bigint,after:int,pages:array<struct<start:bigint,end:bigint>>>"
    line = F.array_sort(F.collect_list(F.struct("line_no", "start", "end", "before", "after")))
    empty = F.lit(None).cast(kind)

    def step(acc, x):
        begin = F.struct(x["start"].alias("first"), x["end"].alias("last"), x["after"].alias("after"), F.coalesce(acc["pages"], F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("pages"))
        done = F.array_append(acc["pages"], F.struct(acc["first"].alias("start"), acc["last"].alias("end")))
        forced = (x["before"] == 2) | ((acc["after"] == 2) & (x["before"] != 1))
        split = F.struct(x["start"].alias("first"), x["end"].alias("last"), x["after"].alias("after"), done.alias("pages"))
        longer = F.struct(acc["first"].alias("first"), x["end"].alias("last"), x["after"].alias("after"), acc["pages"].alias("pages"))
        skip = x["start"] < acc["last"]
        return F.when(acc.isNull(), begin).when(skip, acc).when((x["end"] - acc["first"] > page_height) | forced, split).otherwise(longer).cast(kind)

    held = rows.groupBy("doc_id").agg(line.alias("h")).select("doc_id", F.aggregate("h", empty, step).alias("a"))
    pages = F.array_append(F.col("a.pages"), F.struct(F.col("a.first").alias("start"), F.col("a.last").alias("end")))
    return held.select("doc_id", F.posexplode(pages).alias("page_no", "p")).select("doc_id", "page_no", "p.start", "p.end")


#: Kinds of events of a document's fold.
LINE, NOTE, NOTE_END = 0, 1, 2
#: Fixed value: what separates the notes of a page from its lines.
MARGIN = 12
WITH_NOTES = "doc_id long, page_no int, start long, height long, frag_no int, note_id long, note_start long, note_height long"


def fold_with_notes(events: Iterable[tuple], page_height: int, margin: int = MARGIN) -> Iterator[tuple]:
    """(page_no, start, height, fragments) of a document's events (kind, note_id, start, end, before, after) in order: see `paginate_with_notes`."""
    page, first, begun, last, before_last, after = 0, None, None, None, None, 0  # of the open page: first line's start; last line's start and end; the end before it
    foot, behind, held, top, bottom = 0, 0, [], None, None  # height of its notes, end of the page before, its fragments; the open fragment

    def closed(end: int | None) -> tuple:
        nonlocal page, foot, behind, held
        out = (page, behind if first is None else first, 0 if first is None else end - first, held)
        page, foot, behind, held = page + 1, 0, out[1] + out[2], []
        return out

    def flush(note: int) -> None:
        nonlocal foot, top, bottom
        if top is not None and 0 < bottom - top < page_height:
            held.append((note, top, bottom - top))
            foot += bottom - top
        top = bottom = None

    for kind, note, start, end, split_before, split_after in events:
        notes = margin + foot if foot else 0
        if kind == LINE:
            if first is not None and start < last:
                continue
            forced = split_before == 2 or after == 2 and split_before != 1
            if first is not None and (forced or end - first + notes > page_height):
                yield closed(last)
                first = None
            before_last = None if first is None else last
            first, begun, last, after = start if first is None else first, start, end, split_after
        elif kind == NOTE:
            more = end - (start if top is None else top) + (0 if foot else margin)
            if (0 if first is None else last - first) + notes + more > page_height:
                if top is not None:
                    flush(note)
                    if first is not None or held:
                        yield closed(last)
                    first = last = before_last = None
                elif before_last is not None:
                    yield closed(before_last)
                    first, before_last = begun, None
                elif held:
                    yield closed(last)
                    first = last = None
                top = start
            top, bottom = start if top is None else top, end
        else:
            flush(note)
    if first is not None or held:
        yield closed(last)


def paginate_with_notes(rows: DataFrame, refs: DataFrame, notes: DataFrame, page_height: int, margin: int = MARGIN) -> DataFrame:
    """WITH_NOTES: pages of rows(doc_id, line_no, start, end, before, after) that hold the notes of their lines too.

    refs(doc_id, line_no, ord, note_id) are the references of lines, notes(doc_id, note_id, k, start, end) the
    lines of notes. Only a note's first reference in a document takes space. Lines fill a page as
    `paginate_heights` has it; a page's notes stand below a margin. A note whose first line has no room takes
    its line along to the next page, unless that is the page's first; one that has begun goes on, as
    another fragment, on a next page. Each page is a row for each of its fragments, or one with nulls. A
    fragment as high as a page isn't shown. What is left behind the last line gets a page of its own.

    One fold over the lines and notes of a document, in linear time and with the state of one page."""
    once = refs.groupBy("doc_id", "note_id").agg(F.min(F.struct("line_no", "ord")).alias("x")).select("doc_id", "note_id", "x.*")
    held = once.join(notes, ["doc_id", "note_id"]).select("doc_id", "line_no", "ord", F.lit(NOTE).alias("kind"), "k", "note_id", "start", "end")
    ends = held.groupBy("doc_id", "line_no", "ord", "note_id").agg(F.max("k").alias("k")).withColumns({"kind": F.lit(NOTE_END), "start": F.lit(None).cast("long"), "end": F.lit(None).cast("long")})
    own = rows.select("doc_id", "line_no", F.lit(-1).alias("ord"), F.lit(LINE).alias("kind"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("note_id"), "start", "end", "before", "after")
    events = own.unionByName(held.unionByName(ends), allowMissingColumns=True)

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("line_no", "ord", "kind", "k")])
        found = fold_with_notes(zip(*(t.column(c).to_pylist() for c in ("kind", "note_id", "start", "end", "before", "after")), strict=True), page_height, margin)
        flat = [(doc, no, start, height, i if fragments else None, *f) for doc in (t.column("doc_id")[0].as_py(),) for no, start, height, fragments in found for i, f in enumerate(fragments or [(None, None, None)])]
        kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in WITH_NOTES.split(", ")]
        columns = zip(*flat, strict=True) if flat else [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in WITH_NOTES.split(", ")])

    return events.groupBy("doc_id").applyInArrow(fold, WITH_NOTES)


def page_start(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id", "page_no").agg(F.min("start").alias("start"))


def reading_ratio(pos: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.select("doc_id", F.length("text").alias("n"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pos") / F.greatest(F.col("n"), F.lit(1))))
    return pos.join(n, "doc_id").select("doc_id", "pos", F.round(ratio, 6).alias("ratio"))


def segment_text(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_no, sentence: pieces that end at a full stop, question or exclamation mark, or newline."""
    pieces = F.filter(F.transform(F.split("text", r"[.!?\n]+", -1), lambda x: F.trim(x)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("sentence_no", "sentence"))


def middle_unit(units: DataFrame) -> DataFrame:
    """The middle sentence of each document: number ceil(count / 2) - 1."""
    n = units.groupBy("doc_id").agg(F.count("*").alias("n"))
    return units.join(n, "doc_id").where(F.col("sentence_no") == F.ceil(F.col("n") / 2) - 1).select("doc_id", "sentence_no", "sentence")


def text_between(docs: DataFrame, ranges: DataFrame, pages: DataFrame, width: int = 4096) -> DataFrame:
    """doc_id, page_no, part: what ranges(doc_id, a, b) cover of each page, clipped to it. A page meets the ranges of its stretch of the document alone."""
    j = meeting(pages, ranges.select("doc_id", "a", "b"), ["doc_id"], ("start", "end"), ("a", "b"), width)
    lo, hi = F.greatest("a", "start"), F.least("b", "end")
    return j.select("doc_id", "page_no", F.substr("text", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))


def _noted(s, d):
    """Lines of height 10; every seventh refers to the note of its length's rest by eleven, the longer ones to a second; a note has up to 31 lines of height 8."""
    rows = lines(_docs(s, d))
    ours = rows.select("doc_id", "line_no", (F.col("line_no") * 10).cast("long").alias("start"), (F.col("line_no") * 10 + 10).cast("long").alias("end"), F.when(F.col("line_no") % 37 == 0, 2).otherwise(0).alias("before"), F.lit(0).alias("after"))
    refs = rows.where("line_no % 7 = 3").select("doc_id", "line_no", F.posexplode(F.when(F.col("len") > 60, F.array(F.col("len") % 11, F.col("len") % 5)).otherwise(F.array(F.col("len") % 11))).alias("ord", "note_id")).withColumn("note_id", F.col("note_id").cast("long"))
    notes = refs.select("doc_id", "note_id").distinct().select("doc_id", "note_id", F.explode(F.sequence(F.lit(0), (F.col("note_id") * 3).cast("int"))).alias("k"))
    notes = notes.select("doc_id", "note_id", "k", *[(F.col("note_id") * 1000 + (F.col("k") + i) * 8).alias(c) for i, c in enumerate(("start", "end"))])
    return ours, refs, notes


def _docs(s, d):
    return read_corpus(s, d, "documents").select("doc_id", "text")


_L, _P = with_("lines").rstrip(), with_("lines", "pages").rstrip()
_POS = "positions AS (SELECT doc_id, CAST(unnest(list_append(range(0, length(text), 250), length(text) + 1)) AS BIGINT) AS pos FROM documents)"
_SEN = r"sen AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda y: trim(y, ' ')), lambda y: y <> '') AS x FROM documents)))"
_SEN = _SEN.replace(r"\n", "' || chr(10) || '")

#: The fold as a recursion over a document's events: fs, fe are the open fragment, pe is the end before the last line; op, oh a page that closes, fp, fn, fa, fh a fragment that does.
_WITH_NOTES = f"""{_L.replace("WITH ", "WITH RECURSIVE ", 1)}, refs AS (SELECT doc_id, line_no, CAST(0 AS INTEGER) AS ord, len % 11 AS note_id FROM lines WHERE line_no % 7 = 3 UNION ALL SELECT doc_id, line_no, 1, len % 5 FROM lines WHERE line_no % 7 = 3 AND len > 60),
once AS (SELECT doc_id, note_id, min((line_no, ord)) AS x FROM refs GROUP BY ALL), n AS (SELECT doc_id, note_id, x[1] AS line_no, x[2] AS ord, unnest(range(note_id * 3 + 1)) AS k FROM once),
ev AS (SELECT doc_id, line_no, -1 AS ord, 0 AS kind, 0 AS k, NULL AS note_id, line_no * 10 AS s, line_no * 10 + 10 AS e, line_no % 37 = 0 AS forced FROM lines UNION ALL SELECT doc_id, line_no, ord, 1, k, note_id, note_id * 1000 + k * 8, note_id * 1000 + k * 8 + 8, false FROM n
  UNION ALL SELECT doc_id, x[1], x[2], 2, 0, note_id, NULL, NULL, false FROM once UNION ALL SELECT DISTINCT doc_id, 1000000000, 0, 3, 0, NULL, NULL, NULL, false FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, ord, kind, k) AS i FROM ev),
st AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS page, NULL::BIGINT AS ps, NULL::BIGINT AS ls, NULL::BIGINT AS le, NULL::BIGINT AS pe, 0::BIGINT AS foot, 0::BIGINT AS beh, NULL::BIGINT AS fs, NULL::BIGINT AS fe, NULL::BIGINT AS op, NULL::BIGINT AS oh, NULL::BIGINT AS pno, NULL::BIGINT AS fn, NULL::BIGINT AS fa, NULL::BIGINT AS fh, NULL::BIGINT AS fp FROM lines
UNION ALL SELECT doc_id, i, page + shut::INT,
  CASE WHEN act IN ('start', 'new') THEN s WHEN act = 'take' THEN ls WHEN act IN ('spill', 'leave') THEN NULL ELSE ps END, CASE WHEN kind = 0 AND act <> 'skip' THEN s ELSE ls END, CASE WHEN kind = 0 AND act <> 'skip' THEN e WHEN act IN ('spill', 'leave') THEN NULL ELSE le END,
  CASE WHEN act = 'add' THEN le WHEN act IN ('skip', 'on', 'alone', 'end') THEN pe END, CASE WHEN shut THEN 0 ELSE foot END + CASE WHEN act = 'end' AND fs IS NOT NULL AND fe - fs < 200 THEN fe - fs ELSE 0 END, CASE WHEN shut THEN p0 + ph ELSE beh END,
  CASE WHEN act IN ('take', 'spill', 'leave', 'alone') THEN s WHEN act = 'on' THEN coalesce(fs, s) WHEN kind < 1 THEN fs END, CASE WHEN kind = 1 THEN e WHEN kind < 1 THEN fe END,
  CASE WHEN shut THEN p0 END, CASE WHEN shut THEN ph END, CASE WHEN shut THEN page END, CASE WHEN frag THEN note_id END, CASE WHEN frag THEN fs END, CASE WHEN frag THEN fe - fs END, CASE WHEN frag THEN page END
  FROM (SELECT *, CASE WHEN ps IS NULL THEN beh ELSE ps END AS p0, CASE WHEN ps IS NULL THEN 0 WHEN act = 'take' THEN pe - ps ELSE le - ps END AS ph, act IN ('new', 'take') OR (act IN ('spill', 'leave', 'last') AND (ps IS NOT NULL OR foot > 0 OR (act = 'spill' AND fe - fs < 200))) AS shut, act IN ('spill', 'end') AND fs IS NOT NULL AND fe - fs < 200 AS frag FROM (
    SELECT st.*, o.i AS i2, kind, note_id, s, e, CASE WHEN kind = 3 THEN 'last' WHEN kind = 2 THEN 'end'
      WHEN kind = 0 THEN CASE WHEN ps IS NULL THEN 'start' WHEN s < le THEN 'skip' WHEN forced OR e - ps + CASE WHEN foot > 0 THEN 12 + foot ELSE 0 END > 200 THEN 'new' ELSE 'add' END
      WHEN coalesce(le - ps, 0) + CASE WHEN foot > 0 THEN 12 + foot ELSE 12 END + e - coalesce(fs, s) <= 200 THEN 'on' WHEN fs IS NOT NULL THEN 'spill' WHEN ps IS NOT NULL AND pe IS NOT NULL THEN 'take' WHEN foot > 0 THEN 'leave' ELSE 'alone' END AS act
    FROM (SELECT * EXCLUDE (op, oh, pno, fn, fa, fh, fp) FROM st) st JOIN o ON o.doc_id = st.doc_id AND o.i = st.i + 1) q) t(doc_id, i0, page, ps, ls, le, pe, foot, beh, fs, fe, i, kind, note_id, s, e, act, p0, ph, shut, frag))
SELECT a.doc_id, CAST(pno AS INTEGER) AS page_no, op AS start, oh AS height, CAST(CASE WHEN b.fp IS NOT NULL THEN row_number() OVER (PARTITION BY a.doc_id, pno ORDER BY b.i) - 1 END AS INTEGER) AS frag_no, b.fn AS note_id, b.fa AS note_start, b.fh AS note_height
FROM st a LEFT JOIN (SELECT doc_id, i, fp, fn, fa, fh FROM st WHERE fp IS NOT NULL) b ON b.doc_id = a.doc_id AND b.fp = a.pno WHERE pno IS NOT NULL"""

REGISTERED = {
    "paginate_with_notes": (lambda s, d: paginate_with_notes(*_noted(s, d), 200), _WITH_NOTES),
    "paginate": (lambda s, d: paginate(lines(_docs(s, d)).withColumn("force", F.col("line_no") % 37 == 0)), f"""{_L}, a AS (SELECT *, sum(CASE WHEN line_no % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM lines),
b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg ORDER BY line_no) - 1) // 20 AS part FROM a), c AS (SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines FROM b GROUP BY doc_id, seg, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS INTEGER) AS page_no, first_line, n_lines FROM c"""),
    "page_text": (lambda s, d: doc_pages(_docs(s, d)), f"{_P} SELECT * FROM doc_pages"),
    "page_of": (lambda s, d: page_of(positions(_docs(s, d)), doc_pages(_docs(s, d))), f'{_P}, {_POS} SELECT p.doc_id, pos, coalesce(page_no, -1) AS page_no FROM positions p LEFT JOIN doc_pages g ON g.doc_id = p.doc_id AND start <= pos AND pos < "end"'),
    "spread_of": (lambda s, d: spread_no(page_of(positions(_docs(s, d)), doc_pages(_docs(s, d)))), f'{_P}, {_POS} SELECT p.doc_id, pos, coalesce(page_no, -1) AS page_no, CAST(CASE WHEN page_no IS NULL THEN -1 ELSE page_no // 2 END AS INTEGER) AS spread FROM positions p LEFT JOIN doc_pages g ON g.doc_id = p.doc_id AND start <= pos AND pos < "end"'),
    "nearest_page": (lambda s, d: nearest_page(positions(_docs(s, d)), doc_pages(_docs(s, d))), f"{_P}, {_POS} SELECT p.doc_id, pos, CAST(least(max(page_no) FILTER (WHERE start <= pos) + CASE WHEN pos < max(\"end\") FILTER (WHERE start <= pos) THEN 0 ELSE 1 END, max(page_no)) AS INTEGER) AS page_no FROM positions p JOIN doc_pages g ON g.doc_id = p.doc_id GROUP BY p.doc_id, pos"),
    "paginate_heights": (lambda s, d: paginate_heights(lines(_docs(s, d)).select("doc_id", "line_no", (F.col("line_no") * 10).cast("long").alias("start"), (F.col("line_no") * 10 + 10).cast("long").alias("end"), F.when(F.col("line_no") % 37 == 0, 2).otherwise(0).alias("before"), F.lit(0).alias("after")), 200), f"""{_L}, a AS (SELECT *, sum(CASE WHEN line_no % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM lines),
b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg ORDER BY line_no) - 1) // 20 AS part FROM a), c AS (SELECT doc_id, min(line_no) * 10 AS start, max(line_no) * 10 + 10 AS "end" FROM b GROUP BY doc_id, seg, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS page_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM c"""),
    "page_start": (lambda s, d: page_start(doc_pages(_docs(s, d))), f"{_P} SELECT doc_id, page_no, start FROM doc_pages"),
    "reading_ratio": (lambda s, d: reading_ratio(positions(_docs(s, d)), _docs(s, d)), f"WITH {_POS} SELECT doc_id, pos, round(least(1.0, pos / CAST(greatest(length(text), 1) AS DOUBLE)), 6) AS ratio FROM positions JOIN documents USING (doc_id)"),
    "segment_text": (lambda s, d: segment_text(_docs(s, d)), f"WITH {_SEN} SELECT * FROM sen"),
    "middle_unit": (lambda s, d: middle_unit(segment_text(_docs(s, d))), f"WITH {_SEN} SELECT doc_id, sentence_no, sentence FROM sen QUALIFY sentence_no = ceil(count(*) OVER (PARTITION BY doc_id) / 2) - 1"),
    "text_between": (lambda s, d: text_between(_docs(s, d), _docs(s, d).select("doc_id", F.lit(700).alias("a"), F.lit(9_000).alias("b")), doc_pages(_docs(s, d))), f"""{_P} SELECT doc_id, page_no, substring(text, CAST(greatest(700, start) - start + 1 AS BIGINT), CAST(least(9000, "end") - greatest(700, start) AS BIGINT)) AS part FROM doc_pages WHERE start < 9000 AND 700 < "end" """),
}
