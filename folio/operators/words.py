"""Pages with their words, spans, lines or hits in arrays: what lies on a page is worked out where its row lies, for the pages of a few megabytes at once.

Lists that are parted into pages stay flat: `offsets` tell where each page's items begin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = ["doc_id", "page_no"]
#: Lines of a page; bytes of rows that are worked on at once, where a row isn't larger itself.
LINES, AT_ONCE = 20, 4 << 20
#: Gaps, in tenths of a point for each point of size, from which a space and from which a new span begins.
SPACE, SPLIT = 1.5, 8
#: The fields of a word.
WORD = {"line_no": T.IntegerType(), "idx": T.IntegerType(), "ch": T.StringType(), "pos": T.LongType(), "u0": T.LongType(), "u1": T.LongType(), "size": T.IntegerType(), "bold": T.BooleanType(), "top": T.DoubleType()}


def by_page(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """doc_id, page_no and an array of a page's rows, in the order of the fields."""
    return rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def in_batches(rows: DataFrame, made: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Rows of the fields, whose columns `made` gives for a batch of rows."""
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = max(1, batch.num_rows * AT_ONCE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, n):
                yield pa.RecordBatch.from_arrays(made(batch.slice(at, n)), schema.names)

    return rows.mapInArrow(run, schema)


def _items(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where each row's items of an array of structs begin, and the fields of all items."""
    lists = batch.column(name)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.concatenate([[0], np.cumsum(counts)]), dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))


def _np(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _structs(arrays: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(arrays.values()), list(arrays))


def _joined(begin: np.ndarray, parts: pa.Array, sep: str) -> pa.Array:
    """The parts of each island, joined; null ones are left out."""
    ends = np.append(begin, len(parts))
    if parts.null_count:
        there = _np(parts.is_valid())
        ends, parts = np.concatenate([[0], np.cumsum(there)])[ends], parts.drop_null()
    return pc.binary_join(_lists(ends, parts), sep)


def _firsts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether an item is the first of its page."""
    out = np.zeros(n + 1, bool)
    out[offsets[:-1]] = True
    return out[:-1]


def _before(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:1], a[:-1]])


def page_words(pages: DataFrame, *fields: str) -> DataFrame:
    """Pages with `words` in place of `lines`, an array of (line_no, line, start, len): the word boxes of the page, with those fields of WORD or all. A page without words has no row.

    A page's first line is large, short ones are middling; every fifth word stands a little, every eleventh far apart."""
    fields = fields or tuple(WORD)
    keep = [f for f in pages.schema if f.name != "lines"]
    tops = np.array([round(i / LINES, 6) for i in range(LINES)])

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        offsets, held = _items(batch, "lines")
        texts = held["line"].fill_null("") if held["line"].null_count else held["line"]
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        gap = data == 32
        edge = np.zeros(len(data) + 1, bool)  # where a line begins or ends
        edge[off] = True
        begin = np.flatnonzero(~gap & (edge[:-1] | _before(gap)))
        end = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True))) + 1
        gaps, later = np.flatnonzero(gap), np.flatnonzero((data & 0xC0) == 0x80)
        chars = lambda at: at - np.searchsorted(later, at)  # noqa: E731  # code points before a byte
        of = np.searchsorted(off, begin, "right") - 1
        at = chars(off)
        k = np.searchsorted(gaps, begin) - np.searchsorted(gaps, off[:-1])[of]
        first = chars(begin)
        n, first = chars(end) - first, first - at[:-1][of]
        on_page = _np(held["line_no"]) % LINES
        size = np.where(on_page == 0, 24, np.where(_np(held["len"]) < 40, 14, 10)).astype(np.int32)[of]
        upto = np.searchsorted(of, offsets)  # words before each page
        u0 = size * (6 * first + k // 5 + 12 * (k // 11))
        values = {
            "line_no": lambda: held["line_no"].take(pa.array(of)),
            "idx": lambda: pa.array((np.arange(len(of)) - np.repeat(upto[:-1], np.diff(upto))).astype(np.int32)),
            "ch": lambda: pa.Array.from_buffers(pa.string(), len(of), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.py_buffer(data[~gap])]),
            "pos": lambda: pa.array(_np(held["start"])[of] + first),
            "u0": lambda: pa.array(u0),
            "u1": lambda: pa.array(u0 + 6 * size * n),
            "size": lambda: pa.array(size),
            "bold": lambda: pa.array((on_page == 0)[of]),
            "top": lambda: pa.array(tops[on_page][of]),
            "n": lambda: pa.array(n.astype(np.int32)),
        }
        some = np.diff(upto) > 0
        batch = batch.filter(pa.array(some))
        words = _lists(np.append(upto[:-1][some], upto[-1]), _structs({f: values[f]() for f in fields}))
        return [*(batch.column(f.name) for f in keep), words]

    word = T.StructType([T.StructField(f, (WORD | {"n": T.IntegerType()})[f]) for f in fields])
    return in_batches(pages, made, [*keep, T.StructField("words", T.ArrayType(word))])


def page_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, spans of pages with `words`: a new span where the size or the baseline changes or the gap is SPLIT or more; a space where it is SPACE or more."""
    word = pages.schema["words"].dataType.elementType
    kinds = {"span_no": T.IntegerType(), "text": T.StringType()} | {c: word[c].dataType for c in ("u0", "u1", "size", "bold", "top", "line_no")}

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        offsets, w = _items(batch, "words")
        u0, u1, size, top = (_np(w[c]) for c in ("u0", "u1", "size", "top"))
        gap = np.abs(u0 - _before(u1))
        # what is null is not a number here, and equals nothing
        new = _firsts(offsets, len(u0)) | (size != _before(size)) | (top != _before(top)) | ~(gap < SPLIT * size)
        begin = np.flatnonzero(new)
        parts = pc.if_else(pa.array((gap >= SPACE * size) & ~new), pc.binary_join_element_wise(" ", w["ch"], ""), w["ch"])
        upto, at = np.searchsorted(begin, offsets), pa.array(begin)
        spans = {"span_no": pa.array((np.arange(len(begin)) - np.repeat(upto[:-1], np.diff(upto))).astype(np.int32)), "text": _joined(begin, parts, "")}
        for c, ends, pick in (("u0", u0, np.minimum), ("u1", u1, np.maximum)):
            spans[c] = pa.array(pick.reduceat(ends, begin) if len(begin) else ends, from_pandas=True).cast(w[c].type)
        return [*(batch.column(c) for c in PAGE), _lists(upto, _structs(spans | {c: w[c].take(at) for c in ("size", "bold", "top", "line_no")}))]

    span = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    return in_batches(pages, made, [*(pages.schema[c] for c in PAGE), T.StructField("spans", T.ArrayType(span))])


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, lines of pages with `spans`: a new line where the baseline moves by more than 0.9 of the size, and with it a new block where it moves by more than 1.5 or back by more than half of it."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        offsets, s = _items(batch, "spans")
        top, size = _np(s["top"]), _np(s["size"])
        away, first = (top - _before(top)) * 480, _firsts(offsets, len(top)) | np.isnan(_before(top))
        line = np.abs(away) > 0.9 * size
        block = first | (line & ((away > 1.5 * size) | (away < -0.5 * size)))
        begin = np.flatnonzero(first | line)
        upto, blocks = np.searchsorted(begin, offsets), np.cumsum(block[begin])
        page = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
        lines = {
            "block": pa.array((blocks - blocks[upto[:-1][page]]).astype(np.int32)),
            "line": pa.array((np.arange(len(begin)) - upto[:-1][page]).astype(np.int32)),
            "spans": pa.array(np.diff(np.append(begin, len(top)))),
            "text": _joined(begin, s["text"], " "),
        }
        return [*(batch.column(c) for c in PAGE), _lists(upto, _structs(lines))]

    line = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("spans", T.LongType()), T.StructField("text", T.StringType())])
    return in_batches(pages, made, [*(pages.schema[c] for c in PAGE), T.StructField("lines", T.ArrayType(line))])


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, blocks of pages with `lines` in their order: an array of blocks, each an array of its lines' texts."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        offsets, lines = _items(batch, "lines")
        block = _np(lines["block"])
        begin = np.flatnonzero(_firsts(offsets, len(block)) | (block != _before(block)))
        blocks = _lists(np.append(begin, len(block)), lines["text"])
        return [*(batch.column(c) for c in PAGE), _lists(np.searchsorted(begin, offsets), blocks)]

    return in_batches(pages, made, [*(pages.schema[c] for c in PAGE), T.StructField("blocks", T.ArrayType(T.ArrayType(T.StringType())))])


def _meeting(hits: tuple[np.ndarray, ...], words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of hits and words of a page whose intervals [lo, hi) meet, by hit, then by word; a page's words come in the order of lo. Each of the two: offsets, lo, hi."""
    (ho, lo, hi), (wo, at, upto) = hits, words
    if not len(lo) or not len(at):
        return np.zeros(0, int), np.zeros(0, int)
    # each page has its own stretch of numbers, so that all are looked up at once
    least = min(lo.min(), at.min())
    width = max(hi.max(), upto.max()) - least + 2
    own_h, own_w = (np.repeat(np.arange(len(o) - 1), np.diff(o)) * width - least for o in (ho, wo))
    # no word before the first that ends behind the hit's start can meet it, nor one from the hit's end on
    first = np.searchsorted(np.maximum.accumulate(upto + own_w), lo + own_h, "right")
    n = np.maximum(np.searchsorted(at + own_w, hi + own_h, "left") - first, 0)
    h = np.repeat(np.arange(len(n)), n)
    w = np.arange(len(h)) + np.repeat(first - np.cumsum(n) + n, n)
    met = (upto[w] > lo[h]) & (upto[w] > at[w]) & (hi[h] > lo[h])
    return h[met], w[met]


def _of_hits(batch: pa.RecordBatch, offsets: np.ndarray, hits: dict[str, pa.Array], h: np.ndarray) -> list[pa.Array]:
    """Keys of the page and of the hit for the hits at h."""
    row = pa.array(np.searchsorted(offsets, h, "right") - 1)
    return [*(batch.column(c).take(row) for c in PAGE), *(hits[c].take(pa.array(h)) for c in ("query_id", "hit_no"))]


def _hit_fields(pages: DataFrame, word: list[T.StructField]) -> list[T.StructField]:
    hit = pages.schema["hits"].dataType.elementType
    return [*(pages.schema[c] for c in PAGE), *(T.StructField(c, hit[c].dataType) for c in ("query_id", "hit_no")), *word]


def page_hit_boxes(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, query_id, hit_no, top, u0, u1 of pages with `hits` (query_id, hit_no, pos0, end0) and `words` (pos, n, u0, u1, top) in the order of pos: what a hit covers, one box for each line."""
    word = pages.schema["words"].dataType.elementType

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        (ho, hits), (wo, words) = _items(batch, "hits"), _items(batch, "words")
        pos = _np(words["pos"])
        h, w = _meeting((ho, _np(hits["pos0"]), _np(hits["end0"])), (wo, pos, pos + _np(words["n"])))
        top = _np(pc.dictionary_encode(words["top"], null_encoding="encode").indices)[w]
        order = np.lexsort((top, h))
        h, w, top = h[order], w[order], top[order]
        begin = np.flatnonzero((h != _before(h)) | (top != _before(top)) | (np.arange(len(h)) == 0))
        edge = lambda c, pick: pa.array(pick.reduceat(_np(words[c])[w], begin) if len(begin) else [], from_pandas=True).cast(words[c].type)
        return [*_of_hits(batch, ho, hits, h[begin]), words["top"].take(pa.array(w[begin])), edge("u0", np.minimum), edge("u1", np.maximum)]

    return in_batches(pages, made, _hit_fields(pages, [T.StructField(c, word[c].dataType) for c in ("top", "u0", "u1")]))


def page_hit_edges(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, query_id, hit_no, a, b of pages with `hits` and `words` (pos, n, u0) in the order of pos: left edges of the last words that hold the hit's start and end, their own ends included; hits without one of the two have no row."""
    edge = pages.schema["words"].dataType.elementType["u0"].dataType

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        (ho, hits), (wo, words) = _items(batch, "hits"), _items(batch, "words")
        pos, held = _np(words["pos"]), []
        for c in ("pos0", "end0"):
            at = _np(hits[c])
            h, w = _meeting((ho, at, at + 1), (wo, pos, pos + _np(words["n"]) + 1))
            last = np.full(len(at), -1)
            last[h] = w  # the last of a hit's words stays
            held.append(last)
        h = np.flatnonzero((held[0] >= 0) & (held[1] >= 0))
        return [*_of_hits(batch, ho, hits, h), *(words["u0"].take(pa.array(last[h])) for last in held)]

    return in_batches(pages, made, _hit_fields(pages, [T.StructField(c, edge) for c in "ab"]))
