"""Metadata records, property sets, catalogs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import natural_key
from folio.sources.manifest import verified, write_manifest
from folio.sources.shared import new_path
from folio.sources.tables import read_corpus


def meta_wide(meta: DataFrame, tags: list[str], sep: str = "; ") -> DataFrame:
    """One row for each doc_id and a column for each tag: its values in order, joined by sep."""
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), sep)
    return meta.groupBy("doc_id").pivot("tag", tags).agg(held)


def title_fallback(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with `title`: the first of the named columns that is neither null nor empty."""
    return rows.withColumn("title", F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names]))


def apply_edits(meta: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, tag, value) after edits(doc_id, seq, op, tag, value): the last set or delete of a key counts; each add behind it adds a value."""
    key = ["doc_id", "tag"]
    reset = F.max(F.when(F.col("op") != "add", F.col("seq"))).over(Window.partitionBy(*key))
    live = edits.withColumn("reset", reset).where("reset IS NULL OR seq >= reset")
    kept = meta.select(*key, "value").join(live.where("reset IS NOT NULL"), key, "left_anti")
    return kept.unionByName(live.where("op <> 'delete'").select(*key, "value"))


#: The words for true and for false.
YES, NO = ("true", "TRUE", "yes", "YES", "1"), ("false", "FALSE", "no", "NO", "0")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["key", "name"], "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["key", "name"], "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All names; the left value wins, a null one too."""
    j = a.withColumn("_left", F.lit(True)).join(b.withColumnRenamed("value", "other"), ["key", "name"], "full")
    return j.select("key", "name", F.when(F.col("_left"), F.col("value")).otherwise(F.col("other")).alias("value"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is new in b or has another value there."""
    j = b.join(a.withColumnRenamed("value", "was"), ["key", "name"], "left")
    return j.where(~F.col("value").eqNullSafe(F.col("was"))).select("key", "name", "value")


def set_defaults(a: DataFrame, defaults: DataFrame) -> DataFrame:
    """a, and the defaults whose name is missing for a key."""
    every = a.select("key").distinct().crossJoin(defaults)
    return a.unionByName(every.join(a, ["key", "name"], "left_anti").select("key", "name", "value"))


def typed(props: DataFrame) -> DataFrame:
    """key, name, number, color, flag: values read as a whole number, as #hex or 0xhex, and as a truth value; null where they are none."""
    value = F.col("value")
    digits = F.regexp_extract("value", "^(?:#|0x)([0-9a-fA-F]{1,8})$", 1)
    flag = F.when(value.isin(*YES), True).when(value.isin(*NO), False)
    return props.select("key", "name", value.try_cast("int").alias("number"), F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long").alias("color"), flag.alias("flag"))


def with_defaults(props: DataFrame, number: int, color: int, flag: bool) -> DataFrame:
    """typed(props), with what can't be read replaced by the defaults."""
    return typed(props).fillna({"number": number, "color": color, "flag": flag})


def catalog_pages(catalog: DataFrame) -> DataFrame:
    """archive, page_no, name of the image entries in natural order."""
    images = catalog.where(F.lower("name").rlike(r"\.(jpg|jpeg|png|gif|webp|bmp)$"))
    no = F.row_number().over(Window.partitionBy("archive").orderBy(natural_key(F.col("name")), "name", "entry_no")) - 1
    return images.select("archive", no.alias("page_no"), "name")


def cover_candidate(catalog: DataFrame) -> DataFrame:
    """archive, name: the first image entry of the best kind: named cover, then thumb, then any."""
    low = F.lower("name")
    images = catalog.where(low.rlike(r"\.(jpg|jpeg|png|gif|webp|bmp)$"))
    priority = F.when(low.contains("cover"), 0).when(low.contains("thumb"), 1).otherwise(2)
    return images.groupBy("archive").agg(F.min_by("name", F.struct(priority.alias("p"), "entry_no")).alias("name"))


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5("text").alias("md5"))


def verify_manifest(now: DataFrame, golden: DataFrame) -> DataFrame:
    """doc_id, status (missing, extra, changed) of what differs from the golden list."""
    j = now.join(golden.withColumnRenamed("md5", "want"), "doc_id", "full")
    status = F.when(F.col("md5").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("md5") != F.col("want"), "changed")
    return j.select("doc_id", status.alias("status")).where("status IS NOT NULL")


def assemble_parts(parts: DataFrame) -> DataFrame:
    """uid, name of parts(uid, kind, size), or book, uid, name where they have a book: canonical names; empty resources and the first flow part of each book are left out."""
    book = [c for c in parts.columns if c == "book"]
    first = parts.where("kind = 'flow'").groupBy(*book).agg(F.min("uid").alias("uid")).withColumn("kind", F.lit("flow"))
    named = parts.select(*book, "uid", "kind", F.format_string("%s%05d", "kind", "uid").alias("name"), "size")
    kept = named.where("NOT (kind = 'resource' AND size = 0)")
    return kept.join(first, [*book, "uid", "kind"], "left_anti").select(*book, "uid", "name")


def multi_values(items: DataFrame, most: int = 19) -> DataFrame:
    """key, names: the first `most` values in order, joined by |."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    return items.groupBy("key").agg(F.array_join(F.slice(held, 1, most), "|").alias("names"))


def missing_fonts(used: DataFrame, available: DataFrame) -> DataFrame:
    """font: the distinct fonts of used(font) that aren't among available(font)."""
    return used.distinct().join(available, "font", "left_anti")


def manifest_lookup(items: DataFrame, refs: DataFrame) -> DataFrame:
    """archive, href, entry_no of refs(archive, href): the first of items(archive, href, entry_no) with that href; null if there is none."""
    first = items.groupBy("archive", "href").agg(F.min("entry_no").alias("entry_no"))
    return refs.join(first, ["archive", "href"], "left")


#: Leading bytes of file formats, and the extensions that go with them.
SIGNATURES = {"jpg": ("FFD8FF", ("jpg", "jpeg")), "png": ("89504E470D0A1A0A", ("png",)), "bmp": ("424D", ("bmp",)), "cbr": ("526172211A07", ("cbr", "rar")), "cbz": ("504B0304", ("cbz", "zip"))}


def format_census(files: DataFrame) -> DataFrame:
    """ext, sniffed, agrees, n of files(path, content): the extension, the format that the first bytes tell, and whether they agree."""
    ext, head = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)), F.hex(F.substring("content", 1, 12))
    riff = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    sniffed = F.coalesce(F.when(riff, "webp"), *[F.when(head.startswith(sig), k) for k, (sig, _) in SIGNATURES.items()], F.lit("unknown"))
    rows = files.select(ext.alias("ext"), sniffed.alias("sniffed"))
    agrees = F.coalesce(*[F.when(F.col("sniffed") == k, F.col("ext").isin(*e)) for k, (_, e) in (SIGNATURES | {"webp": ("", ("webp",))}).items()], F.lit(False))
    return rows.groupBy("ext", "sniffed", agrees.alias("agrees")).agg(F.count("*").alias("n"))


def with_group_fn(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Rows that the caller's fn(pandas frame) returns for each group: a hook for logic of one page or image; a group must fit in a task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


TAGS = ["lang", "source", "n_chars"]


def _meta(s, d):
    docs = read_corpus(s, d, "documents")
    tags = docs.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in TAGS])).alias("ord", "x")).select("doc_id", "ord", "x.tag", "x.value")
    return tags.unionByName(docs.where("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("ord"), F.lit("n_chars").alias("tag"), F.col("n_chars").cast("string").alias("value")))


def _titles(s, d):
    """page_id and the titles of a page, best first."""
    tag = lambda t: F.regexp_extract("html", f"<{t}[^>]*>([^<]*)</{t}>", 1)
    return read_corpus(s, d, "pages").select("page_id", tag("h1").alias("updated"), tag("title").alias("full"), F.col("url").alias("db"))


def _edits(s, d):
    """One edit a document; every fifth has an add behind it, every fourth an earlier one that a set or delete undoes."""
    docs = read_corpus(s, d, "documents").where("doc_id % 7 < 4")
    one = docs.select("doc_id", F.lit(1).alias("seq"), F.expr("CASE doc_id % 7 WHEN 1 THEN 'delete' WHEN 3 THEN 'add' ELSE 'set' END").alias("op"), F.expr("CASE WHEN doc_id % 7 = 2 THEN 'note' ELSE 'lang' END").alias("tag"), F.lit("xx").alias("value"))
    more = [one.where(f"doc_id % {m} = 0").withColumns({"seq": F.lit(n), "op": F.lit("add"), "value": F.lit(v)}) for m, n, v in ((5, 2, "yy"), (4, 0, "zz"))]
    return one.unionByName(more[0]).unionByName(more[1])


def _props(s, d):
    p = read_corpus(s, d, "part")
    return p.select(F.col("p_partkey").alias("key"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in ("p_brand", "p_type", "p_size")])).alias("x")).select("key", "x.name", "x.value")


def _other(s, d):
    a = _props(s, d).where("NOT (key % 7 = 0 AND name = 'p_type')")
    a = a.withColumn("value", F.when(F.col("key") % 5 == 0, F.concat("value", F.lit("*"))).otherwise(F.col("value")))
    return a.unionByName(a.select("key").distinct().select("key", F.lit("added").alias("name"), F.lit("1").alias("value")))


def _values(s, d):
    """The other properties with a color for each brand and a truth value for each type, one in three of them unreadable."""
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("key") * 7919 % 16777216)), 6, "0"))
    word = F.element_at(F.array(F.lit("yes"), F.lit("FALSE"), F.lit("maybe")), (F.col("key") % 3 + 1).cast("int"))
    return _other(s, d).withColumn("value", F.when(F.col("name") == "p_brand", color).when(F.col("name") == "p_type", word).otherwise(F.col("value")))


def _catalog(s, d):
    p = read_corpus(s, d, "pages")
    kind = F.element_at(F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("archive"), F.col("page_id").alias("entry_no"), F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1), kind).alias("name"))


def _fonts(s, d, which="true"):
    """Names that stand for fonts: those that books use, or those that are at hand."""
    return read_corpus(s, d, "part").where(which).select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("font"))


def _parts(s, d):
    p = read_corpus(s, d, "part")
    kind = F.element_at(F.array(F.lit("markup"), F.lit("flow"), F.lit("resource")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("uid"), kind.alias("kind"), F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(F.col("p_size")).alias("size"))


_M = """WITH meta AS (SELECT doc_id, 0 AS ord, 'lang' AS tag, lang AS value FROM documents UNION ALL SELECT doc_id, 1, 'source', source FROM documents
UNION ALL SELECT doc_id, 2, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 9, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 2 = 0)"""
_E = """, edit AS (SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'delete' WHEN 3 THEN 'add' ELSE 'set' END AS op, CASE WHEN doc_id % 7 = 2 THEN 'note' ELSE 'lang' END AS tag, 'xx' AS value FROM documents WHERE doc_id % 7 < 4),
adds AS (SELECT doc_id, tag, value FROM edit WHERE op <> 'delete' UNION ALL SELECT doc_id, tag, 'yy' FROM edit WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, tag, 'zz' FROM edit WHERE doc_id % 4 = 0 AND op = 'add')"""
_A = """WITH a AS (SELECT p_partkey AS key, 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part),
b0 AS (SELECT key, name, CASE WHEN key % 5 = 0 THEN value || '*' ELSE value END AS value FROM a WHERE NOT (key % 7 = 0 AND name = 'p_type')),
b AS (SELECT * FROM b0 UNION ALL SELECT DISTINCT key, 'added', '1' FROM b0)"""
_C = "WITH c AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, page_id AS entry_no, regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) || ['.jpg', '.png', '.txt'][page_id % 3 + 1] AS name FROM pages)"


def _ab(f):
    return lambda s, d: f(_props(s, d), _other(s, d))


def _listed(s, d):
    """Documents written with a list of their files, and read back from those that are as the list says."""
    path = new_path(s, "listed")
    write_manifest(read_corpus(s, d, "documents").select("doc_id", "text"), path)
    return verified(s, path).select("doc_id", F.md5("text").alias("md5"))


REGISTERED = {
    "meta_wide": (lambda s, d: meta_wide(_meta(s, d), TAGS), f"{_M} SELECT doc_id, " + ", ".join(f"string_agg(value, '; ' ORDER BY ord) FILTER (WHERE tag = '{t}') AS {t}" for t in TAGS) + " FROM meta GROUP BY doc_id"),
    "title_fallback": (lambda s, d: title_fallback(_titles(s, d), ["updated", "full", "db"]).select("page_id", "title"), "SELECT page_id, coalesce(" + ", ".join(f"nullif(trim({x}), '')" for x in ("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)", "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)", "url")) + ") AS title FROM pages"),
    "apply_meta_edits": (lambda s, d: apply_edits(_meta(s, d), _edits(s, d)), f"{_M}{_E} SELECT doc_id, tag, value FROM meta m WHERE NOT EXISTS (SELECT 1 FROM edit e WHERE e.doc_id = m.doc_id AND e.tag = m.tag AND op <> 'add') UNION ALL SELECT doc_id, tag, value FROM adds"),
    "multi_author_genre": (lambda s, d: multi_values(_meta(s, d).withColumnRenamed("doc_id", "key")), f"{_M} SELECT doc_id AS key, string_agg(value, '|' ORDER BY ord, value) AS names FROM meta GROUP BY doc_id"),
    "props_minus": (_ab(minus), f"{_A} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.name = a.name)"),
    "props_union": (_ab(union), f"{_A} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.key = a.key AND b.name = a.name)"),
    "props_intersect": (_ab(intersect), f"{_A} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.name = a.name)"),
    "props_changed": (_ab(changed), f"{_A} SELECT b.key, b.name, b.value FROM b LEFT JOIN a USING (key, name) WHERE a.value IS DISTINCT FROM b.value"),
    "set_defaults": (lambda s, d: set_defaults(_other(s, d), s.createDataFrame([("p_type", "none"), ("p_font", "serif")], "name string, value string")), f"{_A}, d AS (SELECT * FROM (VALUES ('p_type', 'none'), ('p_font', 'serif')) v(name, value)) SELECT * FROM b UNION ALL SELECT k.key, d.name, d.value FROM (SELECT DISTINCT key FROM b) k, d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = k.key AND b.name = d.name)"),
    "typed_props": (lambda s, d: typed(_values(s, d)), f"""{_A}, v AS (SELECT key, name, CASE WHEN name = 'p_brand' THEN '#' || format('{{:06x}}', key * 7919 % 16777216) WHEN name = 'p_type' THEN ['yes', 'FALSE', 'maybe'][key % 3 + 1] ELSE value END AS value FROM b)
SELECT key, name, TRY_CAST(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN value END AS INTEGER) AS number, CASE WHEN value[1] = '#' THEN key * 7919 % 16777216 END AS color, CASE WHEN value IN ('yes', '1') THEN true WHEN value IN ('FALSE', '0') THEN false END AS flag FROM v"""),
    "catalog_pages": (lambda s, d: catalog_pages(_catalog(s, d)), None),
    "missing_fonts": (lambda s, d: missing_fonts(_fonts(s, d), _fonts(s, d, "p_partkey % 3 = 0")), "WITH f AS (SELECT p_brand || ' ' || p_size AS font, p_partkey FROM part) SELECT DISTINCT font FROM f WHERE font NOT IN (SELECT font FROM f WHERE p_partkey % 3 = 0)"),
    "manifest_lookup": (lambda s, d: manifest_lookup(_catalog(s, d).select("archive", F.col("name").alias("href"), "entry_no"), _catalog(s, d).select("archive", F.col("name").alias("href")).distinct()), f"{_C} SELECT archive, name AS href, min(entry_no) AS entry_no FROM c GROUP BY archive, name"),
    "cover_candidate": (lambda s, d: cover_candidate(_catalog(s, d)), f"{_C} SELECT archive, arg_min(name, (CASE WHEN contains(lower(name), 'cover') THEN 0 WHEN contains(lower(name), 'thumb') THEN 1 ELSE 2 END, entry_no)) AS name FROM c WHERE regexp_matches(lower(name), '[.](jpg|jpeg|png|gif|webp|bmp)$') GROUP BY archive"),
    "write_manifest": (lambda s, d: manifest(read_corpus(s, d, "documents")), "SELECT doc_id, md5(text) AS md5 FROM documents"),
    "verify_manifest": (lambda s, d: verify_manifest(manifest(read_corpus(s, d, "documents").where("doc_id % 11 <> 0")), manifest(read_corpus(s, d, "documents").withColumn("text", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))).where("doc_id % 17 <> 0"))), "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'extra' ELSE 'changed' END AS status FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 17 = 0) AND (doc_id % 11 = 0 OR doc_id % 17 = 0 OR (doc_id % 13 = 0 AND text <> ''))"),
    "assemble_books": (lambda s, d: assemble_parts(_parts(s, d).join(read_corpus(s, d, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("book")), "uid")), "WITH p AS (SELECT p_brand AS book, p_partkey AS uid, ['markup', 'flow', 'resource'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS size FROM part) SELECT book, uid, format('{}{:05d}', kind, uid) AS name FROM p WHERE NOT (kind = 'resource' AND size = 0) QUALIFY NOT (kind = 'flow' AND uid = min(CASE WHEN kind = 'flow' THEN uid END) OVER (PARTITION BY book))"),
    "write_manifest": (_listed, "SELECT doc_id, md5(text) AS md5 FROM documents"),
    "assemble_parts": (lambda s, d: assemble_parts(_parts(s, d)), "WITH p AS (SELECT p_partkey AS uid, ['markup', 'flow', 'resource'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS size FROM part) SELECT uid, format('{}{:05d}', kind, uid) AS name FROM p WHERE NOT (kind = 'resource' AND size = 0) AND NOT (kind = 'flow' AND uid = (SELECT min(uid) FROM p WHERE kind = 'flow'))"),
}
