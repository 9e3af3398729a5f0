"""Fill-in-middle transformation: one match of a per-row pattern with counted possessive groups cuts each whole text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import table

#: A unit of text: a run of letters A-Z, or any other code point.
UNIT, UNIT_OF_MATCH = r"[A-Za-z]+|[^A-Za-z]", r"[A-Za-z]++|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """marks, if the output can be taken apart wherever they stand: none is empty, holds another, or ends as one begins."""
    for a in marks:
        for b in marks:
            if not a or a != b and a in b or any(a.endswith(b[:n]) for n in range(1, len(b) if a == b else len(b) + 1)):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    return marks


def _numbers(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit integers from sha256 of `1:` and the decimal id (a null id: nothing behind the colon)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, plain_rate: int = 10, spm_rate: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, output for every row of docs(doc_id, text).

    A text of n units is cut at two places that hang on its id. Its pattern counts the units
    of each piece, `((?:unit){a}+)((?:unit){b-a}+)(.*)`: possessive counts run as loops
    without a stack or a way back, whatever the length of the text, and one match captures
    prefix, middle and suffix, which the replacement puts in the order of the form: psm, spm
    (spm_rate per cent of those cut), or plain, the text as it is: empty texts, those that hold
    a mark, and plain_rate per cent of the others.

    A null text is an empty one, a null id counts as no digits; repeated rows and equal ids have
    equal outputs; an empty table gives an empty one. Other columns aren't read. No shuffle;
    a task holds one row at a time. `restore` rebuilds the text.
    """
    p, s, m = _checked(marks)
    h1, h2, h3, h4 = _numbers(F.col("doc_id"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)])
    held = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= 100 - plain_rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("a"), F.abs(x - y).alias("d"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT_OF_MATCH}){{"), F.col("a"), F.lit(rf"}}+)((?:{UNIT_OF_MATCH}){{"), F.col("d"), F.lit(r"}+)(.*)\z"))
    quoted = [x.replace("\\", "\\\\").replace("$", "\\$") for x in marks]
    order = F.when(F.col("form") == "spm", f"{quoted[1]}$3{quoted[0]}$1{quoted[2]}$2").otherwise(f"{quoted[0]}$1{quoted[1]}$3{quoted[2]}$2")
    return rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))


def pieces(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """struct<prefix, middle, suffix> of an output; null if it is plain. No piece holds a mark, so one split finds all."""
    at = F.split(output, "|".join(re.escape(m) for m in _checked(marks)), -1)
    parts = lambda x, p, s: F.struct(x[p].alias("prefix"), x[3].alias("middle"), x[s].alias("suffix"))
    # a list of one, so that the split is made once for all three
    return F.transform(F.array(at), lambda x: F.when(form == "psm", parts(x, 1, 2)).when(form == "spm", parts(x, 2, 1)))[0]


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    joined = F.transform(F.array(pieces(output, form, marks)), lambda x: F.concat(x["prefix"], x["middle"], x["suffix"]))[0]
    return F.coalesce(joined, output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda p: F.struct(F.length(p["prefix"]).cast("long").alias("prefix_chars"), F.length(p["middle"]).cast("long").alias("middle_chars"), digest(F.concat(p["prefix"], p["middle"], p["suffix"])).alias("restored"))
    out = out.withColumn("x", F.transform(F.array(pieces(F.col("output"), F.col("form"))), chars)[0]).select("doc_id", "n", "form", "x", digest(F.col("output")).alias("output_sha256"))
    return out.select("doc_id", "n", "form", "x.prefix_chars", "x.middle_chars", "output_sha256", F.coalesce("x.restored", "output_sha256").alias("restored_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u, {", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
f AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
