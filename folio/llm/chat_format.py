"""Chat formatting with typed content parts and a reversible escape. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import count_words, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What opens or is a control string, in this template and in common others.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
KINDS = ("image", "audio", "document")


def _apart(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(c: Column) -> Column:
    """Doubles backslashes, then sets one behind the first character of each control string."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(_apart(s))), CONTROLS, F.replace(c, F.lit("\\"), F.lit("\\\\")))


def unescape(c: Column) -> Column:
    return F.replace(reduce(lambda x, s: F.replace(x, F.lit(_apart(s)), F.lit(s)), CONTROLS, c), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """Plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def _flatten(parts: Column) -> Column:
    """The visitor: an image, audio or document part becomes its placeholder; texts that follow each
    other are joined first and escaped as one, so that no control string arises where two meet."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    mark = lambda p: F.concat(F.lit("<|"), p["kind"], F.lit("|>"))

    def visit(a: Column, p: Column) -> Column:
        closed = F.struct(F.concat(a["done"], escape(a["open"]), mark(p)).alias("done"), F.lit("").alias("open"))
        more = F.struct(a["done"].alias("done"), F.concat(a["open"], F.coalesce(p["text"], F.lit(""))).alias("open"))
        return F.when(p["kind"].isin(*KINDS), closed).otherwise(more)

    return F.aggregate(parts, start, visit, lambda a: F.concat(a["done"], escape(a["open"])))


def format_chat(turns: DataFrame, parts: str | None = None, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens.

    turns has conv_id, turn, role and text, or, with `parts`, a column of that name that holds
    array<struct<kind, text, ref, tokens>>. Parts of kind image, audio or document become
    `<|kind|>` placeholders in their order; `attachments` lists them as (ordinal, kind, ref,
    tokens), and `expanded_tokens` adds their tokens, to which a placeholder expands (null: 0), to
    the words of the texts. Any other kind, null too, counts as text.
    `loss_spans` are (start, length) in code points of `formatted`, one for each turn whose
    role is in train_roles. Neighbouring texts are one text to the escape and to `parse_chat`.

    A null text, role or part list counts as empty; a null conv_id is a conversation of its
    own; turns with the same number, repeated rows too, follow in the order of role and body;
    a null turn comes first. An empty table gives no rows. Other columns are not looked at.
    Texts of any length are escaped whole. One shuffle, by conversation; a conversation is
    one cell of the result by nature.
    """
    content = F.coalesce(F.col(parts), F.array()) if parts else text_part(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts"), *([] if parts else ["text"]))
    rows = rows.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": _flatten(F.col("parts")) if parts else escape(F.coalesce("text", F.lit(""))), "att": F.filter("parts", lambda p: p["kind"].isin(*KINDS))})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumns({"no": F.row_number().over(order), "until": F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("until") - F.length("piece") + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("role").isin(*train_roles), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    spoken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(p["kind"].isin(*KINDS), F.coalesce(p["tokens"].cast("long"), F.lit(0))).otherwise(count_words(p["text"])))
    one = F.struct("no", "piece", "span", "att", spoken.alias("tokens"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["no"] - b["no"]).alias("t"), F.count("*").alias("n_turns"))
    att = F.flatten(F.transform("t", lambda x: x["att"]))
    return convs.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        "n_turns",
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform(att, lambda p, i: F.struct(i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text, parts>> read back from a formatted conversation.

    `parts` is array<struct<kind, text>>: texts unescaped, attachments with a null text, so that a
    text that spells a placeholder and a placeholder are told apart; neighbouring texts come
    back as one, empty ones not at all. `text` is the turn in one string, placeholders as they are."""
    mark = [f"<\\|{k}\\|>" for k in KINDS]
    edges = "|".join([f"(?={m})" for m in mark] + [f"(?<={m})" for m in mark])
    body = lambda p: F.substring_index(F.substring_index(p, TEXT, -1), END, 1)
    part = lambda x: F.when(F.startswith(x, F.lit("<|")), F.struct(F.substr(x, F.lit(3), F.length(x) - 4).alias("kind"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("kind"), unescape(x).alias("text")))
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p, i: i > 0)
    parts = lambda p: F.transform(F.filter(F.split(body(p), edges, -1), lambda x: x != ""), part)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(body(p)).alias("text"), parts(p).alias("parts")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    out = format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    turns = F.array_join(F.transform(parse_chat(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumns({"_turns": turns, "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return out.select(
        "conv_id",
        F.size(parse_chat(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2("_turns", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in CONTROLS:
        c = f"replace({c}, '{s}', '{_apart(s)}')"
    return c


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length({_sql_escape('role')}) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars,
  CAST(sum(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id
"""
