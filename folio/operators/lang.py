"""Scripts, languages and words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import COMPAT, PRE_BASE, PUNCT, RTL, RTL_RUNS, SPACES, count_chars, fold_compat, literal_pos, reorder_indic, rtl_runs, split_trim, truncate_meta
from folio.sources.shared import cut
from folio.sources.tables import lines, read_corpus, with_

#: Unicode ranges of the scripts told apart.
SCRIPTS = {"rtl": "[\\x{0590}-\\x{08FF}]", "cjk": "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]", "devanagari": "[\\x{0900}-\\x{097F}]", "bengali": "[\\x{0980}-\\x{09FF}]", "gujarati": "[\\x{0A80}-\\x{0AFF}]", "oriya": "[\\x{0B00}-\\x{0B7F}]", "tamil": "[\\x{0B80}-\\x{0BFF}]", "telugu": "[\\x{0C00}-\\x{0C7F}]", "kannada": "[\\x{0C80}-\\x{0CFF}]", "malayalam": "[\\x{0D00}-\\x{0D7F}]", "latin_accents": "[\\x{00C0}-\\x{017F}]"}
#: Hyphenation patterns as letters and digits, and suffix rules.
PATTERNS = (".ch4", "1ti", "4ing.", "n1t", "e1r", "h1e", "a1t", "o1n", "r2e", "s1s", "2th", "i1n", "t1l", "d1e", "a2n", "1ble", "o2u", "1sh", "e2a", "2nd.")
SUFFIXES = (("s", 1), ("es", 2), ("ing", 3), ("tion", 4), ("ed", 5), ("er", 6), ("en", 7), ("ung", 8), ("eux", 9), ("ly", 10))


def script_census(docs: DataFrame) -> DataFrame:
    """source, script, docs: how many documents of a source use each script, with subtotals (null: all)."""
    found = docs.select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("script"), F.col("text").rlike(rx).alias("has")) for k, rx in SCRIPTS.items()])).alias("x"))
    return found.cube("source", F.col("x.script").alias("script")).agg(F.count_if("x.has").alias("docs"))


def _bigrams(docs: DataFrame, key: str) -> DataFrame:
    """key, bigram: each pair of neighbouring code points of the texts."""
    chars = docs.select(key, F.split(F.lower("text"), "").alias("c")).where(F.size("c") > 1)
    n = F.size("c") - 1
    return chars.select(key, F.explode(F.zip_with(F.slice("c", 1, n), F.slice("c", 2, n), lambda a, b: F.concat(a, b))).alias("bigram"))


def _pairs(text: str | None) -> np.ndarray:
    """The pairs of neighbouring code points of a text, each as a whole number."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return points[:-1] << 21 | points[1:]


def _pair_counts(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """lang, bigram, n: partial counts of the pairs of texts, some `most` pairs at a time in Python workers."""

    def counted(lang, held):
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": [lang] * len(pairs), "bigram": [chr(p >> 21) + chr(p & 0x1FFFFF) for p in pairs.tolist()], "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if len(pairs := _pairs(text)):
                    held[lang].append(pairs)
                    size += len(pairs)
                if size >= most:
                    yield from (counted(*x) for x in held.items())
                    held, size = defaultdict(list), 0
        yield from (counted(*x) for x in held.items())

    return docs.select("lang", F.lower("text").alias("text")).mapInPandas(count, "lang string, bigram string, n long")


def bigram_profiles(docs: DataFrame, top: int = 50) -> DataFrame:
    """lang, rank, bigram, n: the most frequent pairs of code points of each language."""
    counts = _pair_counts(docs).groupBy("lang", "bigram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bigram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "bigram", "n")


def _pair_products(texts: DataFrame, profiles: DataFrame, langs: list[str]) -> DataFrame:
    """doc_id, lang, d, qq of texts(doc_id, text): the products of a text's counts of pairs with those of each profile that
    shares one, and with themselves. Counted a text at a time in Python workers."""
    rows = [(ord(r["bigram"][0]) << 21 | ord(r["bigram"][1]), langs.index(r["lang"]), r["n"]) for r in profiles.select("lang", "bigram", "n").collect()]
    known = np.unique(np.array([r[0] for r in rows], np.int64))
    weights = np.zeros((len(known), len(langs)), np.int64)
    for pair, lang, n in rows:
        weights[np.searchsorted(known, pair), lang] += n

    def products(text: str | None) -> list[int]:
        pairs, counts = np.unique(_pairs(text), return_counts=True)
        _, own, at = np.intersect1d(pairs, known, assume_unique=True, return_indices=True)
        return [*(counts[own] @ weights[at]).tolist(), int((counts * counts).sum())]

    @F.pandas_udf("array<long>")
    def look(texts: pd.Series) -> pd.Series:
        return texts.map(products)

    found = texts.select("doc_id", look(F.lower("text")).alias("x"))
    each = F.array(*[F.struct(F.lit(name).alias("lang"), F.get("x", F.lit(i)).alias("d")) for i, name in enumerate(langs)])
    return found.select("doc_id", F.get("x", F.lit(len(langs))).alias("qq"), F.inline(each)).where("d > 0")


def detect_language(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score: the profile with the largest cosine; ties to the smaller name.

    Documents that share no pair with any profile give no row. A profile is a bounded list for
    each language, so all workers have it; pairs are counted within a text's row. Only texts
    that share an id are counted as one, by id and pair."""
    profiles = cut(profiles.where("lang IS NOT NULL"), "profiles")
    norms = profiles.groupBy("lang").agg(F.sum(F.col("n") * F.col("n")).alias("nn"))
    langs = [r["lang"] for r in norms.select("lang").orderBy("lang").collect()]
    docs = docs.where("doc_id IS NOT NULL")
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "again")
    products = _pair_products(docs.join(again, "doc_id", "left_anti"), profiles, langs)
    if again.limit(1).count():
        counts = _bigrams(docs.join(again, "doc_id", "left_semi"), "doc_id").groupBy("doc_id", "bigram").agg(F.count("*").alias("q"))
        dots = counts.join(F.broadcast(profiles.select("lang", "bigram", "n")), "bigram").groupBy("doc_id", "lang").agg(F.sum(F.col("q") * F.col("n")).alias("d"))
        own = counts.groupBy("doc_id").agg(F.sum(F.col("q") * F.col("q")).alias("qq"))
        products = products.unionByName(dots.join(own, "doc_id"))
    score = F.round(F.col("d") / F.sqrt("qq") / F.sqrt("nn"), 6).alias("score")
    scored = products.join(F.broadcast(norms), "lang").select("doc_id", "lang", score)
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "lang")).alias("b"))
    return best.select("doc_id", F.col("b.lang").alias("lang_pred"), (-F.col("b.s")).alias("score"))


def encoding_validity(files: DataFrame) -> DataFrame:
    """kind, valid, bom, files of files(kind, content): whether the bytes are UTF-8, and whether a mark of byte order leads them."""
    head = F.hex(F.substring("content", 1, 3))
    return files.groupBy("kind", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), (head.like("EFBBBF%") | head.like("FFFE%") | head.like("FEFF%")).alias("bom")).agg(F.count("*").alias("files"))


def locale_names(meta: DataFrame, locales: DataFrame) -> DataFrame:
    """doc_id, number of meta(doc_id, lang) by locales(code, number); null for an unknown code."""
    return meta.join(locales, F.col("lang") == F.col("code"), "left").select("doc_id", "number")


def vocab(docs: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    return docs.select(F.explode(words).alias("word")).distinct()


def _longest(rules: DataFrame, name: str) -> int:
    """Length of the longest entry of a small table, 1 at least."""
    return max(rules.agg(F.max(F.length(name))).first()[0] or 1, 1)


def hyphenate(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """word, pos: break points by patterns(txt, digits): the largest digit at a gap, odd means a break, two letters stay on both sides.

    Substrings are as long as the longest pattern, edge marks included."""
    n, most = F.length("word"), _longest(patterns, "txt")
    padded = F.concat(F.lit("."), "word", F.lit("."))
    rows = words.where(n > 3).select("word", padded.alias("p"), (n + 2).alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("m") - F.col("i") + 1))).alias("k"))
    rows = rows.select("word", "i", F.substr("p", F.col("i"), F.col("k")).alias("txt"))
    hits = rows.join(F.broadcast(patterns), "txt").select("word", "i", F.posexplode("digits").alias("j", "digit"))
    best = hits.groupBy("word", (F.col("i") + F.col("j") - 2).alias("pos")).agg(F.max("digit").alias("digit"))
    return best.where((F.col("digit") % 2 == 1) & (F.col("pos") >= 2) & (F.col("pos") <= F.length("word") - 2)).select("word", "pos")


#: Vowels, signs that are no consonants, and pairs that stay together, for languages without patterns.
VOWELS, SIGNS, PAIRS = "aeiouyàáâäåæèéêëìíîïòóôöøùúûüýÿœаеёиоуыэюя", "ьъ", ("sh", "th", "ph", "ch")


def hyphenate_rules(words: DataFrame) -> DataFrame:
    """word, pos: breaks without patterns. A vowel that another follows anywhere later allows a break behind it, behind the
    first of two consonants after it, or behind a consonant and its sign; two letters stay in front and at the end, and
    nothing parts a pair."""
    n, at = F.length("word"), F.sequence(F.lit(1), F.length("word"))
    rows = words.where(n > 2).select("word", F.explode(at).alias("i")).where(F.col("i") < n - 1)
    ch = lambda k: F.substr("word", F.col("i") + k, F.lit(1))
    vowel, sign = (lambda c: F.contains(F.lit(VOWELS), c)), (lambda c: F.contains(F.lit(SIGNS), c))
    consonant = lambda c: ~vowel(c) & ~sign(c)
    later = F.length(F.translate(F.substr("word", F.col("i") + 1, n), VOWELS, "")) < n - F.col("i")
    step = F.when(consonant(ch(F.lit(1))) & consonant(ch(F.lit(2))), 1).when(consonant(ch(F.lit(1))) & sign(ch(F.lit(2))), 2).otherwise(0)
    rows = rows.where(vowel(ch(F.lit(0))) & later).select("word", (F.col("i") + step).alias("pos"))
    pair = F.substr("word", F.col("pos"), F.lit(2))
    return rows.where((F.col("pos") >= 2) & (n - F.col("pos") >= 2) & ~pair.isin(*PAIRS)).distinct()


def suffix_lookup(words: DataFrame, rules: DataFrame) -> DataFrame:
    """word, suffix, value of the longest rule that ends the word."""
    rows = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(_longest(rules, "suffix")), F.length("word")))).alias("k")).select("word", F.expr("right(word, k)").alias("suffix"))
    hit = rows.join(F.broadcast(rules), "suffix")
    return hit.groupBy("word").agg(F.max_by(F.struct("suffix", "value"), F.length("suffix")).alias("x")).select("word", "x.suffix", "x.value")


def patterns(spark) -> DataFrame:
    """txt, digits (one for each gap, before the first letter too) of PATTERNS."""
    out = []
    for p in PATTERNS:
        txt, digits = "", [0]
        for c in p:
            if c.isdigit():
                digits[-1] = int(c)
            else:
                txt += c
                digits.append(0)
        out.append((txt, digits))
    return spark.createDataFrame(out, "txt string, digits array<int>")


def _docs(s, d):
    return read_corpus(s, d, "documents")


_V = r"vocab AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE word <> '')"
_R = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in SUFFIXES) + ") v(suffix, value))"


def _pattern_rows() -> str:
    rows = []
    for p in PATTERNS:
        txt = "".join(c for c in p if not c.isdigit())
        digits, k = [0] * (len(txt) + 1), 0
        for c in p:
            if c.isdigit():
                digits[k] = int(c)
            else:
                k += 1
        rows.append(f"('{txt}', {digits})")
    return "pats AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(txt, digits))"


#: Letters that stand for others, so that the corpus holds Devanagari and Hebrew.
INDIC, HEBREW = ("iknt", "\u093f\u0915\u0928\u0924"), ("aeiourst", "\u05d0\u05d4\u05d9\u05e2\u05d5\u05e8\u05e9\u05ea")
_FILES = {1: "FF", 2: "EFBBBF", 3: "C3"}


def _files(s, d):
    """Texts as bytes, some with a mark of byte order or a torn character in front."""
    lead = F.element_at(F.array(F.lit(""), *[F.lit(v) for v in _FILES.values()]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(s, d).select(F.col("lang").alias("kind"), F.unhex(F.concat(lead, F.hex(F.encode("text", "UTF-8")))).alias("content"))


REGISTERED = {
    "fold_compat": (lambda s, d: _docs(s, d).select("doc_id", fold_compat(F.col("text")).alias("folded")), f"SELECT doc_id, translate(text, '{COMPAT[0]}', '{COMPAT[1]}') AS folded FROM documents"),
    "literal_pos": (lambda s, d: _docs(s, d).select("doc_id", literal_pos(F.col("text"), F.lit("the")).alias("first"), literal_pos(F.col("text"), F.lit("e"), 100).alias("later")), "SELECT doc_id, CAST(strpos(text, 'the') - 1 AS INTEGER) AS first, CAST(CASE WHEN strpos(substring(text, 101), 'e') = 0 THEN -1 ELSE strpos(substring(text, 101), 'e') + 99 END AS INTEGER) AS later FROM documents"),
    "split_trim": (lambda s, d: _docs(s, d).select("doc_id", F.array_join(split_trim(F.col("text"), "[.]"), "|").alias("kept"), F.size(split_trim(F.col("text"), "[.]", False)).alias("pieces")), "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'), ' ')), lambda x: x <> ''), '|') AS kept, CAST(len(string_split(text, '.')) AS INTEGER) AS pieces FROM documents"),
    "truncate_meta": (lambda s, d: read_corpus(s, d, "pages").select("page_id", truncate_meta(F.col("html")).alias("head")), "SELECT page_id, left(html, 2000) AS head FROM pages"),
    "encoding_validity": (lambda s, d: encoding_validity(_files(s, d)), "SELECT lang AS kind, doc_id % 4 NOT IN (1, 3) AS valid, doc_id % 4 = 2 AS bom, count(*) AS files FROM documents GROUP BY ALL"),
    "locale_names": (lambda s, d: locale_names(_docs(s, d), s.createDataFrame([("en", 9), ("fr", 12), ("de", 7)], "code string, number int")), "SELECT doc_id, number FROM documents LEFT JOIN (VALUES ('en', 9), ('fr', 12), ('de', 7)) v(code, number) ON lang = code"),
    "script_census": (lambda s, d: script_census(_docs(s, d)), "WITH x AS (SELECT source, k AS script, regexp_matches(text, rx) AS has FROM documents, (VALUES " + ", ".join(f"('{k}', '{rx}')" for k, rx in SCRIPTS.items()) + ") v(k, rx)) SELECT source, script, count(*) FILTER (WHERE has) AS docs FROM x GROUP BY CUBE (source, script)"),
    "train_bigram_profiles": (lambda s, d: bigram_profiles(_docs(s, d)), "WITH a AS (SELECT doc_id, lang, unnest(string_split(lower(text), '')) AS x, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM documents), b AS (SELECT lang, x || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS bigram FROM a), c AS (SELECT lang, bigram, count(*) AS n FROM b WHERE bigram IS NOT NULL GROUP BY ALL) SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, bigram) AS INTEGER) AS rank, bigram, n FROM c QUALIFY rank <= 50"),
    "detect_language": (lambda s, d: detect_language(_docs(s, d), bigram_profiles(_docs(s, d))), """WITH a AS (SELECT doc_id, lang, unnest(string_split(lower(text), '')) AS x, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM documents),
b AS (SELECT doc_id, lang, x || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS bigram FROM a),
p AS (SELECT lang, bigram, count(*) AS n FROM b WHERE bigram IS NOT NULL GROUP BY lang, bigram QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, bigram) <= 50),
q AS (SELECT doc_id, bigram, count(*) AS q FROM b WHERE bigram IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, lang, round(CAST(sum(q * n) AS DOUBLE) / sqrt(CAST(any_value(qq) AS DOUBLE)) / sqrt(CAST(any_value(nn) AS DOUBLE)), 6) AS score
  FROM q JOIN p USING (bigram) JOIN (SELECT doc_id, sum(q * q) AS qq FROM q GROUP BY doc_id) USING (doc_id) JOIN (SELECT lang, sum(n * n) AS nn FROM p GROUP BY lang) USING (lang) WHERE lang IS NOT NULL GROUP BY doc_id, lang)
SELECT doc_id, lang AS lang_pred, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1"""),
    "hyphenate_vocab": (lambda s, d: hyphenate(vocab(_docs(s, d)), patterns(s)), f"WITH {_V}, {_pattern_rows()}, g AS (SELECT word, i, txt, digits FROM (SELECT word, '.' || word || '.' AS p, unnest(range(1, length(word) + 3)) AS i FROM vocab WHERE length(word) > 3) w JOIN pats ON substring(w.p, CAST(i AS INTEGER), length(txt)) = txt), h AS (SELECT word, CAST(i + j - 3 AS INTEGER) AS pos, digit FROM (SELECT word, i, unnest(digits) AS digit, generate_subscripts(digits, 1) AS j FROM g)) SELECT word, pos FROM h GROUP BY word, pos HAVING max(digit) % 2 = 1 AND pos BETWEEN 2 AND length(word) - 2"),
    "hyphenate_rules": (lambda s, d: hyphenate_rules(vocab(_docs(s, d))), f"""WITH {_V}, a AS (SELECT word, CAST(i AS INTEGER) AS i, [CASE WHEN contains('{VOWELS}', x) THEN 'v' WHEN contains('{SIGNS}', x) THEN 's' ELSE 'c' END FOR x IN string_split(word, '')] AS k FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM vocab WHERE length(word) > 2)),
b AS (SELECT word, i + CASE WHEN k[i + 1] = 'c' AND k[i + 2] = 'c' THEN 1 WHEN k[i + 1] = 'c' AND k[i + 2] = 's' THEN 2 ELSE 0 END AS pos FROM a WHERE k[i] = 'v' AND list_contains(k[i + 1:], 'v'))
SELECT DISTINCT word, pos FROM b WHERE pos >= 2 AND length(word) - pos >= 2 AND substring(word, pos, 2) NOT IN {PAIRS}"""),
    "char_classes": (lambda s, d: _docs(s, d).select("doc_id", count_chars(F.col("text"), PUNCT).alias("puncts"), count_chars(F.col("text"), SPACES + " ").alias("spaces")), "SELECT doc_id, " + ", ".join(f"CAST(length(text) - length(translate(text, '{c}', '')) AS INTEGER) AS {n}" for c, n in ((PUNCT.replace("'", "''"), "puncts"), (SPACES + " ", "spaces"))) + " FROM documents"),
    "reorder_indic": (lambda s, d: lines(_docs(s, d).withColumn("text", F.translate("text", INDIC[0], INDIC[1]))).select("doc_id", "line_no", reorder_indic(F.col("line")).alias("line")), f"{with_('lines')} SELECT doc_id, line_no, regexp_replace(translate(line, '{INDIC[0]}', '{INDIC[1]}'), '{PRE_BASE}', '\\2\\1', 'g') AS line FROM lines"),
    "rtl_runs": (lambda s, d: lines(_docs(s, d).withColumn("text", F.translate("text", HEBREW[0], HEBREW[1]))).select("doc_id", "line_no", rtl_runs(F.col("line")).alias("line")), f"{with_('lines')}, t AS (SELECT doc_id, line_no, translate(line, '{HEBREW[0]}', '{HEBREW[1]}') AS line FROM lines) SELECT doc_id, line_no, array_to_string([CASE WHEN regexp_matches(x, '^[{RTL}]') THEN reverse(x) ELSE x END FOR x IN regexp_extract_all(line, '{RTL_RUNS}')], '') AS line FROM t"),
    "suffix_lookup": (lambda s, d: suffix_lookup(vocab(_docs(s, d)), s.createDataFrame(list(SUFFIXES), "suffix string, value int")), f"WITH {_V}, {_R} SELECT word, suffix, value FROM vocab JOIN rules ON ends_with(word, suffix) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(suffix) DESC) = 1"),
}
