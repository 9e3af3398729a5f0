"""Style sheets: rules and declarations of pages, box shorthands, the cascade, selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import read_corpus

SIDES = ("top", "right", "bottom", "left")
#: Which of one to four values a side takes, by their number.
TAKES = {1: (1, 1, 1, 1), 2: (1, 2, 1, 2), 3: (1, 2, 3, 2), 4: (1, 2, 3, 4)}
#: Properties whose first value stays; of the others the last one that isn't empty wins.
FIRST = ("text-align", *[f"{p}-{s}" for p in ("margin", "padding") for s in SIDES])
#: Properties that every level of embedded styles keeps; those of the levels with fonts, and with margins; level 5 keeps all.
PLAIN = ("display", "font-weight", "font-style", "text-decoration", "list-style-type", "vertical-align")
FONTS, MARGINS = ("font-family",), (*FIRST, "text-indent")


#: More than a rule can have declarations: the order of declarations is that of (rule, declaration).
BESIDE = 1 << 32


def parse_style_rules(sheets: DataFrame) -> DataFrame:
    """page_id, selector, prop, value, ord of sheets(page_id, css): comments and `!important` go, white space is collapsed."""
    clean = F.regexp_replace("css", r"(?s)/\*.*?\*/", "")
    rules = F.regexp_extract_all(clean, F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(0))
    rows = sheets.select("page_id", F.posexplode(rules).alias("r", "rule"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = rows.select("page_id", "r", tidy(F.substring_index("rule", "{", 1)).alias("selector"), F.posexplode(F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";", -1)).alias("k", "decl"))
    rows = rows.where(F.contains("decl", F.lit(":")))
    value = tidy(F.regexp_replace(F.regexp_extract("decl", r"(?s):(.*)$", 1), "!important", ""))
    return rows.select("page_id", "selector", F.lower(tidy(F.substring_index("decl", ":", 1))).alias("prop"), value.alias("value"), (F.col("r").cast("long") * BESIDE + F.col("k")).alias("ord"))


def expand_box_shorthand(decls: DataFrame) -> DataFrame:
    """decls with margin and padding of one to four values as four sides (of more, the first four count); not for
    body, and not for a side that the selector sets itself."""
    short = decls.where(F.col("prop").isin("margin", "padding") & (F.col("selector") != "body") & (F.col("value") != ""))
    v = F.split("value", " ")
    pick = lambda i: F.coalesce(*[F.when(F.least(F.size(v), F.lit(4)) == n, F.element_at(v, t[i])) for n, t in TAKES.items()])
    sides = F.explode(F.array(*[F.struct(F.concat("prop", F.lit(f"-{s}")).alias("prop"), pick(i).alias("value")) for i, s in enumerate(SIDES)]))
    long = short.select("page_id", "selector", sides.alias("x"), "ord").select("page_id", "selector", "x.prop", "x.value", "ord")
    own = decls.where(F.col("prop").isin(*FIRST)).select("page_id", "selector", "prop").distinct()
    return decls.where(~F.col("prop").isin("margin", "padding")).unionByName(long.join(own, ["page_id", "selector", "prop"], "left_anti"))


def cascade(decls: DataFrame) -> DataFrame:
    """page_id, selector, prop, value: one value of each property, empty ones left out: the first one for boxes and alignment, the last one otherwise."""
    some = decls.where(F.col("value") != "").groupBy("page_id", "selector", "prop").agg(F.min_by("value", "ord").alias("first"), F.max_by("value", "ord").alias("last"))
    return some.select("page_id", "selector", "prop", F.when(F.col("prop").isin(*FIRST), F.col("first")).otherwise(F.col("last")).alias("value"))


def select_by_level(styles: DataFrame, level: int) -> DataFrame:
    """What a level of embedded styles keeps: 1 plain ones, 2 with fonts, 3 with margins, 4 with both, 5 everything."""
    kept = PLAIN + (FONTS if level in (2, 4) else ()) + (MARGINS if level in (3, 4) else ())
    zero = F.col("prop").isin(*[p for p in FIRST if p != "text-align"]) & (F.col("value") == "0")
    return styles if level == 5 else styles.where(F.col("prop").isin(*kept) & ~zero)


def is_valid_selector(c: Column) -> Column:
    """Whether a selector has legal characters only, no digit after a dot, space or comma, and paired quotes and brackets."""
    legal = c.rlike(r'^[-./0-9A-Za-z ,=_"<>\[\]]+$') & ~c.rlike(r"[. ,][-./0-9]")
    return legal & c.rlike(r"^[^\[\]]*(\[[^\[\]]*\][^\[\]]*)*$") & (F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 0)


def valid_selectors(decls: DataFrame) -> DataFrame:
    """selector, valid of the distinct selectors."""
    return decls.select("selector").distinct().select("selector", is_valid_selector(F.col("selector")).alias("valid"))


def style_flags(styles: DataFrame) -> DataFrame:
    """page_id, flag, selectors: how many selectors of a page set right-to-left, bold, italic or underlined text."""
    flag = F.when((F.col("prop") == "direction") & (F.col("value") == "rtl"), "rtl").when((F.col("prop") == "font-weight") & F.col("value").isin("bold", "bolder", "700"), "bold")
    flag = flag.when((F.col("prop") == "font-style") & F.col("value").isin("italic", "oblique"), "italic").when((F.col("prop") == "text-decoration") & (F.col("value") == "underline"), "underline")
    return styles.withColumn("flag", flag).where("flag IS NOT NULL").groupBy("page_id", "flag").agg(F.count_distinct("selector").alias("selectors"))


def apply_styles(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """page_id, el, prop, value of elements(page_id, el, tag, class, id): ids win over classes, classes over tags, a later selector over an earlier one.

    One equal join for each kind of selector; styles(page_id, selector, prop, value, ord)."""
    kinds = (("tag", "", 1), ("class", ".", 10), ("id", "#", 100))
    hits = None
    for name, mark, weight in kinds:
        own = elements.where(F.col(name).isNotNull()).select("page_id", "el", F.concat(F.lit(mark), name).alias("selector"), F.lit(weight).alias("weight"))
        hits = own if hits is None else hits.unionByName(own)
    best = hits.join(styles, ["page_id", "selector"]).groupBy("page_id", "el", "prop").agg(F.max_by("value", F.struct("weight", "ord")).alias("value"))
    return best.select("page_id", "el", "prop", "value")


RULES = (
    ".a{margin:1em 2em}", "p{padding:1px 2px 3px;text-align:left}", ".b{margin:1px 2px 3px 4px;margin-left:9px}", "body{margin:5px}", "p{font-weight:bold;font-weight:}",
    "/* p{color:red} */ .c{font-style:italic !important}", "p{text-align:right;text-indent:1em}", ".9x{display:none}", 'h1[a="b]{font-family:serif}', "#z{direction:rtl;font-family:mono}",
    "h1{text-decoration:underline;margin-top:0}", "p{font-family:serif; ; display:block}",
)


def _sheets(s, d):
    """The style blocks of a page, and two rules more that its number chooses."""
    p = read_corpus(s, d, "pages")
    own = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<style[^>]*>(.*?)</style>"), F.lit(1)), "")
    rule = lambda k: F.element_at(F.array(*map(F.lit, RULES)), ((F.col("page_id") * k) % len(RULES) + 1).cast("int"))
    return p.select("page_id", F.concat(own, rule(1), rule(5)).alias("css"))


def _elements(s, d):
    p = read_corpus(s, d, "pages")
    el = F.explode(F.array(*[F.struct(F.lit(i).alias("el"), F.lit(t).alias("tag"), F.lit(c).cast("string").alias("class"), F.lit(x).cast("string").alias("id")) for i, (t, c, x) in enumerate(ELEMENTS)]))
    return p.select("page_id", el.alias("e")).select("page_id", "e.*")


ELEMENTS = (("p", None, None), ("p", "a", None), ("h1", "c", "z"), ("div", "b", "z"))
_LIST = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in RULES) + "]"
_T = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_D = rf"""WITH sheets AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1), '') || {_LIST}[page_id % 12 + 1] || {_LIST}[page_id * 5 % 12 + 1] AS css FROM pages),
rl AS (SELECT page_id, unnest(rs) AS rule, generate_subscripts(rs, 1) - 1 AS r FROM (SELECT page_id, regexp_extract_all(regexp_replace(css, '(?s)/\*.*?\*/', '', 'g'), '([^{{}}]+)\{{([^{{}}]*)\}}') AS rs FROM sheets)),
dc AS (SELECT page_id, r, {_T("split_part(rule, '{', 1)")} AS selector, unnest(ds) AS decl, generate_subscripts(ds, 1) - 1 AS k FROM (SELECT *, string_split(regexp_extract(rule, '\{{([^{{}}]*)\}}', 1), ';') AS ds FROM rl)),
decls AS (SELECT page_id, selector, lower({_T("split_part(decl, ':', 1)")}) AS prop, {_T("regexp_replace(regexp_extract(decl, '(?s):(.*)$', 1), '!important', '', 'g')")} AS value, CAST(r AS BIGINT) * 4294967296 + k AS ord FROM dc WHERE contains(decl, ':'))"""
_F = ", ".join(f"'{p}'" for p in FIRST)
_X = f""", long AS (SELECT page_id, selector, prop || '-' || side AS prop, v[CASE least(len(v), 4) WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c ELSE e END] AS value, ord
  FROM (SELECT *, string_split(value, ' ') AS v FROM decls WHERE prop IN ('margin', 'padding') AND selector <> 'body' AND value <> ''), (VALUES ('top', 1, 1, 1, 1), ('right', 1, 2, 2, 2), ('bottom', 1, 1, 3, 3), ('left', 1, 2, 2, 4)) s(side, a, b, c, e)),
boxed AS (SELECT * FROM decls WHERE prop NOT IN ('margin', 'padding') UNION ALL SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM decls o WHERE o.page_id = l.page_id AND o.selector = l.selector AND o.prop = l.prop AND o.prop IN ({_F})))"""
_C = f"{_X}, styles AS (SELECT page_id, selector, prop, CASE WHEN prop IN ({_F}) THEN arg_min(value, ord) ELSE arg_max(value, ord) END AS value FROM boxed WHERE value <> '' GROUP BY page_id, selector, prop)"
_EL = "els AS (SELECT page_id, e.* FROM pages, (VALUES " + ", ".join(f"({i}, '{t}', {repr(c) if c else 'NULL'}, {repr(x) if x else 'NULL'})" for i, (t, c, x) in enumerate(ELEMENTS)) + ") e(el, tag, class, id))"


def _decls(s, d):
    return parse_style_rules(_sheets(s, d))


def _styles(s, d):
    return cascade(expand_box_shorthand(_decls(s, d)))


REGISTERED = {
    "parse_style_rules": (_decls, f"{_D} SELECT * FROM decls"),
    "expand_box_shorthand": (lambda s, d: expand_box_shorthand(_decls(s, d)), f"{_D}{_X} SELECT * FROM boxed"),
    "cascade": (_styles, f"{_D}{_C} SELECT * FROM styles"),
    "select_columns_by_level": (lambda s, d: select_by_level(_styles(s, d), 4), f"{_D}{_C} SELECT * FROM styles WHERE prop IN (" + ", ".join(f"'{p}'" for p in PLAIN + FONTS + MARGINS) + ") AND NOT (value = '0' AND prop <> 'text-align' AND prop IN (" + _F + "))"),
    "valid_selectors": (lambda s, d: valid_selectors(_decls(s, d)), rf"""{_D} SELECT DISTINCT selector, regexp_matches(selector, '^[-./0-9A-Za-z ,=_"<>\[\]]+$') AND NOT regexp_matches(selector, '[. ,][-./0-9]') AND regexp_matches(selector, '^[^\[\]]*(\[[^\[\]]*\][^\[\]]*)*$') AND length(regexp_replace(selector, '[^"]', '', 'g')) % 2 = 0 AS valid FROM decls"""),
    "style_flag_docs": (lambda s, d: style_flags(_styles(s, d)), f"{_D}{_C}, f AS (SELECT page_id, selector, CASE WHEN prop = 'direction' AND value = 'rtl' THEN 'rtl' WHEN prop = 'font-weight' AND value IN ('bold', 'bolder', '700') THEN 'bold' WHEN prop = 'font-style' AND value IN ('italic', 'oblique') THEN 'italic' WHEN prop = 'text-decoration' AND value = 'underline' THEN 'underline' END AS flag FROM styles) SELECT page_id, flag, count(DISTINCT selector) AS selectors FROM f WHERE flag IS NOT NULL GROUP BY ALL"),
    "apply_styles": (lambda s, d: apply_styles(_elements(s, d), _decls(s, d).where("value <> ''")), f"{_D}, {_EL}, h AS (SELECT page_id, el, tag AS selector, 1 AS w FROM els UNION ALL SELECT page_id, el, '.' || class, 10 FROM els WHERE class IS NOT NULL UNION ALL SELECT page_id, el, '#' || id, 100 FROM els WHERE id IS NOT NULL) SELECT page_id, el, prop, arg_max(value, w * 1000000 + ord) AS value FROM h JOIN decls USING (page_id, selector) WHERE value <> '' GROUP BY page_id, el, prop"),
}
