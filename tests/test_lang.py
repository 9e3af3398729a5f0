"""Hyphenation patterns and suffix rules of any length, and the scripts told apart, on small tables."""

from folio.operators import lang


def test_long_hyphenation_patterns(spark):
    words = spark.createDataFrame([("interest",), ("abcdefghijklmn",), ("short",)], "word string")
    rules = [
        (".interes", [0, 0, 0, 0, 0, 1, 0, 0, 0]),  # 8 characters with the edge mark: inte-rest
        ("nterest", [0, 0, 3, 0, 0, 0, 0, 0]),  # 7: int-erest
        ("cdefghijk", [0, 0, 0, 1, 0, 2, 0, 0, 0, 0]),  # 9: abcde-fgh...
        ("gh", [0, 1, 0]),  # a shorter pattern's break that the long one forbids
    ]
    out = lang.hyphenate(words, spark.createDataFrame(rules, "txt string, digits array<int>"))
    assert sorted(map(tuple, out.collect())) == [("abcdefghijklmn", 5), ("interest", 3), ("interest", 4)]
    assert lang.hyphenate(words, spark.createDataFrame([], "txt string, digits array<int>")).count() == 0


def test_long_suffixes(spark):
    words = spark.createDataFrame([("internationalization",), ("nation",), ("ization",), ("x",)], "word string")
    rules = spark.createDataFrame([("ization", 1), ("ation", 2), ("nationalization", 3), ("tion", 4)], "suffix string, value int")
    got = sorted(map(tuple, lang.suffix_lookup(words, rules).collect()))
    assert got == [("internationalization", "nationalization", 3), ("ization", "ization", 1), ("nation", "ation", 2)]
    assert lang.suffix_lookup(words, rules.where("false")).count() == 0


def test_every_script_is_counted(spark):
    texts = {"rtl": "שלום", "cjk": "日本", "devanagari": "हिन्दी", "bengali": "বাংলা", "gujarati": "ગુજરાતી", "oriya": "ଓଡ଼ିଆ", "tamil": "தமிழ்", "telugu": "తెలుగు", "kannada": "ಕನ್ನಡ", "malayalam": "മലയാളം", "latin_accents": "é"}
    docs = spark.createDataFrame([*texts.items(), ("plain", "abc")], "source string, text string")
    got = {(r["source"], r["script"]): r["docs"] for r in lang.script_census(docs).collect()}
    assert {k for k, n in got.items() if n and None not in k} == {(s, s) for s in texts}
    assert {s: got[None, s] for s in texts} == dict.fromkeys(texts, 1) and got[None, None] == len(texts)
