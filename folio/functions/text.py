"""Column functions on text, all of them native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as a space besides U+0020.
SPACES = "".join(map(chr, (0x0009, 0x00A0, 0x180E, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF)))


def norm_spaces(c: Column) -> Column:
    return F.translate(c, SPACES, " " * len(SPACES))


def fold(c: Column) -> Column:
    """The form in which texts and queries are compared."""
    return F.lower(norm_spaces(c))


#: Ranges of capitals and how far away their small letters are (ASCII, Latin-1, Cyrillic, Greek, Armenian, Georgian).
CAPITALS = ((0x41, 0x5A, 32), (0xC0, 0xDF, 32), (0x401, 0x401, 80), (0x410, 0x42F, 32), (0x390, 0x3AF, 32), (0x531, 0x556, 48), (0x10A0, 0x10C5, 48), (0x10C7, 0x10C7, 48), (0x10CD, 0x10CD, 48))
#: Ranges of polytonic Greek whose capitals have the bit of value 8.
POLYTONIC = ((0x1F00, 0x1F6F), (0x1F80, 0x1FEF))


def _compat() -> tuple[str, str]:
    table = {x: x + away for first, last, away in CAPITALS for x in range(first, last + 1)}
    table |= {x: x & ~8 for first, last in POLYTONIC for x in range(first, last + 1) if x & 8}
    return "".join(map(chr, table)), "".join(map(chr, table.values()))


COMPAT = _compat()


def fold_compat(c: Column) -> Column:
    """Small letters by ranges of code points alone: the form of older indexes, in which letters outside the ranges stay."""
    return F.translate(c, *COMPAT)


def quoted(c: Column) -> Column:
    """A regular expression that matches the literal text of the column."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def literal_pos(c: Column, q: Column, start: int = 0) -> Column:
    """Offset of the first occurrence at or behind start in code points, -1 if there is none."""
    return F.call_function("locate", q, c, F.lit(start + 1)) - 1


def split_trim(c: Column, delim: str, trim: bool = True) -> Column:
    """Pieces between delim (a regular expression), runs of spaces as one; with trim without spaces around them, and without empty ones."""
    if not trim:
        return F.transform(F.split(c, delim, -1), lambda x: F.regexp_replace(x, " +", " "))
    return F.filter(F.transform(F.split(c, delim, -1), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


def decode_entities(c: Column) -> Column:
    """Numeric and named entities; &amp; comes last, so that its result isn't decoded again."""
    # a numeric entity stands between pieces: its digits are read as a number, its code point written out
    pieces = F.split(c, "(?=&#)|(?<=;)", -1)
    dec, hexa = (lambda x: F.regexp_extract(x, "&#([0-9]{1,7});$", 1)), (lambda x: F.regexp_extract(x, "&#[xX]([0-9a-fA-F]{1,6});$", 1))
    code = lambda x: F.coalesce(F.nullif(dec(x), F.lit("")).cast("int"), F.conv(F.nullif(hexa(x), F.lit("")), 16, 10).cast("int"))
    valid = lambda x: F.coalesce(code(x).between(1, 0x10FFFF) & ~code(x).between(0xD800, 0xDFFF), F.lit(False))
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")
    c = F.array_join(F.transform(pieces, lambda x: F.when(valid(x), F.concat(F.substring_index(x, "&#", 1), char(x))).otherwise(x)), "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def natural_key(c: Column) -> Column:
    """Sort key: case ignored, digit runs of any length by value, spaces and leading zeros ignored."""
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(c, " ", "")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    # the number of digits first, so that a longer number comes later
    by_value = lambda x: F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), by_value(x)).otherwise(x)), "")


#: The strong right-to-left code points (letters of Hebrew, Arabic and their neighbours).
RTL = r"\x{5BE}\x{5C0}\x{5C3}\x{5D0}-\x{5F4}\x{608}\x{61B}-\x{64A}\x{66D}-\x{66F}\x{671}-\x{6D5}\x{6FA}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFE}"
#: A run from one of them to before the next letter of another kind, or what lies between such runs.
RTL_RUNS = rf"[{RTL}](?:[^\p{{L}}]|[{RTL}])*|[^{RTL}]+"
#: The same as one class of characters: a group repeated takes a frame of the stack for each character, so that long lines overflow it.
_RTL_RUNS = rf"[{RTL}][{RTL}[^\p{{L}}]]*+|[^{RTL}]++"


def rtl_runs(c: Column) -> Column:
    """Text in drawing order as text in reading order: each maximal right-to-left run reversed, signs and digits inside it too."""
    runs = F.regexp_extract_all(c, F.lit(_RTL_RUNS), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(f"^[{RTL}]"), F.reverse(x)).otherwise(x)), "")


def truncate_meta(c: Column, most: int = 2000) -> Column:
    return F.when(F.is_valid_utf8(c), F.left(c, F.lit(most))).otherwise("")


def strip_bracketed_number(c: Column) -> Column:
    """12 for '[12]' or '12', else null: whether a link's text is the number of a note."""
    return F.nullif(F.regexp_extract(c, r"^\s*\[?\s*(\d+)\s*\]?\s*$", 1), F.lit("")).try_cast("int")


#: Code points that count as punctuation.
PUNCT = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA6, 0x60C, 0x60D, 0x60E, 0x60F, 0x61F, 0x66D, 0x6DD, 0x6DE, 0x6E9, 0xFD3E, 0xFD3F, 0x621)))


def count_chars(c: Column, chars: str) -> Column:
    """How many code points of c are among chars."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


#: The vowel signs of Devanagari and Bengali that are drawn before their consonant, and the consonants.
PRE_BASE = "([\u093F\u09BF\u09C7\u09C8])([\u0904-\u0939\u0985-\u09B9])"


def reorder_indic(c: Column) -> Column:
    """The vowel sign that is drawn before its consonant but typed behind it, put back behind it."""
    return F.regexp_replace(c, PRE_BASE, "$2$1")
