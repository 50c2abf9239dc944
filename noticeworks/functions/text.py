"""Text functions on columns: scripts, folding, markup, whitespace, slugs, escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CYRILLIC = "абвгдђежзијклмнопрстћуфхцчшѓќѕАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШЃЌЅ"
_LATIN = "abvgdđežzijklmnoprstćufhcčšđćzABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠĐĆZ"
_DIGRAPHS = (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž"))
_BLOCKS = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000))


def _marked() -> dict[str, str]:
    """Small letters with marks, and what is left without them: Latin, Greek and Cyrillic ones."""
    out = {}
    for c in (chr(i) for a, b in _BLOCKS for i in range(a, b)):
        apart = unicodedata.normalize("NFD", c)
        if c.lower() == c and len(apart) > 1 and all(unicodedata.combining(x) for x in apart[1:]):
            out[c] = apart[0]
    return out | {"ł": "l", "ħ": "h"}


_LETTERS = _marked()
MARKED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
#: Marks that follow their letter as signs of their own.
MARKS = "".join(chr(i) for i in range(0x300, 0x370))
#: Letters of the region's languages from a letter and such a mark.
_COMPOSED = {unicodedata.normalize("NFD", c): c for c in "čćžšČĆŽŠáéíóúýÁÉÍÓÚÝàèìòùÀÈÌÒÙäëïöüÿÄËÏÖÜâêîôûÂÊÎÔÛãñõÃÑÕąęĄĘřěŘĚůŮőűŐŰńśźŃŚŹżŻțșȚȘåÅйЙ"}


def once(c: Column, build: Callable[[Column], Column]) -> Column:
    """``build(c)`` with ``c`` made once, however often ``build`` names it: as the variable of a lambda."""
    return F.get(F.transform(F.array(c), build), 0)


def _by_pieces(c: Column, signs: str, pieces: str, convert: Callable[[Column], Column]) -> Column:
    """``c`` with its ``pieces`` converted, which together are all of it; a text without any of ``signs`` stays as it is.

    Translating goes by single characters, which takes long on whole texts.
    """
    return once(c, lambda t: F.when(t.rlike(signs), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(pieces), 1), convert), "")).otherwise(t))


def to_latin(c: Column) -> Column:
    """Cyrillic letters as Latin ones; digraphs keep the case of their first letter."""

    def letters(p: Column) -> Column:
        out = p
        for a, b in _DIGRAPHS:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(p.rlike(r"^[\u0400-\u04ff]"), F.translate(out, _CYRILLIC, _LATIN)).otherwise(p)

    return _by_pieces(c, r"[\u0400-\u04ff]", r"([\u0400-\u04ff][\u0400-\u04ff\s\d.,:;()/-]*|[^\u0400-\u04ff]+)", letters)


def fold(c: Column) -> Column:
    """Latin, lower case, without marks; đ becomes d."""
    return fold_latin(to_latin(c))


def fold_latin(c: Column) -> Column:
    """``fold`` of a text that is Latin already."""
    low = F.lower(c)
    for a, b in zip("čćžšđ", "cczsd"):
        low = F.replace(low, F.lit(a), F.lit(b))
    plain = lambda p: F.when(p >= F.lit("\x80"), F.translate(p, MARKED + "đ" + MARKS, PLAIN + "d")).otherwise(p)
    return _by_pieces(low, r"[^\x00-\x7f]", r"([\x00-\x7f]+|[^\x00-\x7f]+)", plain)


def fold_place(c: Column) -> Column:
    """A place name to compare by: without marks (đ stays apart and parts words), other signs as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED + MARKS, PLAIN), r"[^a-z0-9]+", " "))


def decode_entities(c: Column) -> Column:
    """The common named entities and decimal and hexadecimal ones of any character; others stay."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(&#[xX]?[0-9A-Fa-f]{1,7};|[^&]+|&)"), 1)

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#([0-9]+);$", 1)
        hexes = F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(sound, _character(code)).otherwise(p)

    c = F.array_join(F.transform(pieces, one), "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def _character(code: Column) -> Column:
    """A character by its code, through its UTF-16 bytes: two units beyond the basic plane."""
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(1023))
    units = F.when(code > 0xFFFF, F.concat(F.hex(high), F.hex(low))).otherwise(F.lpad(F.hex(code), 4, "0"))
    return F.decode(F.unhex(units), "UTF-16BE")


def composed(c: Column) -> Column:
    """Letters followed by a mark as one letter each; texts without such marks stay as they are."""
    out = c
    for apart, one in _COMPOSED.items():
        out = F.replace(out, F.lit(apart), F.lit(one))
    return F.when(c.rlike("[\u0300-\u036f]"), out).otherwise(c)


def clean_whitespace(c: Column) -> Column:
    """No-break spaces as spaces, long dot leaders as four dots, runs and edges trimmed, two newlines at most."""
    for pattern, to in ((r"[   ]", " "), (r"\.{4,}", "...."), (r"[ \t\f\r]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        c = F.regexp_replace(c, pattern, to)
    return composed(c)


def html_to_text(c: Column) -> Column:
    """Markup to text: comments, style and script go, blocks break lines, cells part by tabs."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in (
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<xml\b[^>]*>.*?</xml>", " "),
        (r"(?is)<style\b[^>]*>.*\z", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(ul|ol|li|table|tr|p|div|h[1-6])>", "\n"),
        (r"(?i)</t[dh]>", "\t"),
        (r"<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return clean_whitespace(decode_entities(c))


def strip_style_noise(c: Column) -> Column:
    """Drops lines that look like style rules: a telling word, or three colons and three semicolons or more."""
    telling = r"(?i)(mso-|font-family|font-size|line-height|@page|margin-(top|left|right|bottom)|\bMsoNormal\b)"
    lines = F.filter(F.split(c, "\n"), lambda x: ~(x.rlike(telling) | ((F.regexp_count(x, F.lit(":")) >= 3) & (F.regexp_count(x, F.lit(";")) >= 3))))
    return F.array_join(lines, "\n")


def slug(c: Column) -> Column:
    """Folded, with single dashes for everything but letters and digits."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def slug_of_title(c: Column, most: int = 60) -> Column:
    """A slug of at most ``most`` characters, cut at its last dash if that lies in the second half."""
    s = slug(F.replace(F.replace(c, F.lit("²"), F.lit("2")), F.lit("³"), F.lit("3")))
    cut = F.substring(s, 1, most)
    dash = F.length(cut) - F.locate("-", F.reverse(cut)) + 1
    at_dash = F.when((F.locate("-", cut) > 0) & (dash > most // 2), F.substring(cut, F.lit(1), dash - 1)).otherwise(cut)
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(at_dash, r"-+\z", ""))


def id_from_slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+-\d+)\z", 1), F.lit("")), c)


def case_of_capitals(c: Column) -> Column:
    """A name all in capitals gets one capital a word, across spaces, hyphens and dots; any other stays."""
    return once(c, _recased)


def _recased(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\s\-–_.]+|[^\s\-–_.]+)"), 1)
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), w.substr(F.lit(2), F.length(w)))), "")
    return F.when(c == F.upper(c), made).otherwise(c)


def title_case(c: Column) -> Column:
    """Every word small with a large first letter, whatever the case before."""
    return F.initcap(F.lower(c))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sentence_case(c: Column) -> Column:
    """The first letter large; a text all in capitals small behind it, short ones (acronyms) as they are."""
    return F.when((c == F.upper(c)) & (F.length(c) > 4), F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c))))


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def tidy(c: Column, most: int = 220) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[,;:\s]+\z", "")), 1, most)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ics_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_octets(c: Column, most: int = 75) -> Column:
    """Calendar lines broken so that none has more than ``most`` octets; a continuation begins with a space."""

    def broken(line: Column) -> Column:
        octets = F.decode(line.cast("binary"), "ISO-8859-1")  # a character for each octet; those from 80 to BF go on with one
        first = lambda o: F.regexp_extract(o, rf"(?s)^.{{0,{most}}}(?![\x80-\xBF])", 0)
        whole = once(octets, lambda o: once(first(o), lambda a: F.concat(a, F.regexp_replace(o.substr(F.length(a) + 1, F.length(o)), rf"(?s).{{1,{most - 1}}}(?![\x80-\xBF])", "\r\n $0"))))
        return F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")

    return once(c, lambda line: F.when(F.octet_length(line) > most, broken(line)).otherwise(line))


def repair_ocr(c: Column) -> Column:
    """Misread tokens of the fixed vocabulary: the currency, hearings, biddings and quotes; never names or figures."""
    for pattern, to in (
        (r"(?<![A-Za-z0-9_])K(?:[lI]v[lI]?|[MNH])(?![A-Za-z0-9_])", "KM"),
        (r"(\d)[., ]00\s*[XK][NM](?![A-Za-z0-9_])", "$1,00 KM"),
        (r"(?<![\p{L}])R(?iu:o[cč]i[sš]t[ea])(?![\p{L}])", "Ročište"),
        (r"(?<![\p{L}])r(?iu:o[cč]i[sš]t[ea])(?![\p{L}])", "ročište"),
        (r"(?<![\p{L}])(?i:nadmetanja)(?![\p{L}])", "nadmetanja"),
        (r"(?<![\p{L}])(?i:nadmetanje)(?![\p{L}])", "nadmetanje"),
        ("[‘’]", "'"),
        ("[“”]", '"'),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c
