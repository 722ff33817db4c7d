"""Lossless splitting of text into tokens, as Spark columns.

A token is a run of white space, a word, or one other character; joined together the tokens are the text.
A word is letters and digits, with single dots and underscores between two of them and apostrophes
between two letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes, as bodies that both Java and RE2 take ---
LETTER = r"\p{L}"
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}"
    r"\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}"
    r"\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_ANY = f"[{LETTER}{DIGIT}]"
#: Possessive throughout: a token of any length takes no stack.
_WORD = rf"{_ANY}++(?:(?:[._](?={_ANY})|(?<=[{LETTER}])'(?=[{LETTER}])){_ANY}++)*+"
TOKEN = rf"(?s){_WORD}|[{SPACE}]++|."
_UNIT = rf"(?s)(?:(?<={_ANY}) (?={_ANY}))?+({TOKEN.removeprefix('(?s)')})"
#: The same without looking around, for RE2.
TOKEN_RE2 = rf"(?s:(?:[{DIGIT}]|[{LETTER}](?:'[{LETTER}])*)(?:[._]?(?:[{DIGIT}]|[{LETTER}](?:'[{LETTER}])*))*|[{SPACE}]+|.)"
WORD, BLANK, MARK = "word", "whitespace", "punct"


def tokens(text: Column | str) -> Column:
    """The tokens of a text as an array; null for null, empty for empty."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(f"^{_ANY}")


def is_blank(token: Column) -> Column:
    return token.rlike(f"^[{SPACE}]")


def token_class(token: Column) -> Column:
    """word, whitespace, punct or, for the empty token, empty: the class of the first character."""
    return F.when(token == "", "empty").when(is_word(token), WORD).when(is_blank(token), BLANK).otherwise(MARK)


def key_of(token: Column) -> Column:
    """A token's dictionary key."""
    return F.lower(token)


def words(text: Column | str) -> Column:
    """The words of a text, lower-cased. No other token has a letter or digit, so a scan for words alone finds the same ones."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def split_words(text: Column | str) -> Column:
    """What stands between white space, never empty."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


def units(text: Column | str) -> Column:
    """The tokens of a text without the single spaces that stand between two words.

    Such a space has a letter or digit on either side, so the pattern passes it over in the same scan.
    """
    return F.regexp_extract_all(text, F.lit(_UNIT), F.lit(1))


def spaced(units_: Column) -> Column:
    """The text of units, a space put between neighbours that are both words."""
    before = F.concat(F.array(F.lit("")), units_)
    parts = F.zip_with(units_, before, lambda t, b: F.when(t.isNull(), "").when(is_word(t) & is_word(b), F.concat(F.lit(" "), t)).otherwise(t))
    return F.array_join(parts, "")


def displayed(token: Column) -> Column:
    """A token as reports show it."""
    return F.when(token == " ", "<SPACE>").when(token == "\n", "<NEWLINE>").when(token == "\t", "<TAB>").otherwise(token)


def extension_of(path: Column) -> Column:
    """The lower-cased extension of a path with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
