"""Which letters of a word are upper case, as characters of six bits each; columns, and the same in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BASE64, OOV


def _chars(word: Column) -> Column:
    return F.when(F.length(word) > 0, F.split(word, "")).otherwise(F.array().cast("array<string>"))


def title_like(word: Column) -> Column:
    """Whether a word is an upper-case letter and a rest in lower case, and comes back from that."""
    low = F.lower(word)
    return word.rlike(r"^\p{Lu}") & (word == F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30)))


def all_upper(word: Column) -> Column:
    """Whether a word is upper-case letters alone, and comes back from that (reversed, since upper(lower(x)) would be simplified to upper(x))."""
    return word.rlike(r"^\p{Lu}+$") & (F.reverse(word) == F.upper(F.reverse(F.lower(word))))


def comes_back(word: Column) -> Column:
    """Whether a word is what its lower case and its caps give."""
    same = lambda c: (c == F.lower(c)) | (c.rlike(r"^\p{Lu}") & (c == F.upper(F.reverse(F.lower(c)))))
    return (word == F.lower(word)) | title_like(word) | all_upper(word) | ((F.length(word) == F.length(F.lower(word))) & F.forall(_chars(word), same))


def encoded_caps(word: Column) -> Column:
    """"A" for a word that is lower case; else a bit for each character (1: upper case), first bit highest, padded to whole sixes.

    Most other words are like a title or all upper case; only the rest are gone through letter by letter.
    """
    size = F.length(word)
    bits = F.rpad(F.array_join(F.transform(_chars(word), lambda c: F.when(c.rlike(r"^\p{Lu}"), "1").otherwise("0")), ""), (F.ceil(size / 6) * 6).cast("int"), F.lit("0"))
    sixes = F.transform(F.sequence(F.lit(0), F.ceil(size / 6).cast("int") - 1), lambda k: F.substring(F.lit(BASE64), F.conv(F.substring(bits, k * 6 + 1, F.lit(6)), 2, 10).cast("int") + 1, F.lit(1)))
    title = F.rpad(F.lit("g"), F.ceil(size / 6).cast("int"), F.lit("A"))
    ones = F.concat(F.repeat(F.lit("_"), F.floor(size / 6).cast("int")), F.substring(F.lit("gw48-"), (size % 6).cast("int"), F.when(size % 6 > 0, 1).otherwise(0)))
    return F.when(word == F.lower(word), "A").when(title_like(word), title).when(all_upper(word), ones).otherwise(F.array_join(sixes, ""))


def decoded_caps(lower: Column, caps: Column) -> Column:
    """The word of a lower-cased one and its caps; caps of "A" alone leave it as it is."""
    bit = lambda i: F.substring(F.lpad(F.conv((F.position(F.substring(caps, F.floor(i / 6).cast("int") + 1, F.lit(1)), F.lit(BASE64)) - 1).cast("string"), 10, 2), 6, "0"), (i % 6 + 1).cast("int"), F.lit(1))
    return F.when(caps.rlike("^A*$"), lower).otherwise(F.array_join(F.transform(_chars(lower), lambda c, i: F.when(bit(i) == "1", F.upper(c)).otherwise(c)), ""))


def encoded_oov(word: Column) -> Column:
    return F.concat(F.lit(f"{OOV}:"), encoded_caps(word), F.lit(":"), F.lower(word))


def decoded_oov(token: Column) -> Column:
    """The word of an out-of-vocabulary token; an error for any other token."""
    part = F.split(token, ":", 3)
    fine = token.startswith(f"{OOV}:") & (F.size(part) == 3)
    return F.when(fine, decoded_caps(F.get(part, 2), F.get(part, 1))).otherwise(F.raise_error(F.concat(F.lit("not an out-of-vocabulary token: "), token)))


# The same rules for batches in Python.


def caps_of(word: str) -> tuple[str, str]:
    """Lower-cased word and caps."""
    lower = word.lower()
    if word == lower:
        return lower, "A"
    bits = "".join("1" if c.isupper() else "0" for c in word)
    return lower, "".join(BASE64[int(bits[k : k + 6].ljust(6, "0"), 2)] for k in range(0, len(bits), 6))


def word_of(lower: str, caps: str) -> str:
    if not caps.strip("A"):
        return lower
    bits = "".join(f"{BASE64.index(c):06b}" for c in caps)
    return "".join(c.upper() if k < len(bits) and bits[k] == "1" else c for k, c in enumerate(lower))
