"""Words of a text, and their integer codes for whole batches at once."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.entities import decoded_sql

#: Maximal runs of characters of the Unicode categories L and N (what Python calls alphanumeric).
WORD = re.compile(r"[^\W_]+")
_NUMBER_LINE = re.compile(r"^[^\S\n]*[0-9]+[^\S\n]*$", re.M)
_CUE_LINE = re.compile(r"^[^\n]*-->[^\n]*$", re.M)


def content_of(text: str | None) -> str:
    """The text with entities decoded, lower-cased, without number lines and cue lines; "" for null.

    Lines end at a line feed. A number line holds only the digits 0-9 and blanks at its ends, a cue
    line holds ``-->``.
    """
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    text = _NUMBER_LINE.sub("", text)
    if "-->" in text:
        text = _CUE_LINE.sub("", text)
    return text.lower()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(content_of(text))


def word_blocks(texts: list[str | None], most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Blocks of whole texts: first and end index, word counts, codes of all words, distinct words.

    A block ends once it has ``most`` words, so memory is bounded by that and the longest text.
    """
    words: list[str] = []
    lens: list[int] = []
    first = 0
    for k, text in enumerate(texts):
        own = words_of(text)
        words += own
        lens.append(len(own))
        if len(words) >= most or k == len(texts) - 1:
            coded = pa.array(words, pa.string()).dictionary_encode()
            yield first, k + 1, np.array(lens, np.int64), coded.indices.to_numpy(), coded.dictionary
            words, lens, first = [], [], k + 1


#: White space as Python's ``\s`` has it, without the line feed. Fixed values.
_BLANK = r"[\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words_sql(source: str, key: str, name: str) -> str:
    """CTEs that end in ``name`` (``key``, w: the words of the text as `words_of` gives them) over a table of ``key`` and text."""
    lines = f"regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^{_BLANK}*[0-9]+{_BLANK}*$', '', 'g'), '(?m)^[^\\n]*-->[^\\n]*$', '', 'g')"
    return f"""{decoded_sql(source, key, f"{name}_text")},
  {name} as (select {key}, regexp_extract_all(lower(replace({lines}, 'İ', 'i̇')), '[\\p{{L}}\\p{{N}}]+') as w from {name}_text)"""
