"""The token rule for batches in Python, for operators that go through a text step by step."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np


def _body(test, most: int) -> str:
    flags = np.array([0, *(test(chr(c)) for c in range(most + 1)), 0], np.int8)
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in np.flatnonzero(np.diff(flags)).reshape(-1, 2).tolist())


def _patterns(letter: str, digit: str, space: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    any_ = f"[{letter}{digit}]"
    token = rf"{any_}++(?:(?:[._](?={any_})|(?<=[{letter}])'(?=[{letter}])){any_}++)*+|[{space}]++|."
    return re.compile(token, re.S), re.compile(rf"(?:(?<={any_}) (?={any_}))?+({token})", re.S)


_ASCII = _patterns("A-Za-z", "0-9", r"\t-\r\x1c-\x20")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(2)
def _wide(most: int) -> tuple[re.Pattern[str], re.Pattern[str]]:
    return _patterns(*(_body(test, most) for test in (str.isalpha, str.isdigit, str.isspace)))


def _of(text: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The patterns for a text: classes within ASCII or the first plane are faster than those of all characters."""
    return _ASCII if text.isascii() else _wide(sys.maxunicode if _BEYOND.search(text) else 0xFFFF)


def is_word(token: str) -> bool:
    return token[:1].isalpha() or token[:1].isdigit()


def tokens(text: str) -> list[str]:
    """The tokens of a text; joined together they are the text."""
    return _of(text)[0].findall(text)


def units(text: str) -> list[str]:
    """The tokens without the single spaces that stand between two words."""
    return _of(text)[1].findall(text)
