"""Problem 6: encoding with a byte-level BPE vocabulary as a streaming transducer.

Text goes through two stages. The first cuts it into pre-tokens and needs two characters of lookahead;
the second turns a pre-token's bytes into ids. Every text goes through both, whatever its length. How many bytes can still change the tokens before them
follows from the merge list alone (`lookahead`), so of a long pre-token everything further from the
end of the buffer is emitted at once, and memory stays constant however long a text or a run in it is.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import table

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Characters taken in at once, bytes of a pre-token encoded at once, pre-tokens remembered.
PIECE, WINDOW, REMEMBERED = 1 << 16, 4096, 1 << 19


#: White space of Unicode, as in the public pattern. Fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _class(kind: str, most: int) -> str:
    """The body of a class of all characters up to ``most`` whose Unicode category begins with ``kind``."""
    flags = np.array([0, *(unicodedata.category(chr(c))[0] == kind for c in range(most + 1)), 0], np.int8)
    edges = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in edges.tolist())


@lru_cache
def pre_token_pattern(most: int) -> re.Pattern[str]:
    """The public split pattern of these vocabularies for Python's ``re``, for texts of characters up to ``most``.

    A class within the first plane is one table lookup, which makes the pattern for such texts faster.
    """
    letter, number = _class("L", most), _class("N", most)
    # what starts with an apostrophe matches no other part, so the commonest kind may be tried first
    return re.compile(rf" ?[{letter}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]++| ?[^{_SPACE}{letter}{number}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def pre_tokens(text: str) -> list[str]:
    return pre_token_pattern(sys.maxunicode if _BEYOND.search(text) else 0xFFFF).findall(text)


def read_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary kept as ranks; a token's id is the priority of its merge."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which no further byte can change where the tokens before them end.

    Whether a token is drawn to the right depends on its right neighbour being formed, which depends on
    merges of higher priority further right, and so on: a chain along which priorities rise. Taken in
    order of priority, each merge reaches as far as its right part plus the furthest reach of an earlier
    merge whose left part ends that right part. The greatest reach of all is enough. Any split of a
    token into two tokens counts as a way to merge it, which can only overstate the reach.
    """
    reach: dict[bytes, int] = {}
    for token in sorted(ranks, key=ranks.__getitem__):
        found = []
        for k in range(1, len(token)):
            left, right = token[:k], token[k:]
            if left in ranks and right in ranks:
                found.append((left, len(right) + max((reach.get(right[j:], 0) for j in range(len(right))), default=0)))
        for left, far in found:
            reach[left] = max(reach.get(left, 0), far)
    return max(reach.values(), default=0)


class Encoder(dict):
    """Encodes texts; as a dict it remembers the ids of short pre-tokens, a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int], ahead: int) -> None:
        super().__init__()
        self.ranks, self.ahead = ranks, ahead

    def __missing__(self, token: str) -> tuple[int, ...]:
        data = token.encode()
        ids = tuple(self._stream([data]))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(data) <= 64:
            self[token] = ids
        return ids

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes that stand alone: the neighbours with the best merge are joined until none is left."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 64:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            best = min(costs)
            if best == 1 << 60:
                break
            k = costs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 60)
            if k < len(costs):
                costs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap of candidates over a linked list: n log n steps."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            k = end[i]
            if k >= n or k < 0 or end[k] != stop:  # a part has changed since
                continue
            end[i], end[k] = stop, -1
            if stop < n:
                before[stop] = i
            for a, b in ((before[i], stop), (i, end[stop] if stop < n else 0)):
                if a >= 0 and b > 0 and (r := ranks.get(data[a:b])) is not None:
                    heappush(heap, (r, a, b))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in pieces; those further than the lookahead from its end so far are final."""
        held, sizes = b"", self._sizes()
        for piece in pieces:
            for k in range(0, len(piece), WINDOW):
                held += piece[k : k + WINDOW]
                if len(held) < self.ahead + WINDOW:
                    continue
                done = 0
                for token in self.merged(held):
                    if done + sizes[token] > len(held) - self.ahead:
                        break
                    done += sizes[token]
                    yield token
                held = held[done:]
        if held:
            yield from self.merged(held)

    def _sizes(self) -> list[int]:
        if not hasattr(self, "sizes"):
            self.sizes = [0] * (max(self.ranks.values()) + 1)
            for token, k in self.ranks.items():
                self.sizes[k] = len(token)
        return self.sizes

    def _runs(self, text: Iterable[str], piece: int) -> Iterator[tuple[list[str], bool]]:
        """Whole pre-tokens, some at once; or with True a part of a very long one, which goes on with the first of what comes next."""
        held = ""
        for more in text:
            held += more
            found = pre_tokens(held)
            # an apostrophe may need two further characters, all else one
            k, at = len(found), len(held)
            while k and at + 2 > len(held):
                k -= 1
                at -= len(found[k])
            if k:
                yield found[:k], False
            held = held[at:]
            if len(held) > piece:
                yield [held[:-2]], True
                held = held[-2:]
        if held:
            yield pre_tokens(held), False

    def emitted(self, text: Iterable[str], piece: int = PIECE) -> Iterator[tuple[int, ...]]:
        """Ids of a text that comes in pieces, a tuple for each pre-token or less, in memory that doesn't grow with it."""
        runs = self._runs(text, piece)
        for tokens, more in runs:
            if not more:
                yield from map(self.__getitem__, tokens)
                continue
            rest: list[str] = []

            def parts(first: str = tokens[0], rest: list[str] = rest) -> Iterator[bytes]:
                yield first.encode()
                for own, again in runs:
                    yield own[0].encode()
                    if not again:
                        rest += own[1:]
                        return

            yield from ((k,) for k in self._stream(parts()))
            yield from map(self.__getitem__, rest)

    def stream(self, text: Iterable[str], piece: int = PIECE) -> Iterator[int]:
        return chain.from_iterable(self.emitted(text, piece))

    def tokens(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids of a text by pre-token. Every text goes through the transducer, PIECE characters at a time."""
        return self.emitted(text[i : i + PIECE] for i in range(0, len(text or ""), PIECE))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.tokens(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.tokens(text)))


def decoded(ids: Iterable[int], tokens: list[bytes]) -> Iterator[str]:
    """Text of ids, piece by piece: a state machine keeps the bytes of a character not yet complete."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for k in ids:
        yield machine.decode(tokens[k])
    yield machine.decode(b"", True)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str = TOKENIZERS, ahead: int | None = None) -> Encoder:
    """The encoder of a vocabulary, made once in each process."""
    if (name, folder) not in _ENCODERS:
        ranks = read_ranks(name, folder)
        _ENCODERS[name, folder] = Encoder(ranks, lookahead(ranks) if ahead is None else ahead)
    return _ENCODERS[name, folder]


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array of int) of each row; a narrow pass.

    Null and empty texts have no ids. Strings that look like special tokens are ordinary text. Rows are
    kept as they come; columns other than doc_id and text are not read.
    """
    ahead = encoder(name, folder).ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder, ahead)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 512):
                flat: list[int] = []
                ends = [0]
                for text in texts.slice(k, 512).to_pylist():
                    flat += chain.from_iterable(own.tokens(text))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(k, 512), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded_texts(rows: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and text of each row of doc_id and ids; no ids and null give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [t for t, _ in sorted(read_ranks(name, folder).items(), key=lambda x: x[1])]
        for batch in batches:
            texts = ["".join(decoded(x or [], tokens)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _library(name: str, folder: str):
    """A function from a list of texts to their token counts, for vocabularies that aren't byte-level ranks."""
    if Path(folder, f"{name}.model").exists():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, f"{name}.model")))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(Path(folder, f"{name}.json")))
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, name: str, folder: str = TOKENIZERS, ahead: int | None = None) -> DataFrame:
    """All columns of ``documents`` but its text, and n_tokens (long): its length in tokens, 0 for null."""
    ranked = Path(folder, f"{name}.tiktoken").exists()
    if ranked:
        ahead = encoder(name, folder).ahead

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        if ranked:
            own = encoder(name, folder, ahead)
            return texts.map(own.count)
        return pd.Series(_library(name, folder)([t or "" for t in texts]))

    return documents.withColumn("n_tokens", n_tokens("text")).drop("text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents", "doc_id", "text"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text encoded and decoded again."""
    return decoded_texts(encoded(table(spark, folder, "documents", "doc_id", "text")))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
SQL = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
