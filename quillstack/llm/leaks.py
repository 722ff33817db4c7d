"""Problem 5: passages of evaluation texts inside a training corpus, by a positional inverted index.

The index is stored in segments, each over whole documents: its terms in order, and for each the
increasing positions at which it stands, as delta-coded bytes with a place of their own. A segment is a
row, so searching is a narrow pass, and of a segment only the lists asked for are decoded. A phrase is
looked up from its rarest term: that term's positions, moved by its offset in the phrase, are where the
phrase may begin; the lists of the other terms, rarest first and moved by their offsets, are intersected
with them. Items are cut into words by the tasks and set against the index in groups of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import new_path, table, written
from .words import word_blocks, words_of, words_sql

PHRASE = 12
#: Words of a segment (it ends after the document that reaches them) and bytes of query words sent to all tasks at once.
SEGMENT_WORDS, QUERY_BYTES = 200_000, 4 << 20
_INDEX = "n_words long, doc_ids array<long>, ends array<int>, terms array<string>, counts array<int>, places array<int>, postings binary"
#: Postings looked at closely at once.
_BLOCK = 1_000_000
_NEAR_ROWS = 10_000


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each number takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 6):
        size += values >= 1 << (7 * k)
    return size


def packed(values: np.ndarray) -> bytes:
    """Variable-length bytes of numbers from 0: seven bits each, the highest bit set on all but the last."""
    size = _sizes(values)
    values = values.astype(np.uint64)
    ends = size.cumsum()
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        part = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[ends[has] - size[has] + k] = part | np.where(size[has] - 1 > k, np.uint8(128), np.uint8(0))
    return out.tobytes()


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        has = last - first >= k
        out[has] |= (raw[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("postings", pa.binary())])
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for first, end, lens, codes, terms in word_blocks(batch.column(1).to_pylist(), SEGMENT_WORDS):
            words = terms.to_pylist()
            rank = np.empty(len(words), np.int64)
            order = sorted(range(len(words)), key=words.__getitem__)
            rank[order] = np.arange(len(words))
            ranks = rank[codes]
            at = np.argsort(ranks, kind="stable")
            counts = np.bincount(ranks, minlength=len(words))
            deltas = np.diff(at, prepend=0)
            heads = counts.cumsum() - counts
            deltas[heads] = at[heads]  # each list begins anew
            places = np.r_[0, _sizes(deltas).cumsum()][heads]  # the byte at which each list begins
            yield pa.RecordBatch.from_pylist([{"n_words": int(lens.sum()), "doc_ids": docs[first:end], "ends": lens.cumsum().tolist(), "terms": [words[k] for k in order], "counts": counts.tolist(), "places": places.tolist(), "postings": packed(deltas)}], schema)


def build_index(documents: DataFrame, path: str) -> None:
    """Writes the index of doc_id and text to ``path``: no shuffle, some half of the text's size on disk.

    Null and wordless texts have no postings.
    """
    documents.select("doc_id", "text").mapInArrow(_index, _INDEX).write.parquet(path)


class Segment:
    """Postings of one segment. A list is decoded when it is first asked for; ``keys`` has the decoded ones as term * n + position, in order."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        of = lambda name: batch.column(name)[row]
        self.n = of("n_words").as_py()
        self.ids, self.ends = np.asarray(of("doc_ids").values), np.asarray(of("ends").values).astype(np.int64)
        self.terms, self.counts = of("terms").values, np.asarray(of("counts").values).astype(np.int64)
        self.bytes = np.frombuffer(of("postings").as_buffer(), np.uint8)
        self.places = np.r_[np.asarray(of("places").values).astype(np.int64), len(self.bytes)]
        self.keys, self.known = np.zeros(0, np.int64), np.zeros(len(self.counts), bool)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The number of each word among the segment's terms, -1 where it has none."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def decode(self, terms: np.ndarray) -> None:
        """Makes the lists of ``terms`` known."""
        new = np.unique(terms)
        new = new[~self.known[new]]
        if not len(new):
            return
        size = self.places[new + 1] - self.places[new]
        deltas = unpacked(self.bytes[_ranges(self.places[new], size)])
        counts = self.counts[new]
        sums = deltas.cumsum()
        heads = counts.cumsum() - counts
        positions = sums - np.repeat((sums - deltas)[heads], counts)
        self.keys = np.sort(np.concatenate([self.keys, np.repeat(new, counts) * self.n + positions]), kind="stable")
        self.known[new] = True

    def _places_of(self, sets: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``sets`` (term codes) and the positions of each one's rarest term, in bounded parts."""
        rare = sets[np.arange(len(sets)), order[:, 0]]
        self.decode(rare)
        sizes = self.counts[rare]
        first = np.searchsorted(self.keys, rare * self.n)
        for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(sizes.cumsum() // _BLOCK)) + 1):
            row = np.repeat(part, sizes[part])
            yield row, self.keys[_ranges(first[part], sizes[part])] - rare[row] * self.n

    def phrases(self, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``phrases`` (term codes, one width) and positions at which they begin, in bounded parts."""
        fine = np.flatnonzero((phrases >= 0).all(1))
        if not len(fine):
            return
        phrases, width = phrases[fine], phrases.shape[1]
        order = np.argsort(self.counts[phrases], axis=1, kind="stable")
        for row, at in self._places_of(phrases, order):
            start = at - order[row, 0]
            fits = (start >= 0) & (start + width <= self.n)
            row, start = row[fits], start[fits]
            for k in range(1, width):
                offset = order[row, k]
                term = phrases[row, offset]
                self.decode(term)
                key = term * self.n + start + offset
                keep = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                row, start = row[keep], start[keep]
                if not len(row):
                    break
            doc = np.searchsorted(self.ends, start, "right")
            keep = start + width <= self.ends[doc] if len(doc) else doc.astype(bool)
            yield fine[row[keep]], start[keep]

    def near(self, sets: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``sets`` (distinct term codes, one width) and positions in a document that has them near, in bounded parts.

        Near: all within ``reach`` words of one occurrence of one of them. The term rarest here only says where to look.
        """
        fine = np.flatnonzero((sets >= 0).all(1))
        if not len(fine):
            return
        sets = sets[fine]
        order = np.argsort(self.counts[sets], axis=1, kind="stable")
        sets = np.take_along_axis(sets, order, 1)
        for row, at in self._places_of(sets, np.zeros_like(order)):
            doc = np.searchsorted(self.ends, at, "right")
            low = np.maximum(at - 2 * reach, np.where(doc > 0, self.ends[doc - 1], 0))
            high = np.minimum(at + 2 * reach, self.ends[doc] - 1)
            for k in range(1, sets.shape[1]):
                self.decode(sets[row, k])
                keep = self._stands(sets[row, k], low, high)
                row, at, low, high = row[keep], at[keep], low[keep], high[keep]
                if not len(row):
                    break
            for k in range(0, len(row), _NEAR_ROWS):
                some = slice(k, k + _NEAR_ROWS)
                found = self._together(sets[row[some]], at[some], low[some], high[some], reach)
                yield fine[row[some][found]], at[some][found]

    def _stands(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands somewhere from ``low`` to ``high``."""
        first = np.searchsorted(self.keys, term * self.n + low)
        return (first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] <= term * self.n + high)

    def _together(self, sets: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
        """Whether some occurrence of a term within ``reach`` of ``at`` has all of its set within ``reach``, between ``low`` and ``high``."""
        out = np.zeros(len(at), bool)
        for k in range(sets.shape[1]):
            term = sets[:, k] * self.n
            first = np.searchsorted(self.keys, term + np.maximum(at - reach, low))
            size = np.searchsorted(self.keys, term + np.minimum(at + reach, high), "right") - first
            row = np.repeat(np.arange(len(at)), size)
            anchor = self.keys[_ranges(first, size)] - term[row]
            every = np.ones(len(row), bool)
            for j in range(sets.shape[1]):
                every &= self._stands(sets[row, j], np.maximum(anchor - reach, low[row]), np.minimum(anchor + reach, high[row]))
            out[row[every]] = True
        return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first``, ``size`` of them, end to end."""
    return np.repeat(first - (size.cumsum() - size), size) + np.arange(size.sum())


class Queries:
    """Words of a group of items end to end, and what is looked for: distinct rows of word codes, each with the items that have it and where."""

    def __init__(self, rows: pa.Table) -> None:
        lists = rows.column("words").combine_chunks()
        coded = lists.values.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.items = rows.column("item_id").to_numpy()
        self.lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = self.lens.cumsum() - self.lens

    def _put(self, rows: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        width = rows.shape[1]
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * width))).ravel()
        _, some, which = np.unique(whole, return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        self.rows, self.item, self.place = rows[some].astype(np.int64), item[by], place[by]
        self.first = np.searchsorted(which[by], np.arange(len(some) + 1))

    def phrases(self, width: int) -> None:
        """Each run of ``width`` words of an item."""
        own = np.maximum(self.lens - width + 1, 0)
        at = _ranges(self.starts, own)
        item = np.repeat(np.arange(len(own)), own)
        self._put(self.codes[at[:, None] + np.arange(width)], item, at - self.starts[item])

    def runs(self, terms: int) -> None:
        """The distinct words of each shortest run of an item that has ``terms`` of them, in order of their codes."""
        pairs: dict[tuple, None] = {}
        for k, (start, size) in enumerate(zip(self.starts.tolist(), self.lens.tolist(), strict=True)):
            seen: dict[int, None] = {}  # words of the run that ends here, the one seen longest ago first
            for w in self.codes[start : start + size].tolist():
                seen.pop(w, None)
                seen[w] = None
                if len(seen) > terms:
                    del seen[next(iter(seen))]
                if len(seen) == terms:
                    pairs[k, *sorted(seen)] = None
        every = np.array(list(pairs), np.int32).reshape(-1, terms + 1)
        self._put(every[:, 1:], every[:, 0].astype(np.int64), np.zeros(len(every), np.int64))

    def found(self, segment: Segment, look: Callable) -> pd.DataFrame:
        """document (its number in the segment), item and place in the item, and start in the document, of all that is found."""
        out = []
        if len(self.rows):
            here = segment.codes(self.words)
            for row, start in look(segment, here[self.rows]):
                size = self.first[row + 1] - self.first[row]
                at = _ranges(self.first[row], size)
                doc = np.searchsorted(segment.ends, start, "right")
                begin = start - np.where(doc > 0, segment.ends[doc - 1], 0)
                out.append(pd.DataFrame({"doc": np.repeat(doc, size), "item": self.item[at], "place": self.place[at], "start": np.repeat(begin, size)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "place", "start")})


def _item_groups(items: DataFrame, most: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """Number of groups, and item_id and words of each: all items, in groups of some ``most`` bytes of words (or one item). One group at a time is on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array([sum(map(len, w)) + 4 * len(w) for w in words], pa.int64())], ["item_id", "words", "size"])

    cut = written(items.select("item_id", "text").where("item_id is not null and text is not null").mapInArrow(run, "item_id long, words array<string>, size long").where("size > 0"), "items")
    total = cut.agg(F.sum("size")).first()[0] or 0
    groups = -(-2 * total // (most or QUERY_BYTES))
    for g in range(groups):
        part = cut if groups == 1 else cut.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = part.select("item_id", "words").toArrow()
        if rows.num_rows:
            yield groups, rows


_FOUND = "doc_id long, item_id long, leaked_words long, item_words long, doc_start long"


def _search(index: DataFrame, items: DataFrame, prepare: Callable[[Queries], None], look: Callable, width: int) -> DataFrame:
    """A row for each document and item of which ``look(segment, rows)`` finds something that ``prepare`` takes from the item's words."""
    spark, parts = index.sparkSession, []
    for groups, rows in _item_groups(items):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            if not hasattr(sent, "queries"):  # made once in each worker
                made = Queries(sent.value)
                prepare(made)
                sent.queries = made
            q = sent.queries
            for batch in batches:
                for k in range(batch.num_rows):
                    segment = Segment(batch, k)
                    got = q.found(segment, look).sort_values(["doc", "item", "place"])
                    once = got.drop_duplicates(["doc", "item", "place"])
                    # words of the item that lie in something found: each place up to the next one, at most ``width``
                    step = np.diff(once.place, append=0)
                    same = (once.doc.diff().shift(-1) == 0) & (once.item.diff().shift(-1) == 0)
                    once = once.assign(n=np.where(same, np.minimum(step, width), width))
                    sums = once.groupby(["doc", "item"], as_index=False).agg(n=("n", "sum"))
                    sums = sums.merge(got.groupby(["doc", "item"], as_index=False).agg(start=("start", "min")))
                    doc, item = sums.doc.to_numpy(np.int64), sums["item"].to_numpy(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(segment.ids[doc]), pa.array(q.items[item]), pa.array(sums.n.to_numpy(np.int64)), pa.array(q.lens[item]), pa.array(sums.start.to_numpy(np.int64))], ["doc_id", "item_id", "leaked_words", "item_words", "doc_start"])

        part = index.mapInArrow(run, _FOUND)
        if groups > 1:  # each is looked for before the next is sent
            part = written(part, "found")
            sent.unpersist()
        parts.append(part)
    out = spark.createDataFrame([], _FOUND)
    for k, part in enumerate(parts):
        out = part if not k else out.unionByName(part)
    # a document or item that is delivered twice is one
    return out.groupBy("doc_id", "item_id").agg(F.max("leaked_words").alias("leaked_words"), F.max("item_words").alias("item_words"), F.min("doc_start").alias("doc_start"))


def phrase_matches(index: DataFrame, items: DataFrame, width: int = PHRASE) -> DataFrame:
    """doc_id and item_id, once each, of which ``width`` consecutive words of the item are consecutive in the document.

    With them leaked_words (words of the item that lie in such runs), item_words (all of its words) and doc_start (the
    first of the document's words, from 0, that is in one). ``items`` has item_id and text. Null texts and items of fewer
    words match nothing.
    """
    return _search(index, items, lambda q: q.phrases(width), lambda segment, rows: segment.phrases(rows), width)


def near_matches(index: DataFrame, items: DataFrame, terms: int = 8, reach: int = 24) -> DataFrame:
    """doc_id and item_id of which the words of a run of the item stand near each other in the document.

    A run is any of the item's with ``terms`` distinct words, as short as can be. Near means all within ``reach`` words
    of one occurrence of one of them, so each pair depends on its document and item alone. Items with fewer distinct
    words match nothing.
    """
    return _search(index, items, lambda q: q.runs(terms), lambda segment, sets: segment.near(sets, reach), 0).select("doc_id", "item_id", "doc_start")


def leaked(documents: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """``matches`` with item_video_id and doc_video_id, without documents of the item's own video."""
    docs = documents.select("doc_id", F.col("video_id").alias("doc_video_id"))
    own = items.select("item_id", F.col("video_id").alias("item_video_id"))
    both = matches.join(own, "item_id").join(docs, "doc_id")
    return both.where(F.coalesce(F.col("doc_video_id") != F.col("item_video_id"), F.lit(True)))


def _matches(spark: SparkSession, folder: str, how) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    path = new_path(spark, "index")
    build_index(documents, path)
    return how(spark.read.schema(_INDEX).parquet(path), table(spark, folder, "eval_items", "item_id", "text"))


def _leaks(spark: SparkSession, folder: str, how) -> DataFrame:
    return leaked(table(spark, folder, "documents", "doc_id", "video_id"), table(spark, folder, "eval_items", "item_id", "video_id"), _matches(spark, folder, how))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, phrase_matches).select("doc_id", "item_id")


def p5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the videos of item and document, the share of the item's words that leaked, and where in the document the first stands."""
    return _leaks(spark, folder, phrase_matches).withColumn("leaked_share", F.round(F.col("leaked_words") / F.col("item_words"), 6))


def p5_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which the words of a run of an item stand near each other, in whatever order."""
    return _leaks(spark, folder, near_matches).select("doc_id", "item_id")


QUERIES = {"p5_found": p5_found, "p5_leaks": p5_leaks, "p5_near": p5_near}
_LEAKS = f"""
  with {words_sql("documents", "doc_id", "doc_words")}, {words_sql("eval_items", "item_id", "item_words")},
  item_grams as (select item_id, k, array_to_string(w[k:k + {PHRASE - 1}], ' ') as g from (select item_id, w, unnest(range(1, len(w) - {PHRASE - 2})) as k from item_words)),
  doc_grams as (select doc_id, k, array_to_string(w[k:k + {PHRASE - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {PHRASE - 2})) as k from doc_words)),
  hits as (select doc_id, item_id, i.k as place, min(d.k) as start from doc_grams d join item_grams i using (g) group by all),
  steps as (select *, least({PHRASE}, coalesce(lead(place) over (partition by doc_id, item_id order by place) - place, {PHRASE})) as n from hits),
  found as (select doc_id, item_id, cast(sum(n) as bigint) as leaked_words, min(start) - 1 as doc_start from steps group by doc_id, item_id),
  leaks as (
    select f.*, i.video_id as item_video_id, d.video_id as doc_video_id, len(w) as item_words, round(leaked_words / len(w)::double, 6) as leaked_share
    from found f join item_words using (item_id) join (select item_id, video_id from eval_items) i using (item_id) join (select doc_id, video_id from documents) d using (doc_id)
    where coalesce(d.video_id <> i.video_id, true))
"""
SQL = {
    "p5_found": f"{_LEAKS} select doc_id, item_id from leaks",
    "p5_leaks": f"{_LEAKS} select doc_id, item_id, item_video_id, doc_video_id, leaked_words, item_words, doc_start, leaked_share from leaks",
}
