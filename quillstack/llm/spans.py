"""Problem 4: long spans that stand letter for letter in several documents.

Level-wise doubling. Of each text a few windows of LEVELS[0] characters are chosen by content, so that
every stretch of ``span`` characters has at least one, at the same place wherever it stands. Windows
that stand in one text alone fall away; around the others the windows of twice the length are chosen,
and so on. At the last level before ``span`` a window's history (the stretch from the window chosen
before it) tells where a shared span can begin: only where the histories of equal windows differ. There
every window of ``span`` characters is hashed; two texts with an equal one share a span, and a pair is
given only where the characters before differ, so once for each span and not once for each position.

Exact copies are one text until the end. What is shuffled is one position in some hundred, and the
texts that still have shared windows; no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import table, written
from .windows import Hashed, chosen, code_points

SPAN = 400
_BLOCK = 250_000


def levels(span: int) -> list[int]:
    """Window lengths, each twice the one before, the last of them half of ``span``."""
    return [span // 8, span // 4, span // 2]


def _segments(text: str, marks: np.ndarray | None, before: int, after: int, least: int) -> list[tuple[int, np.ndarray]]:
    """Start and code points of the parts of ``text`` around its marks; overlapping parts are one."""
    codes = code_points(text)
    if marks is None:
        return [(0, codes)] if len(codes) >= least else []
    first = np.maximum(np.sort(marks) - before, 0)
    end = np.minimum(np.sort(marks) + after, len(codes))
    new = np.r_[True, first[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]
    return [(a, codes[a:b]) for a, b in zip(first[new].tolist(), end[last].tolist(), strict=True) if b - a >= least]


@dataclass
class _Block:
    """Code points of many segments end to end. Of each position: its segment. Of each segment: its text's id and
    hash, its end in the block, and what a position in the block has to be shifted by for its place in the text."""

    codes: np.ndarray
    segment: np.ndarray
    ids: np.ndarray
    tags: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    shift: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], before: int, after: int, least: int) -> Iterator[_Block]:
    """A batch has ids, texts and, but for whole texts, marks."""
    ids: list[int] = []
    tags: list[int] = []
    starts: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> _Block:
        lens = np.array([len(p) for p in parts])
        ends = lens.cumsum()
        return _Block(np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), lens), np.array(ids, np.int64), np.array(tags, np.uint64).view(np.int64), ends, ends - lens, np.array(starts) - (ends - lens))

    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        marks = batch.column(2) if batch.num_columns > 2 else None
        for k, doc in enumerate(docs):
            text = texts[k].as_py()
            if text is None or doc is None:
                continue
            own = None if marks is None else np.asarray(marks[k].values)
            tag = xxhash.xxh64_intdigest(text) if marks is None else 0
            for start, codes in _segments(text, own, before, after, least):
                ids.append(doc)
                tags.append(tag)
                starts.append(start)
                parts.append(codes)
                size += len(codes)
            if size >= _BLOCK:
                yield flush()
                ids, tags, starts, parts, size = [], [], [], [], 0
    if parts:
        yield flush()


def _choose(width: int, span: int, before: int, extra: str):
    """h, doc_id and pos of the chosen windows, and as ``extra`` the hash of their text (tag), or (past) those of the
    stretches to the windows chosen before and after, one of its own where there is none, and the place of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, before, span, span):
            hashed = Hashed(block.codes)
            h = hashed.all(width)
            ends = block.ends[block.segment]
            at = chosen(h, ends, width, span)
            at = at[at + width <= ends[at]]
            segment = block.segment[at]
            pos = at + block.shift[segment]
            columns = {"h": h[at].view(np.int64), "doc_id": block.ids[segment], "pos": pos.astype(np.int32)}
            if extra == "tag":
                columns["tag"] = block.tags[segment]
            if extra == "past":
                n = len(at)
                own = (block.ids[segment].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ pos.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                inner = np.r_[segment[1:] == segment[:-1], False] if n else np.zeros(0, bool)
                after = np.where(inner, np.r_[at[1:], 0][:n], at)
                before_ = np.where(np.r_[False, inner[:-1]][:n], np.r_[0, at[:-1]][:n], at)
                columns["past"] = np.where(before_ < at, hashed.at(before_, at + width), own).view(np.int64)
                columns["next"] = np.where(after > at, hashed.at(at, after + width), own).view(np.int64)
                columns["prev_pos"] = (pos - (at - before_)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return run


def _every(width: int, before: int, after: int):
    """Two hashes, doc_id, pos and the character before, of every window of ``width`` around the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, before, after, width):
            h1, h2 = Hashed(block.codes).all(width), Hashed(block.codes, 1).all(width)
            at = np.arange(len(h1))
            segment = block.segment[: len(at)]
            # a segment begins one character early, so that each window but a text's first has one before it
            first = block.first[segment]
            at = at[(at + width <= block.ends[segment]) & ((at > first) | (block.shift[segment] == -first))]
            segment = block.segment[at]
            pos = (at + block.shift[segment]).astype(np.int32)
            prev = np.where(pos == 0, np.int32(-1), block.codes[np.maximum(at - 1, 0)].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"h1": pa.array(h1[at].view(np.int64)), "h2": pa.array(h2[at].view(np.int64)), "doc_id": pa.array(block.ids[segment]), "pos": pa.array(pos), "prev": pa.array(prev)})

    return run


def _marks(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and the positions of its rows with one of the keys; an array is as long as its text at most."""
    return rows.join(keys.select("h"), "h").groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))


class _Shared:
    """Texts of a table that may share spans: one row for each distinct text, with what has survived."""

    def __init__(self, documents: DataFrame, span: int) -> None:
        if span < 64:
            raise ValueError("spans under 64 characters are not supported")
        small, middle, large = levels(span)
        self.span, self.half = span, large
        long = documents.select("doc_id", "text").where(F.length("text") >= span)
        # copies: doc_id and the smallest doc_id with the same text, of texts that stand more than once
        keyed = written(long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")), "texts")
        many = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
        self.copies = written(keyed.join(many, "key").select("doc_id", "rep"), "copies")
        others = self.copies.where("doc_id != rep").select("doc_id")

        # windows of the first level, of all texts; copies agree in their tag and so don't count as others
        rows = written(long.mapInArrow(_choose(small, span, 0, "tag"), "h long, doc_id long, pos int, tag long"), "windows")
        keys = rows.groupBy("h").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a != b")
        marks = _marks(rows, keys).join(others, "doc_id", "left_anti")
        active = written(long.join(marks, "doc_id"), "active")

        rows = written(active.mapInArrow(_choose(middle, span, span - small, ""), "h long, doc_id long, pos int"), "windows")
        keys = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b")
        active = written(active.drop("marks").join(_marks(rows, keys), "doc_id"), "active")

        rows = written(active.mapInArrow(_choose(large, span, span - middle, "past"), "h long, doc_id long, pos int, past long, next long, prev_pos int"), "windows")
        keys = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), *[f(c).alias(f"{c}_{k}") for c in ("past", "next") for k, f in enumerate((F.min, F.max))]).where("a != b")
        self.active, self.rows, self.keys = active.drop("marks"), rows, written(keys, "keys")

    def begins(self) -> DataFrame:
        """Texts with the windows where a span may begin: their histories differ."""
        return self.active.join(_marks(self.rows, self.keys.where("past_0 != past_1")), "doc_id")

    def borders(self) -> DataFrame:
        """doc_id, pos, prev_pos of all shared windows, and whether all texts agree on what is to either side of it."""
        agree = (F.col("past_0") == F.col("past_1")) & (F.col("next_0") == F.col("next_1"))
        return self.rows.select("h", "doc_id", "pos", "prev_pos").join(self.keys.select("h", agree.alias("agree")), "h").drop("h")


_WINDOW = "h1 long, h2 long, doc_id long, pos int, prev int"
#: Members of a group that are set against each other in one piece.
GROUP = 1000


def _paired(members: DataFrame, keys: DataFrame, key: list[str], value: str, also: str | None = None) -> DataFrame:
    """x and y, the ``value`` of any two members of a group (rows with the same ``key``), in either order; ``also`` must hold of them.

    ``keys`` has the groups' sizes as n. A group of more than GROUP members is cut into parts by hash and each pair of
    parts is a piece of its own, so no task has more than GROUP squared pairs of a group however large it is.
    """
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    rows = members.join(keys.select(*key, "n"), key).withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64(value), F.col("_parts")).cast("int"))
    others = [c for c in members.columns if c not in (*key, value)]
    side = lambda name, own, pieces: rows.select(*key, F.col(value).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in others], F.col("_part").alias(own), F.explode(pieces).alias("j" if own == "i" else "i"))
    left = side("x", "i", F.sequence(F.col("_part"), F.col("_parts") - 1))
    right = side("y", "j", F.sequence(F.lit(0), F.col("_part")))
    pairs = left.join(right, [*key, "i", "j"]).where("x != y and (i < j or x < y)")
    return (pairs.where(also) if also else pairs).select("x", "y")


def _near(shared: _Shared) -> tuple[DataFrame, DataFrame]:
    """Windows of the span's length at which shared spans begin, and the groups of equal ones with their sizes (n)."""
    span = shared.span
    rows = written(shared.begins().mapInArrow(_every(span, span - shared.half + 1, span), _WINDOW), "starts")
    keys = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("prev").alias("c"), F.max("prev").alias("d"), F.count("*").alias("n")).where("a != b and (c != d or c = -1)").select("h1", "h2", "n")
    return rows, written(keys, "groups")


def _rep_pairs(shared: _Shared) -> DataFrame:
    """x and y of the distinct texts that share a span, once each."""
    rows, keys = _near(shared)
    pairs = _paired(rows.select("h1", "h2", "doc_id", "prev"), keys, ["h1", "h2"], "doc_id", "prev_x != prev_y or prev_x = -1")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def shared_pairs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id_a < doc_id_b of documents whose texts share ``span`` characters or more, each pair once.

    Characters are code points as stored. Null texts and texts under ``span`` characters share nothing;
    copies are paired with each other and with all that share with one of them. Ids must be unique.
    """
    shared = _Shared(documents, span)
    sizes = written(shared.copies.groupBy("rep").agg(F.count("*").alias("n")), "sizes")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    cut = shared.copies.join(sizes, "rep").select("rep", "doc_id", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))

    def copied(pairs: DataFrame, side: str) -> DataFrame:
        """Pairs with each copy on one side; the copies of a text come in parts, each with its pairs."""
        many = pairs.join(sizes.select(F.col("rep").alias(side), parts.alias("parts")), side, "left")
        rows = many.select("x", "y", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        return rows.join(cut.withColumnRenamed("rep", side), [side, "part"], "left").withColumn(side, F.coalesce("doc_id", side)).select("x", "y")

    wide = copied(copied(_rep_pairs(shared), "x"), "y")
    same = _paired(shared.copies, sizes, ["rep"], "doc_id")
    return wide.unionByName(same).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_links(documents: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """doc_id_a < doc_id_b of distinct texts (each by the least doc_id with it) that share a span, and doc_id, rep of all copies.

    All pairs follow from the two: documents share a span if they, or those they are copies of, are one or a pair.
    """
    shared = _Shared(documents, span)
    return _rep_pairs(shared).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b")), shared.copies


def shared_classes(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """class_id and doc_id: two documents share a span if and only if they are in some class together.

    A class is all that have one window of ``span`` characters at which a shared span begins, or all copies of one text, so
    rows follow the members and not their pairs. It is named by the least doc_id that has it (of copies the least one) and
    the window's place there, from 0; copies of a text are a class at -1.
    """
    shared = _Shared(documents, span)
    rows, keys = _near(shared)
    near = rows.select("h1", "h2", "doc_id", "pos").join(keys.select("h1", "h2"), ["h1", "h2"])
    name = near.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("c")).select("h1", "h2", F.concat_ws(":", "c.doc_id", "c.pos").alias("class_id"))
    own = near.select("h1", "h2", "doc_id").distinct().join(name, ["h1", "h2"]).select("class_id", F.col("doc_id").alias("rep"))
    wide = own.join(shared.copies, "rep", "left").select("class_id", F.coalesce("doc_id", "rep").alias("doc_id"))
    return wide.unionByName(shared.copies.select(F.concat_ws(":", "rep", F.lit(-1)).alias("class_id"), "doc_id"))


def _stretches(span: int, half: int):
    """Start and length of the stretches of a text that lie in shared spans, from its shared windows and the hashed places that stand elsewhere too.

    Near a window on whose surroundings texts disagree all places were hashed. Any other place up to a window is
    shared by all texts with that window: they agree on everything from the window before to the one after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, lengths = [], [], []
            for doc, windows, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = max(w["pos"] for w in windows) + 1
                hashed, whole = np.zeros(size, bool), np.zeros(size, bool)
                for w in windows:
                    if w["agree"]:
                        whole[w["prev_pos"] + 1 : w["pos"] + 1] = True
                    else:
                        hashed[max(0, w["pos"] - half) : w["pos"] + 1] = True
                whole &= ~hashed
                found = np.array(places or [], np.int64)
                found = found[found < size]
                whole[found[hashed[found]]] = True
                at = np.flatnonzero(whole)
                first = np.flatnonzero(np.diff(at, prepend=-span - 2) > span)
                last = np.r_[first[1:], len(at)] - 1 if len(at) else first
                docs += [doc] * len(first)
                starts += at[first].tolist()
                lengths += (at[last] + span - at[first]).tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})

    return run


def shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, start (from 0) and length of each stretch of a document that lies in spans of ``span`` or more that stand elsewhere too.

    Spans that touch or overlap are one stretch. A text with a copy is shared as a whole. Only places near the
    borders of shared stretches are hashed, so rows follow the number of stretches and not their length.
    """
    shared = _Shared(documents, span)
    borders = written(shared.borders(), "borders")
    marks = borders.where("not agree").groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    rows = written(shared.active.join(marks, "doc_id").mapInArrow(_every(span, span - shared.half + 1, span), _WINDOW).drop("prev"), "starts")
    keys = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("h1", "h2")
    places = rows.join(keys, ["h1", "h2"]).groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    windows = borders.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "prev_pos", "agree")).alias("windows"))
    own = windows.join(places, "doc_id", "left").select("doc_id", "windows", "places").mapInArrow(_stretches(span, shared.half), "doc_id long, start long, length long")
    whole = documents.select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("length")).join(shared.copies.select("doc_id"), "doc_id")
    return own.join(shared.copies.select("doc_id"), "doc_id", "left_anti").unionByName(whole)


def shared_lengths(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars and shared_chars: characters that lie in a span of ``span`` or more that stands elsewhere too.

    One row for each document with such a span.
    """
    sums = shared_spans(documents, span).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"))
    return documents.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(sums, "doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(table(spark, folder, "documents", "doc_id", "text"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document that shares a span, how much of it stands elsewhere too."""
    return shared_lengths(table(spark, folder, "documents", "doc_id", "text"))


def p4_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where in each document what stands elsewhere begins, and its length."""
    return shared_spans(table(spark, folder, "documents", "doc_id", "text"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each class of documents that share a span, from which all pairs follow."""
    return shared_classes(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares, "p4_spans": p4_spans, "p4_classes": p4_classes}
_WINDOWS = f"""
  with spans as (select doc_id, k, hash(substr(text, k, {SPAN})) as h from (select doc_id, text, unnest(range(1, length(text) - {SPAN - 2})) as k from documents where length(text) >= {SPAN})),
  shared as (select h from (select distinct doc_id, h from spans) group by h having count(*) > 1),
  few as (select spans.* from spans join shared using (h))
"""
_CLASSES = f"""
  with texts as (select text, min(doc_id) as rep, count(*) as n from documents where length(text) >= {SPAN} group by text),
  spans as (select rep, k, hash(substr(text, k, {SPAN})) as h, substr(text, k - 1, cast(k > 1 as int)) as prev from (select rep, text, unnest(range(1, length(text) - {SPAN - 2})) as k from texts)),
  classes as (select h, arg_min(rep || ':' || (k - 1), {{'rep': rep, 'k': k}}) as class_id from spans group by h having min(rep) <> max(rep) and (min(prev) <> max(prev) or min(prev) = '')),
  own as (select distinct class_id, rep from classes join spans using (h)),
  members as (select rep, doc_id, n from texts join documents using (text))
"""
SQL = {
    "p4_found": f"{_WINDOWS}, once as (select distinct doc_id, h from few) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from once a join once b on a.h = b.h and a.doc_id < b.doc_id",
    "p4_shares": f"{_WINDOWS}, parts as (select doc_id, least({SPAN}, coalesce(lead(k) over (partition by doc_id order by k) - k, {SPAN})) as n from few) select doc_id, length(any_value(text)) as n_chars, cast(sum(n) as bigint) as shared_chars from parts join documents using (doc_id) group by doc_id",
    "p4_spans": f"{_WINDOWS}, steps as (select doc_id, k, coalesce(k - lag(k) over w > {SPAN}, true) as new from few window w as (partition by doc_id order by k)), parts as (select doc_id, k, sum(cast(new as int)) over (partition by doc_id order by k) as part from steps) select doc_id, min(k) - 1 as start, max(k) - min(k) + {SPAN} as length from parts group by doc_id, part",
    "p4_classes": f"{_CLASSES} select class_id, doc_id from own join members using (rep) union all select rep || ':-1', doc_id from members where n > 1",
}
