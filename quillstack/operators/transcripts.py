"""Removal of what speech recognition repeats: within a chunk, and over the border of two chunks.

Within a chunk is a narrow pass. Over borders each chunk depends on what was left of the one before, all the
way back. That chain is cut: of a chunk only the number of words left (up to 60) matters to the next, so a
chunk is a table from 61 numbers to 61 numbers, a block of chunks is the composition of its tables, and blocks
can be worked on apart. Only one small row for each block is ever gathered by video.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOUNDARY_WORDS, REPEAT_WORDS
from ..plans.scratch import written

#: Positions of a video's chunks in one block.
BLOCK = 512
LEAST, MOST = BOUNDARY_WORDS


def without_repeats(words: list[str]) -> list[str]:
    """Words without immediate repeats: at each place the longest phrase of 2 to 12 words that stands twice or more in a row is kept once."""
    shortest, longest = REPEAT_WORDS
    out: list[str] = []
    at, n = 0, len(words)
    while at < n:
        step, copies = 1, 1
        for size in range(min(longest, (n - at) // 2), shortest - 1, -1):
            if words[at] == words[at + size] and words[at : at + size] == words[at + size : at + 2 * size]:
                step, copies = size, 2
                while words[at + copies * size : at + (copies + 1) * size] == words[at : at + size]:
                    copies += 1
                break
        out += words[at : at + step]
        at += step * copies
    return out


def overlaps(before: list[str], words: list[str]) -> list[int]:
    """All sizes from 4 to 60 for which the end of ``before`` is the beginning of ``words``, the largest first."""
    return [k for k in range(min(len(before), len(words), MOST), LEAST - 1, -1) if before[-k] == words[0] and before[-k:] == words[:k]]


def without_overlap(before: list[str], words: list[str]) -> list[str]:
    """``words`` without the longest beginning, of 4 to 60 words, that is the end of ``before``."""
    return words[next(iter(overlaps(before, words)), 0) :]


def _transitions(before: list[str], words: list[str]) -> np.ndarray:
    """Words left (up to 60) of a chunk, by how many are left of the one before."""
    table = np.full(MOST + 1, len(words))
    for size in reversed(overlaps(before, words)):
        table[size:] = len(words) - size
    return np.minimum(table, MOST)


def split_chunks(chunks: DataFrame, *also: str) -> DataFrame:
    """``chunks`` with words: entities decoded, split at white space, without repeats; and string columns ``also``. Rows without any text fall away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [without_repeats(html.unescape(t).split()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), *batch.columns[3:]], ["video_id", "chunk_id", "words", *also])

    rows = chunks.select("video_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", *also).where(F.col("text").rlike(r"[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"))
    return rows.mapInArrow(run, "video_id string, chunk_id long, words array<string>" + "".join(f", {c} string" for c in also))


def _blocks(words: DataFrame) -> DataFrame:
    """Rows with their block and the last words before it."""
    rows = written(words.withColumn("block", F.floor(F.col("chunk_id") / BLOCK)), "chunks")
    tail = F.slice("words", F.greatest(F.lit(1), F.size("words") - MOST + 1), F.lit(MOST))
    ends = rows.groupBy("video_id", "block").agg(F.max_by(tail, "chunk_id").alias("tail"))
    before = ends.select("video_id", "block", F.coalesce(F.lag("tail").over(Window.partitionBy("video_id").orderBy("block")), F.array().cast("array<string>")).alias("before"))
    return rows.join(before, ["video_id", "block"])


def _lists(rows: pd.DataFrame) -> tuple[list[int], list[list[str]], list[str]]:
    rows = rows.sort_values("chunk_id")
    return rows.chunk_id.tolist(), [list(w) for w in rows.words], list(rows.before.iloc[0])


def _compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    _, words, before = _lists(rows)
    table = np.arange(MOST + 1)
    for own in words:
        table = _transitions(before, own)[table]
        before = own
    return pd.DataFrame({"video_id": [key[0]], "block": [key[1]], "table": [table.tolist()]})


def _starts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    left, out = 0, []
    for row in rows.sort_values("block").itertuples():
        out.append((key[0], row.block, left))
        left = int(row.table[left])
    return pd.DataFrame(out, columns=["video_id", "block", "left"])


def _emit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, words, before = _lists(rows)
    left, out = int(rows.left.iloc[0]), []
    for chunk, own in zip(ids, words, strict=True):
        kept = without_overlap(before[len(before) - left :] if left else [], own)
        out.append((key[0], chunk, " ".join(kept), len(kept)))
        before, left = own, min(len(kept), MOST)
    return pd.DataFrame(out, columns=["video_id", "chunk_id", "text", "n_words"])


def cleaned(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """video_id, chunk_id, text and n_words of chunks (video_id, chunk_id, text) without repeats and overlaps.

    Chunks of a video go by chunk_id. Null and blank texts have no row and don't stand between their neighbours; a chunk of which nothing
    is left has no row, and the next one begins afresh. A chunk delivered twice counts once: the first by the column
    ``order`` (a path or time) if given, and of equal ones that with the least text; rows without video_id or chunk_id have no neighbours and fall away.
    """
    once = chunks.where("video_id is not null and chunk_id is not null").groupBy("video_id", "chunk_id").agg((F.min_by("text", F.struct(order, "text")) if order else F.min("text")).alias("text"))
    rows = written(_blocks(split_chunks(once)), "blocks")
    tables = rows.groupBy("video_id", "block").applyInPandas(_compose, "video_id string, block long, table array<int>")
    starts = tables.groupBy("video_id").applyInPandas(_starts, "video_id string, block long, left int")
    out = rows.join(starts, ["video_id", "block"]).groupBy("video_id", "block").applyInPandas(_emit, "video_id string, chunk_id long, text string, n_words long")
    return out.where("n_words > 0")


def corpus_stats(chunks: DataFrame, clean: DataFrame) -> DataFrame:
    """video_id, channel_name, chunk_count (blank ones too) and token_count of each video."""
    all_ = chunks.where("video_id is not null and chunk_id is not null").groupBy("video_id").agg(F.coalesce(F.min("meta.channel_name"), F.lit("unknown")).alias("channel_name"), F.countDistinct("chunk_id").alias("chunk_count"))
    kept = clean.groupBy("video_id").agg(F.sum("n_words").alias("token_count"))
    return all_.join(kept, "video_id", "left").na.fill(0, ["token_count"])


def unprocessed(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """Chunks of videos that ``stats`` doesn't have."""
    return chunks.join(stats.where("video_id is not null").select("video_id").distinct(), "video_id", "left_anti")


def upserted(stats: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables with one row for each key: the latest by ``order``, of equal ones the new one."""
    both = stats.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"), *[F.desc(c) for c in stats.columns if c not in (key, order)])
    return both.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_new")
