"""Transcripts and documents as streams of files; the checkpoint remembers what has been read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.transcripts import MOST, split_chunks, without_overlap
from ..sources.transcripts import CHUNK, FILE


def file_stream(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    """Transcript files (*.json) as they come: path, video_id (of a file without one its name) and chunks; each file is read once."""
    reader = spark.readStream.schema(FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_each)
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = reader.json(folder).select(path.alias("path"), F.when(F.col("video_id") != "", F.col("video_id")).otherwise(stem).alias("video_id"), F.coalesce("chunks", F.array().cast(CHUNK)).alias("chunks"), "_broken")
    return rows.where("_broken is null").drop("_broken")


def chunk_stream(files: DataFrame) -> DataFrame:
    return files.select("path", "video_id", F.posexplode("chunks").alias("chunk_id", "c")).select("path", "video_id", "chunk_id", F.col("c.text").alias("text"))


def token_counts(texts: DataFrame) -> DataFrame:
    """Running counts of tokens; for output modes complete and update."""
    return texts.select(F.explode(T.tokens("text")).alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("freq"))


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones within ``delay`` included; for output mode append."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def _border(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, state_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    before, path = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
    rows = pd.concat(list(batches)).sort_values("chunk_id")
    # of several files of a video the first that comes counts; of those that come together the first by path
    path = path if path is not None else rows.path.min()
    rows = rows[rows.path == path]
    out = []
    for chunk, words in zip(rows.chunk_id, rows.words, strict=True):
        kept = without_overlap(before, list(words))
        if kept:
            out.append((key[0], chunk, " ".join(kept), len(kept)))
        before = kept[-MOST:]
    state.update((before, path))
    if state_ms:
        state.setTimeoutDuration(state_ms)
    yield pd.DataFrame(out, columns=["video_id", "chunk_id", "text", "n_words"])


def cleaned_stream(chunks: DataFrame, state_ms: int | None = None) -> DataFrame:
    """Chunks (path, video_id, chunk_id, text) without repeats and overlaps as they come: a video's state is its file and the last 60 words kept.

    The chunks of a file must come in order from trigger to trigger; within one they are sorted. Another file of a video
    counts for nothing. With ``state_ms`` a video's state ends so long after its last chunk came: for queries that run on, since
    one that is to end with the files there are waits for it.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if state_ms else GroupStateTimeout.NoTimeout
    border = partial(_border, state_ms=state_ms)
    return split_chunks(chunks, "path").groupBy("video_id").applyInPandasWithState(border, "video_id string, chunk_id long, text string, n_words long", "words array<string>, path string", "append", timeout)
