"""Transcript files: one JSON object a file, with a list of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcripts as O
from ..plans.scratch import written

CHUNK = "array<struct<text: string, start: double, end: double, start_hms: string, end_hms: string, speaker: string>>"
FILE = f"video_id string, channel_name string, title string, chunks {CHUNK}, _broken string"


def read_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """A row for each readable file under ``folder``: path, video_id, channel_name, title and chunks.

    Broken files fall away. A video without id has its file's name; of several files of a video the first by
    path counts. Defaults stand in for what is missing. ``limit`` takes the first files by path, before any is read.
    """
    source: str | list[str] = folder
    reader = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if limit is not None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path").orderBy("path").limit(limit)
        source = [r.path for r in names.collect()]  # `limit` names
        if not source:
            return spark.createDataFrame([], f"path string, video_id string, channel_name string, title string, chunks {CHUNK}")
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = reader.load(source, format="json").select(path.alias("path"), F.when(F.col("video_id") != "", F.col("video_id")).otherwise(stem).alias("video_id"), F.coalesce("channel_name", F.lit("unknown")).alias("channel_name"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("chunks", F.array().cast(CHUNK)).alias("chunks"), "_broken")
    rows = rows.where("_broken is null").drop("_broken")
    # chosen by two small columns: chunks aren't shuffled for it
    first = rows.groupBy("video_id").agg(F.min("path").alias("path"))
    return rows.join(first, ["video_id", "path"], "left_semi").select("path", "video_id", "channel_name", "title", "chunks")


def raw_texts(files: DataFrame) -> DataFrame:
    """video_id, chunk_id and text as stored of all chunks."""
    return files.select("video_id", F.posexplode("chunks").alias("chunk_id", "c")).select("video_id", "chunk_id", F.col("c.text").alias("text"))


def chunk_rows(files: DataFrame) -> DataFrame:
    """video_id, chunk_id, text as stored and meta of all chunks."""
    rows = files.select("video_id", "channel_name", "title", F.posexplode("chunks").alias("chunk_id", "c"))
    meta = F.struct("video_id", "channel_name", "title", "chunk_id", "c.start", "c.end", "c.start_hms", "c.end_hms", F.coalesce("c.speaker", F.lit("unknown")).alias("speaker"))
    return rows.select("video_id", "chunk_id", F.coalesce("c.text", F.lit("")).alias("text"), meta.alias("meta"))


def scan(spark: SparkSession, folder: str, stats: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """video_id, chunk_id, text (without repeats and overlaps) and meta of all chunks, without videos that ``stats`` has."""
    rows = written(chunk_rows(read_files(spark, folder, limit)), "chunk_rows")  # parsed once
    if stats is not None:
        rows = O.unprocessed(rows, stats)
    return with_meta(rows, O.cleaned(rows))


def with_meta(rows: DataFrame, clean: DataFrame) -> DataFrame:
    """``clean`` chunks with the meta of their rows."""
    meta = rows.groupBy("video_id", F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.min("meta").alias("meta"))
    return clean.join(meta, ["video_id", "chunk_id"]).select("video_id", F.col("chunk_id").cast("int").alias("chunk_id"), "text", "meta")
