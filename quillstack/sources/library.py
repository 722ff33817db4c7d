"""Schemas of the library tables (as DDL), and vectors as an index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transcripts import upserted

_WORD = "id string, tier int, surface string, lemma string, frequency int, pos_tag string, role string, epa_e double, epa_p double, epa_a double, stage string, vector_id int, created_at timestamp"
_PHRASE = "id string, tier int, canonical_form string, surface_forms string, token_count int, frequency int, pragmatic_fn string, pragmatic_sub string, stance string, inference string, epa_e double, epa_p double, epa_a double, stage string, vector_id int, created_at timestamp"
SCHEMAS = {
    "corpus_stats": "video_id string, channel_name string, chunk_count int, token_count int, processed_at timestamp",
    "word_library": _WORD,
    "phrase_library": _PHRASE,
    "id_registry": "id string, type string, tier int, created_at timestamp",
}
KEYS = {"corpus_stats": "video_id", "word_library": "id", "phrase_library": "id", "id_registry": "id"}
TIMES = {"corpus_stats": "processed_at", "word_library": "created_at", "phrase_library": "created_at", "id_registry": "created_at"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def merged(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """The library table with ``new`` rows put in: one row for each key, the latest. New rows without a time have the time of now."""
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    now = F.current_timestamp()
    stamped = new.withColumn(TIMES[name], F.coalesce(TIMES[name], now)) if TIMES[name] in new.columns else new.withColumn(TIMES[name], now)
    return upserted(old.select(columns), stamped.select(columns), KEYS[name], TIMES[name])


def write_index(vectors: DataFrame, path: str) -> None:
    """vec_id and embedding as the index that exact search reads."""
    vectors.select("vec_id", "embedding").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
