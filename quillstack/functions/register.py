"""The scalar functions under names of their own in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scanner
from .caps import caps_of, word_of


def register(spark: SparkSession, dictionary: DataFrame | None = None) -> None:
    """sc_tokenize(text), sc_encode_caps(word) and sc_decode_caps(lower, caps); with a dictionary sc_encode(text, fmt) and sc_decode(stream)."""

    @F.pandas_udf("array<string>")
    def tokenize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else scanner.tokens(t))

    @F.pandas_udf("string")
    def encode_caps(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else caps_of(w)[1])

    @F.pandas_udf("string")
    def decode_caps(lower: pd.Series, caps: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else word_of(a, b) for a, b in zip(lower, caps, strict=True)])

    for name, function in (("sc_tokenize", tokenize), ("sc_encode_caps", encode_caps), ("sc_decode_caps", decode_caps)):
        spark.udf.register(name, function)
    if dictionary is None:
        return
    from ..operators.codec import _codec, _sent

    sent = _sent(dictionary)
    if sent is None:
        raise ValueError("the dictionary is too large to be sent to all tasks")

    @F.pandas_udf("string")
    def encode(texts: pd.Series, formats: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _codec(sent).encode(t, f, False)[0] for t, f in zip(texts, formats, strict=True)])

    @F.pandas_udf("string")
    def decode(streams: pd.Series) -> pd.Series:
        return streams.map(lambda s: None if s is None else _codec(sent).decode_text(s)[1])

    spark.udf.register("sc_encode", encode)
    spark.udf.register("sc_decode", decode)
