"""Documents of known formats as whole files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FORMAT_ALIASES, FORMATS
from ..functions.text import extension_of

#: What turns a file's bytes into text and back, by canonical extension.
Adapter = tuple[Callable[[Column], Column], Callable[[Column], Column]]
UTF8: Adapter = (lambda content: F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")), lambda text: F.encode(text, "UTF-8"))
_ADAPTERS: dict[str, Adapter] = {}


def canonical(extension: str) -> str:
    """An extension in lower case with its dot, aliases resolved."""
    plain = "." + extension.lower().lstrip(".")
    return FORMAT_ALIASES.get(plain, plain)


def register_adapter(extension: str, adapter: Adapter) -> None:
    _ADAPTERS[canonical(extension)] = adapter


def get_adapter(extension: str) -> Adapter:
    return _ADAPTERS[canonical(extension)]


for _extension in FORMATS:
    register_adapter(_extension, UTF8)


def format_of(path: Column, strict: bool = True) -> Column:
    """The canonical extension of a path; an error for a format that isn't known, null if not ``strict``."""
    extension = extension_of(path)
    out = F.raise_error(F.concat(F.lit("unknown format: "), path)).cast("string") if strict else F.lit(None).cast("string")
    for known in FORMATS:
        out = F.when(extension == known, canonical(known)).otherwise(out)
    return out


def read_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """path, fmt, content and text of all files under ``folder`` in a known format, whole and unchanged.

    text is null where the bytes aren't in the format's encoding. With ``strict`` an unknown format is an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").withColumn("fmt", format_of(F.col("path"), strict)).where("fmt is not null")
    text = F.lit(None).cast("string")
    for extension, (read, _) in _ADAPTERS.items():
        text = F.when(F.col("fmt") == extension, read(F.col("content"))).otherwise(text)
    return rows.select("path", "fmt", "content", text.alias("text"))


def bytes_of(text: Column, fmt: Column) -> Column:
    out = F.lit(None).cast("binary")
    for extension, (_, write) in _ADAPTERS.items():
        out = F.when(fmt == extension, write(text)).otherwise(out)
    return out


def same_bytes(files: DataFrame) -> DataFrame:
    """path and whether writing what was read gives the bytes back."""
    return files.select("path", F.coalesce(bytes_of(F.col("text"), F.col("fmt")) == F.col("content"), F.lit(False)).alias("same"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes one file for each row of name and content below ``folder``, on a file system that all tasks have mounted; gives their number.

    A file is written beside its place and then moved, so a task that runs again leaves it whole. Names that
    leave the folder are an error, and so is a folder of another file system: tasks would write to a local folder of that name.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"not on a mounted file system: {folder}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid
        from pathlib import Path

        root = Path(folder.removeprefix("file://")).resolve()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = (root / name).resolve()
                if not to.is_relative_to(root):
                    raise ValueError(f"not below the folder: {name}")
                to.parent.mkdir(parents=True, exist_ok=True)
                part = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
                part.write_bytes(content or b"")
                os.replace(part, to)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return int(rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)
