"""python -m quillstack COMMAND: the pipeline from transcripts to a dictionary, and files encoded with it.

count TRANSCRIPTS OUT [--limit N] [--raw]       token counts, without repeats of recognised speech unless --raw
ngrams TRANSCRIPTS OUT [--limit N] [--min K] [--nmin A] [--nmax B]
phrases COUNTS OUT NGRAMS... [--absorb R] [--min-pmi P] [--min K] [--report N]
dictionary COUNTS PHRASES OUT [--min K] [--tier1-reserve N] [--keep-tier0-bigrams]
encode DICTIONARY IN [OUT] [--binary] [--stats] a file, or all files of known formats in a folder; OUT is where they lie unless given
decode DICTIONARY IN [OUT] [--binary]           a file has the extension that its header has
verify DICTIONARY IN [--binary]                 whether every file comes back; exit code 1 if one doesn't
bench DICTIONARY IN [--binary] [--out-json OUT] bytes and seconds of each file and in all
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import codec, dictionary, frequency, ngrams, phrases
from .plans.scratch import written
from .sources import formats, tables, transcripts

EXTENSION = {False: ".elo", True: ".eloB"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quillstack", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("count")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--limit", type=int)
    p.add_argument("--raw", action="store_true")
    p = sub.add_parser("ngrams")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--limit", type=int)
    p.add_argument("--min", type=int, default=C.MIN_FREQ)
    p.add_argument("--nmin", type=int, default=C.NGRAMS[0])
    p.add_argument("--nmax", type=int, default=C.NGRAMS[1])
    p = sub.add_parser("phrases")
    p.add_argument("counts")
    p.add_argument("out")
    p.add_argument("ngrams", nargs="+")
    p.add_argument("--absorb", type=float, default=C.ABSORPTION)
    p.add_argument("--min-pmi", type=float, default=0.0)
    p.add_argument("--min", type=int, default=1)
    p.add_argument("--report", type=int, default=0)
    p = sub.add_parser("dictionary")
    p.add_argument("counts")
    p.add_argument("phrases")
    p.add_argument("out")
    p.add_argument("--min", type=int, default=C.MIN_FREQ)
    p.add_argument("--tier1-reserve", type=int, default=C.TIER1_RESERVE)
    p.add_argument("--keep-tier0-bigrams", action="store_true")
    for name in ("encode", "decode", "verify", "bench"):
        p = sub.add_parser(name)
        p.add_argument("dictionary")
        p.add_argument("source")
        if name in ("encode", "decode"):
            p.add_argument("out", nargs="?")
        if name == "bench":
            p.add_argument("--out-json")
        p.add_argument("--binary", action="store_true")
        if name == "encode":
            p.add_argument("--stats", action="store_true")
    return top


def _texts(spark: SparkSession, folder: str, limit: int | None, raw: bool) -> DataFrame:
    if raw:
        return transcripts.raw_texts(transcripts.read_files(spark, folder, limit or None))
    return transcripts.scan(spark, folder, limit=limit).select("video_id", "chunk_id", "text")


def _files(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, name, fmt and text of a file, or of all files of known formats in a folder."""
    root = _root(source)
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    rows = formats.read_files(spark, source).select(F.xxhash64("path").alias("doc_id"), name.alias("name"), "fmt", "content", "text")
    return written(rows, "files")


def _streams(spark: SparkSession, source: str, binary: bool) -> DataFrame:
    root = _root(source)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).where(F.col("path").endswith(EXTENSION[binary]))
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    payload = F.col("content") if binary else F.col("content").cast("string")
    return written(rows.select(F.xxhash64("path").alias("doc_id"), F.regexp_replace(name, r"\.elo[B]?$", "").alias("name"), payload.alias("payload")), "streams")


def _root(source: str) -> str:
    return os.path.abspath(source if os.path.isdir(source) else os.path.dirname(source) or ".")


def _encode(spark: SparkSession, args: argparse.Namespace) -> int:
    files, entries = _files(spark, args.source), tables.read_dictionary(spark, args.dictionary)
    got = written(codec.encoded(files, entries, args.binary), "encoded")
    content = F.col("payload") if args.binary else F.encode("payload", "UTF-8")
    both = got.where("payload is not null").join(files.select("doc_id", "name"), "doc_id")
    n = formats.write_files(both.select(F.concat("name", F.lit(EXTENSION[args.binary])).alias("name"), content.alias("content")), args.out or _root(args.source))
    print(f"{n} files")
    if args.stats:
        got.groupBy("fmt").agg(*[F.sum(c).alias(c) for c in (*codec.STATS, "src_bytes", "enc_bytes")], F.count("error").alias("errors")).show(truncate=False)
    return int(got.where("payload is null").count() > 0)


def _decode(spark: SparkSession, args: argparse.Namespace) -> int:
    streams, entries = _streams(spark, args.source, args.binary), tables.read_dictionary(spark, args.dictionary)
    got = written(codec.decoded(streams, entries, args.binary), "decoded")
    both = got.where("text is not null").join(streams.select("doc_id", "name"), "doc_id")
    name = F.when(F.endswith(F.lower("name"), F.lower("fmt")), F.col("name")).otherwise(F.concat("name", "fmt"))
    print(f"{formats.write_files(both.select(name.alias('name'), F.encode('text', 'UTF-8').alias('content')), args.out or _root(args.source))} files")
    errors = got.where("error is not null")
    errors.select("error").show(truncate=False)
    return int(errors.count() > 0)


def _verify(spark: SparkSession, args: argparse.Namespace) -> int:
    files, entries = _files(spark, args.source), tables.read_dictionary(spark, args.dictionary)
    rows = written(codec.round_trip(files, entries, args.binary).join(files.select("doc_id", "name"), "doc_id").select("name", F.coalesce("same", F.lit(False)).alias("same")), "verified")
    rows.orderBy("same", "name").show(100, truncate=False)
    return int(rows.where("not same").count() > 0)


def _bench(spark: SparkSession, args: argparse.Namespace) -> int:
    files, entries = _files(spark, args.source), tables.read_dictionary(spark, args.dictionary)
    rows = written(codec.timed(files, entries, args.binary).join(files.select("doc_id", "name"), "doc_id").drop("doc_id"), "timed")
    totals = written(codec.bench_totals(rows), "totals")
    rows.orderBy("name").show(100, truncate=False)
    totals.show(truncate=False)
    if args.out_json:
        tables.write_json(rows, f"{args.out_json}/files")
        tables.write_json(totals, f"{args.out_json}/totals")
    return int(not (totals.first().all_same or totals.first().n_docs == 0))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillstack").getOrCreate()
    match args.command:
        case "count":
            counts = written(frequency.token_counts(_texts(spark, args.folder, args.limit, args.raw)), "counts")
            tables.write_frequencies(counts, args.out)
            frequency.top_tokens(counts).show(60, truncate=False)
            frequency.coverage(counts).show()
            frequency.missing_tier0(counts).show(26)
        case "ngrams":
            texts = ngrams.held_back(_texts(spark, args.folder, args.limit, False))
            scored = written(ngrams.with_savings(ngrams.ngram_counts(texts, args.nmin, args.nmax, args.min), args.min), "ngrams")
            tables.write_ngrams(scored, args.out)
            ngrams.savings_report(scored).show(100, truncate=False)
        case "phrases":
            mined = written(phrases.mined(tables.read_ngrams(spark, *args.ngrams), tables.read_frequencies(spark, args.counts), args.min, args.absorb, args.min_pmi), "phrases")
            tables.write_phrases(mined, args.out)
            if args.report:
                phrases.report(mined, args.report).show(args.report, truncate=False)
        case "dictionary":
            counts = written(tables.read_frequencies(spark, args.counts), "counts")
            entries = written(dictionary.dictionary(counts, tables.read_phrases(spark, args.phrases), args.min, args.tier1_reserve, not args.keep_tier0_bigrams), "dictionary")
            tables.write_dictionary(entries, args.out)
            cuts = dictionary.profile_cuts(spark, dictionary.content_size(entries))
            tables.write_token_ids(dictionary.token_ids(entries, cuts), f"{args.out}-token-ids")
            tables.write_json(dictionary.special_tokens(cuts), f"{args.out}-special-tokens")
            tables.write_csv(dictionary.byte_fallback(cuts), f"{args.out}-byte-fallback")
            tables.write_json(cuts.drop("place"), f"{args.out}-profile-cuts")
            tables.write_csv(dictionary.essentials(counts, entries), f"{args.out}-essentials")
            tables.write_json(dictionary.stats(entries, counts), f"{args.out}-stats")
        case "encode":
            return _encode(spark, args)
        case "decode":
            return _decode(spark, args)
        case "verify":
            return _verify(spark, args)
        case "bench":
            return _bench(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
