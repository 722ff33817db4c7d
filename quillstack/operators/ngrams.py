"""Runs of words, their counts and what an id of their own would save."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAPACITY, HELD_OUT, MIN_FREQ, NGRAMS, PHRASE_BYTES, WORD_BYTES
from ..functions import text as T
from ..functions.packing import planes, pressed, unpressed, values
from ..plans.scratch import written
from .ranking import running, top


def runs(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` words as structs of n and phrase; null where there are fewer words."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.struct(n.alias("n"), F.array_join(F.slice(words, k, n), " ").alias("phrase")))
    return F.when(F.size(words) >= least, F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.size(words))), of)))


def held_back(texts: DataFrame, ids: list[str] | DataFrame = HELD_OUT, column: str = "video_id") -> DataFrame:
    """Rows of no held-out video. Rows without video are kept."""
    if isinstance(ids, DataFrame):
        return texts.join(ids.select(column).distinct(), column, "left_anti")
    return texts.where(F.col(column).isNull() | ~F.col(column).isin(*ids))


#: Lengths counted in one pass over the texts each. A run is counted only if all runs of the last length before are frequent.
LEVELS = ((2, 2), (3, 4), (5, 9))
#: Words worked on at once, bits of a sieve for each of its runs and at most (32 MB, sent to all tasks).
_BLOCK, _BITS, _MOST_BITS = 500_000, 16, 1 << 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_counts(texts: DataFrame, least: int = NGRAMS[0], most: int = NGRAMS[1], min_freq: int = 1, column: str = "text") -> DataFrame:
    """n, phrase and freq of all runs of ``least`` to ``most`` words within a row, of at least ``min_freq``.

    Words are lower-cased; white space and marks between them don't matter. With a ``min_freq`` lengths are counted
    level by level: a run is formed only if the shorter ones in it are frequent, as they must be. Which those are is told
    by a bitmap of their hashes, whose size is bounded; where it errs a run is counted in vain, so counts are exact.
    Texts are never shuffled, only each block's sums, sorted and compressed by part. Null texts, and texts of fewer words, have none.
    """
    rows = texts.select(T.words(column).alias("w"))
    if min_freq <= 1 or least < 2:
        return rows.select(F.explode(runs(F.col("w"), least, most)).alias("g")).groupBy("g.n", "g.phrase").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    levels = [(a, min(b, most)) for a, b in LEVELS if a <= most]
    levels += [(LEVELS[-1][1] + 1, most)] if most > LEVELS[-1][1] else []
    parts, out, sieve, known = _parts(rows), None, None, 0
    for first, last in levels:
        sums = rows.mapInArrow(_counter(first, last, sieve, known, parts), "part int, phrases binary, freqs binary")
        level = written(sums.groupBy("part").applyInArrow(_summed(min_freq), "n int, phrase string, freq long"), "runs")
        out = level if out is None else out.unionByName(level)
        if last < most:
            sieve, known = _sieve(level.where(F.col("n") == last), last), last
    return out.where(F.col("n") >= least) if least > 2 else out


def _parts(rows: DataFrame) -> int:
    """Parts by hash that runs are shuffled in, a power of two: four for each part of the texts."""
    return 1 << max(6, (4 * rows.rdd.getNumPartitions() - 1).bit_length())


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False).astype(np.uint64)


def _places(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Bits of runs whose first words have the hashes in the first column, and so on."""
    out = np.zeros(len(columns[0]), np.uint64)
    for h in columns:
        out = (out ^ h) * _STEP
        out ^= out >> np.uint64(29)
    return out & np.uint64(bits - 1)


def _sieve(frequent: DataFrame, n: int):
    """A bitmap of the hashes of phrases of ``n`` words, as a broadcast variable of bounded size."""
    bits = 1 << 16
    while bits < min(_MOST_BITS, frequent.count() * _BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.list_flatten(pc.split_pattern(batch.column(0), " ")).dictionary_encode()
            h = _hashes(words.dictionary)[words.indices.to_numpy()].reshape(-1, n) if len(words) else np.zeros((0, n), np.uint64)
            at = _places([h[:, k] for k in range(n)], bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bit"])

    cells = frequent.select("phrase").mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bitmap)


def _counter(least: int, most: int, sieve, known: int, parts: int):
    """Counts, by block of words, the runs of ``least`` to ``most`` words in which all of ``known`` words are in the sieve.

    A row for each block and part: its runs in order of their words, a line each, and how often they occur, both compressed.
    The part is the first bits of the run's hash.
    """
    shift = np.uint64(64 - (parts - 1).bit_length())

    def mixed(before: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = (before ^ h) * _STEP
        return (out ^ out >> np.uint64(29)) * _STEP

    def count(words: pa.Array, lens: np.ndarray) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        coded_names = np.array(coded.dictionary.to_pylist(), object)
        order = coded_names.argsort()
        size = len(order)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        codes = rank[coded.indices.to_numpy()]
        h = _hashes(coded.dictionary)[order][codes]
        ends = np.repeat(lens.cumsum(), lens)
        if sieve is None:
            fine = None
        else:
            n = max(0, len(codes) - known + 1)
            at = _places([h[k : n + k] for k in range(known)], len(sieve.value) * 64)
            fine = (sieve.value[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
        whole = coded_names[order][codes]
        start, code, key = np.arange(len(codes)), codes, mixed(np.uint64(0), h)
        phrases: list[str] = []
        freqs, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for n in range(2, most + 1):
            keep = start + n <= ends[start]
            if fine is not None and n >= known:
                keep[keep] &= fine[start[keep] + n - known]
            start = start[keep]
            key = mixed(key[keep], h[start + n - 1])
            _, first, code, counts = np.unique(code[keep] * size + codes[start + n - 1], return_index=True, return_inverse=True, return_counts=True)
            if n >= least and len(start):
                phrases += map(" ".join, zip(*[whole[start[first] + k] for k in range(n)], strict=True))
                freqs.append(counts.astype(np.uint32))
                places.append((key[first] >> shift).astype(np.int64))
        part, freq = np.concatenate(places), np.concatenate(freqs)
        order = part.argsort(kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        lines, freq = np.array(phrases, object)[order], freq[order]
        out = [(k, pressed("\n".join(lines[a:b]).encode()), pressed(planes(freq[a:b]))) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["part", "phrases", "freqs"])

    return _by_block(count)


def _summed(min_freq: int):
    """n, phrase and freq of the runs of a part that occur at least ``min_freq`` times."""

    def merge(table: pa.Table) -> pa.Table:
        lines = pa.array([unpressed(x.as_py()) for x in table.column("phrases")], pa.binary()).cast(pa.large_string())
        freqs = np.concatenate([values(unpressed(x.as_py()), np.uint32) for x in table.column("freqs")]).astype(np.int64)
        rows = pa.table([pc.list_flatten(pc.split_pattern(lines, "\n")), pa.array(freqs)], names=["phrase", "freq"])
        sums = rows.group_by("phrase", use_threads=False).aggregate([("freq", "sum")])
        kept = sums.filter(pc.greater_equal(sums.column("freq_sum"), min_freq))
        n = pc.add(pc.count_substring(kept.column("phrase"), " "), 1).cast(pa.int32())
        return pa.table([n, kept.column("phrase").cast(pa.string()), kept.column("freq_sum")], names=["n", "phrase", "freq"])

    return merge


def _by_block(count):
    """Gives ``count`` the words of some texts at once, and how many each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Array] = []
        lens: list[np.ndarray] = []
        size = 0
        for batch in batches:
            lists = batch.column(0)
            own = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(own.cumsum() // _BLOCK)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                parts.append(lists.slice(a, b - a).flatten())
                lens.append(own[a:b])
                size += len(parts[-1])
                if size >= _BLOCK:
                    yield count(pa.concat_arrays(parts), np.concatenate(lens))
                    parts, lens, size = [], [], 0
        if size:
            yield count(pa.concat_arrays(parts), np.concatenate(lens))

    return run


def distinct_by_length(grams: DataFrame) -> DataFrame:
    return grams.groupBy("n").agg(F.count("*").alias("n_phrases"), F.sum("freq").alias("n_occurrences"))


#: Lengths in one pass each where runs are only told apart.
_PASSES = ((2, 2), (3, 3), (4, 4), (5, 9))
_KEYS = ("0123456789abcdef", "fedcba9876543210")


def _distinct(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(high)])
    return high[first], low[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def length_totals(texts: DataFrame, least: int = NGRAMS[0], most: int = NGRAMS[1], column: str = "text") -> DataFrame:
    """n, n_phrases and n_occurrences of all runs of ``least`` to ``most`` words, of any frequency, as ``distinct_by_length`` of their counts.

    How many runs occur follows from the sizes of the texts; those that occur once are what the repeated ones leave. A run is
    repeated only if the shorter ones in it are, so lengths are gone through level by level behind a sieve as in ``ngram_counts``.
    Runs go by 96 bits of hash (of a billion runs two fall together once in a hundred billion times), sorted and packed by block.
    """
    rows = texts.select(T.words(column).alias("w"))
    parts = _parts(rows)
    passes = [(a, min(b, most)) for a, b in _PASSES if a <= most]
    passes += [(_PASSES[-1][1] + 1, most)] if most > _PASSES[-1][1] else []
    spark, sieve, known = texts.sparkSession, None, 0
    total, repeated = dict.fromkeys(range(2, most + 1), 0), {}
    for first, last in passes:
        packed = rows.mapInArrow(_hashed(first, last, most, sieve, known, parts), "part int, n int, size long, high binary, low binary, counts binary")
        merged = written(packed.groupBy("part").applyInArrow(_merged(last if last < most else None), "part int, n int, size long, runs long, occurrences long, keys binary"), "lengths")
        for r in merged.groupBy("n").agg(F.sum("size").alias("size"), F.sum("runs").alias("runs"), F.sum("occurrences").alias("occurrences")).collect():  # a row for each length
            total[r.n] += r["size"] or 0
            repeated[r.n] = (repeated.get(r.n, (0, 0))[0] + (r.runs or 0), repeated.get(r.n, (0, 0))[1] + (r.occurrences or 0))
        if last < most:
            sieve, known = _ranged_sieve(merged.where((F.col("n") == last) & F.col("keys").isNotNull()), repeated.get(last, (0, 0))[0], parts), last
    got = [(n, total[n] - repeated.get(n, (0, 0))[1] + repeated.get(n, (0, 0))[0], total[n]) for n in range(max(2, least), most + 1) if total[n]]
    if least < 2 and most > 0:
        words = rows.select(F.explode("w").alias("word")).groupBy("word").count().agg(F.count("*").alias("n"), F.sum("count").alias("total")).first()
        got += [(1, words.n, words.total)] if words.n else []
    return spark.createDataFrame(got, "n int, n_phrases long, n_occurrences long")


def _hashed(least: int, most: int, longest: int, sieve, known: int, parts: int):
    """The runs of ``least`` to ``most`` words as ``_counter`` tells them, by hash: a row for each block, length and part, in which keys are sorted and packed.

    The part is the first bits of the hash. The first pass also says how many runs there are of each length up to ``longest``.
    """
    shift = np.uint64(64 - (parts - 1).bit_length())

    def mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = (h ^ other) * _STEP
        return (out ^ out >> np.uint64(29)) * _STEP

    def count(words: pa.Array, lens: np.ndarray) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), np.array(coded.dictionary.to_pylist(), object)
        own = [pd.util.hash_array(names, hash_key=k, categorize=False).astype(np.uint64)[codes] for k in _KEYS]
        ends = np.repeat(lens.cumsum(), lens)
        start = np.arange(len(codes))
        keys = [mixed(h, np.uint64(0)) for h in own]
        out: dict[str, list] = {c: [] for c in ("part", "n", "size", "high", "low", "counts")}
        fine = None
        if sieve is None:
            for n in range(2, longest + 1):
                for c, x in zip(out, (0, n, int(np.maximum(lens - n + 1, 0).sum()), None, None, None), strict=True):
                    out[c].append(x)
        for n in range(2, most + 1):
            keep = start + n <= ends[start]
            if fine is not None:
                keep[keep] &= fine[start[keep] + n - known]
            start = start[keep]
            keys = [mixed(h[keep], x[start + n - 1]) for h, x in zip(keys, own, strict=True)]
            if n == known:  # from here on: whether the run of that many words that begins at a place is in the sieve
                at = keys[0] >> np.uint64(64 - (len(sieve.value) * 8 - 1).bit_length())
                held = (sieve.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                fine = np.zeros(len(codes), bool)
                fine[start[held]] = True
                start, keys = start[held], [h[held] for h in keys]
            if n >= least and len(start):
                high, low, counts = _distinct(keys[0], keys[1].astype(np.uint32), np.ones(len(start), np.uint32))
                bounds = np.searchsorted(high >> shift, np.arange(parts + 1).astype(np.uint64))
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if a < b:
                        steps = np.diff(high[a:b], prepend=np.uint64(0))
                        for c, x in zip(out, (k, n, 0, planes(steps), planes(low[a:b]), planes(counts[a:b])), strict=True):
                            out[c].append(x)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    return _by_block(count)


def _merged(kept: int | None):
    """For each length in a part: runs that occur more than once, how often they do, and of the length ``kept`` their hashes."""

    def merge(table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        for n in pc.unique(table.column("n")).to_pylist():
            own = table.filter(pc.equal(table.column("n"), n))
            held = own.filter(pc.is_valid(own.column("high")))
            runs, times, keys = 0, 0, None
            if len(held):
                high = np.concatenate([np.cumsum(values(x.as_py(), np.uint64), dtype=np.uint64) for x in held.column("high")])
                low, counts = (np.concatenate([values(x.as_py(), np.uint32) for x in held.column(c)]) for c in ("low", "counts"))
                high, _, sums = _distinct(high, low, counts.astype(np.int64))
                more = sums > 1
                runs, times, keys = int(more.sum()), int(sums[more].sum()), high[more].tobytes() if n == kept else None
            out.append((part, n, pc.sum(own.column("size")).as_py(), runs, times, keys))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "n", "size", "runs", "occurrences", "keys"])

    return merge


def _ranged_sieve(merged: DataFrame, frequent: int, parts: int):
    """A bitmap of the hashes in ``keys``, as a broadcast variable of bounded size. Each part has a range of it, made by one task."""
    bits = max(1 << 16, parts * 64)
    while bits < min(_MOST_BITS, frequent * _BITS):
        bits *= 2
    size = bits // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for keys in batch.column(1).to_pylist():
                at = (np.frombuffer(keys, np.uint64) >> np.uint64(64 - (bits - 1).bit_length())) & np.uint64(size - 1)
                cells = np.zeros(size, bool)
                cells[at.astype(np.int64)] = True
                ranges.append(np.packbits(cells, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, pa.binary())], ["part", "bits"])

    bitmap = np.zeros(bits // 8, np.uint8)
    for r in merged.select("part", "keys").mapInArrow(run, "part int, bits binary").toLocalIterator():  # of bits / 8 bytes in all
        bitmap[r.part * size // 8 : (r.part + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return merged.sparkSession.sparkContext.broadcast(bitmap)


def with_savings(grams: DataFrame, min_freq: int = MIN_FREQ) -> DataFrame:
    """Phrases frequent enough that an id of their own saves bytes: word_cost, phrase_cost, savings_each and savings_total."""
    cost = F.col("n") * F.lit(WORD_BYTES)
    rows = grams.where(F.col("freq") >= min_freq).withColumn("word_cost", cost).withColumn("phrase_cost", F.lit(PHRASE_BYTES)).withColumn("savings_each", cost - PHRASE_BYTES)
    return rows.where("savings_each > 0").withColumn("savings_total", F.col("freq") * F.col("savings_each"))


def savings_report(scored: DataFrame, n: int = 100) -> DataFrame:
    """The phrases that save most, with the running sum."""
    return running(top(scored, n, F.desc("savings_total"), F.asc("phrase")), "savings_total", "cumulative", F.asc("rank"))


def phrase_bytes(rank: Column) -> Column:
    """Bytes of the id of a phrase at a place (from 0) of the dictionary."""
    return F.when(rank < CAPACITY[1], 2).when(rank < CAPACITY[1] + CAPACITY[2], 3).otherwise(4)
