import math
import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack import queries
from quillstack.constants import BASE64, FORCED, TIER0_IDS
from quillstack.operators import codec, dictionary, fillers, frequency, library, ngrams, phrases, ranking, transcripts
from quillstack.operators.codec import Codec
from quillstack.plans import scratch

from .oracle import FOLDER


def texts(spark, *rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(rows)], "doc_id long, text string, token string, freq int")


def test_counts_of_odd_texts(spark):
    df = texts(spark, None, "", "A a  a!", "é" * 50_000)
    assert {r.token: r.freq for r in frequency.token_counts(df).collect()} == {"a": 3, " ": 1, "  ": 1, "!": 1, "é" * 50_000: 1}
    empty = df.limit(0)
    assert frequency.token_counts(empty).count() == 0
    assert frequency.totals(frequency.token_counts(empty)).first().asDict() == {"total_tokens": 0, "unique_forms": 0}
    assert frequency.coverage(frequency.token_counts(empty)).count() == 0


def test_ranked_has_no_gaps_and_ties_by_key(spark):
    rows = [(random.Random(1).randrange(5) + k % 3, f"t{k:04d}") for k in range(1000)]
    df = spark.createDataFrame(rows, "freq int, token string").repartition(7)
    got = {r.token: r.place for r in ranking.ranked(df, "place", F.desc("freq"), F.asc("token")).collect()}
    assert got == {t: k for k, (f, t) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert ranking.ranked(df.limit(0), "place", F.desc("freq"), F.asc("token")).count() == 0


@pytest.mark.parametrize("min_freq", [1, 2, 3])
def test_ngrams(spark, min_freq):
    random.seed(min_freq)
    rows = [" ".join(random.choice("abcdefghij") * random.choice([1, 1, 2]) for _ in range(random.randrange(30))) for _ in range(60)] + ["A, a! b", None, ""]
    want = {}
    for t in rows:
        w = [x for x in (t or "").lower().replace(",", "").replace("!", "").split()]
        for n in range(2, 10):
            for k in range(len(w) - n + 1):
                want[n, " ".join(w[k : k + n])] = want.get((n, " ".join(w[k : k + n])), 0) + 1
    got = {(r.n, r.phrase): r.freq for r in ngrams.ngram_counts(texts(spark, *rows), min_freq=min_freq).collect()}
    assert got == {k: v for k, v in want.items() if v >= min_freq}


def test_pmi_and_absorption(spark):
    cand = spark.createDataFrame([("a b", 2, 10), ("a b c", 3, 7), ("b c", 2, 7), ("x y", 2, 9), ("x y z", 3, 6)], "phrase string, n int, freq long")
    counts = spark.createDataFrame([("a", 20), ("b", 30), ("c", 10), (" ", 40)], "token string, freq long")
    pmi = {r.phrase: r.pmi for r in phrases.with_pmi(cand, counts).collect()}
    assert math.isclose(pmi["a b"], math.log2(10) + math.log2(100) - math.log2(20) - math.log2(30))
    assert math.isclose(pmi["x y"], math.log2(9) + math.log2(100))
    assert {r.phrase for r in phrases.absorbed(cand).collect()} == {"a b", "b c"}
    assert phrases.mined(cand.limit(0), counts, 1).count() == 0


def test_dictionary_places(spark):
    counts = spark.createDataFrame([("zeta", 9), ("eta", 9), ("the", 50), (" ", 99), ("|", 1), ("rare", 1)], "token string, freq long")
    cand = spark.createDataFrame([("of the", 2, 30), ("zeta eta", 2, 9), ("eta", 1, 9)], "phrase string, n int, freq long")
    got = {r.surface: r for r in dictionary.dictionary(counts, cand, min_freq=5, reserve=1).collect()}
    assert got["|"].base64_id == "gA" and got["|"].int_id is None
    assert (got["eta"].base64_id, got["zeta"].base64_id, got["zeta eta"].base64_id) == ("gB", "gC", "gD")
    assert "of the" not in got and "rare" not in got and len(got) == len(TIER0_IDS) + len(FORCED) + 3
    assert sorted(r.int_id for r in got.values() if r.int_id is not None) == list(range(len(got) - 1))
    assert (got[" "].int_id, got["the"].int_id, got["eta"].int_id, got["zeta"].int_id, got["zeta eta"].int_id) == (0, 1, 2, 3, 4)
    assert "of the" in {r.surface for r in dictionary.dictionary(counts, cand, 5, 1, drop_tier0_bigrams=False).collect()}


def test_profile_cuts_of_a_known_size(spark):
    cuts = {r.profile: r for r in dictionary.profile_cuts(spark, 373_917).collect()}
    assert cuts["tiny"].total_vocab == 32_768 and cuts["full"].special_tokens_start == 262_128
    assert cuts["reference"].content_size == 373_917
    assert dictionary.byte_fallback(dictionary.profile_cuts(spark, 373_917)).where("byte_value = 1").first().id_in_reference == 373_918
    assert {r.content_size for r in dictionary.profile_cuts(spark, 10).collect()} == {10}


ENTRIES = {**TIER0_IDS, "|": "gA", "know": "gB", "you know": "gC", "you know what": "gD", "what i mean": "gAA", "nasa": "gAB", "a" * 15: "gAC"}
PAYLOADS = ["", "a", "the", "You know", "you know what i mean", "You  know\r\n\twhat", "NASA's iPhone | a:b", "OOV:A:x", "ELO|1|txt|", "İstanbul ẞ K Å ǅ", "A" * 2000, "x" * 60_000, "x.y" * 5000, "aAA" + "a" * 12, "你好 мир 👨‍👩‍👧", "a b .c", "know you know you know what"]


@pytest.mark.parametrize("binary", [False, True])
def test_round_trips(binary):
    c = Codec(ENTRIES)
    for text in PAYLOADS:
        stream, counts = c.encode(text, ".md", binary)
        assert (c.decode_binary if binary else c.decode_text)(stream) == (".md", text)
        assert counts[0] == sum(counts[1:5]) + counts[6]


@settings(deadline=None)
@given(st.text(max_size=60), st.booleans())
def test_any_text_comes_back(text, binary):
    text = text.encode("utf-8", "ignore").decode()
    c = Codec(ENTRIES)
    assert (c.decode_binary if binary else c.decode_text)(c.encode(text, "txt", binary)[0])[1] == text


def test_every_character_comes_back():
    c = Codec({**ENTRIES, **dict(zip("ißkåωθ", ["hAA", "hBA", "hCA", "hDA", "hEA", "hFA"], strict=True))})
    for k in range(0x3000):
        text = f"a{chr(k)}b {chr(k)}"
        for binary in (False, True):
            assert (c.decode_binary if binary else c.decode_text)(c.encode(text, "txt", binary)[0])[1] == text


def test_known_streams():
    c = Codec(ENTRIES)
    assert c.encode("You know what, nasa", ".txt", False)[0] == "ELO|1|txt|gAA:gD|k|g|gAB"
    assert c.encode("the Cat", ".txt", True)[0] == b"ELO\x02\x03txt" + bytes([19, 0xFF, 1]) + b"g" + b"\x03\x00cat"
    assert c.encode("NASA", "", True)[0] == b"ELO\x02\x00" + bytes([0xFE, 1]) + b"8" + bytes([0x80 | 32, 0, 1])


@pytest.mark.parametrize("bad", ["", "ELO|1", "XYZ|1|txt|a", "ELO|9|txt|A", "ELO|1|txt|??", "ELO|1|txt|OOV:x", "ELO|1|txt|g:??"])
def test_broken_text_streams(bad):
    with pytest.raises(ValueError):
        Codec(ENTRIES).decode_text(bad)


@pytest.mark.parametrize("bad", [b"", b"ELO\x01\x00", b"XYZ\x02\x00", b"ELO\x02\x00\x60", b"ELO\x02\x00\xff\x01A\x09\x00a", b"ELO\x02\x00\x7f\x3f", b"ELO\x02\x00\xfe\x01"])
def test_broken_binary_streams(bad):
    with pytest.raises(ValueError):
        Codec(ENTRIES).decode_binary(bad)


def test_encoding_of_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "You know it", 5), (4, "y" * 70_000, 5)], "doc_id long, text string, payload int")
    entries = spark.createDataFrame(list(ENTRIES.items()), "surface string, base64_id string").withColumn("tier", F.lit(0))
    got = {r.doc_id: r for r in codec.encoded(docs, entries, binary=True).collect()}
    assert got[1].payload is None and got[1].error is None and got[2].n_tokens == 0 and got[3].n_tokens == 2 and "too long" in got[4].error
    back = codec.decoded(codec.encoded(docs, entries), entries)
    assert {r.doc_id: r.text for r in back.collect()} == {1: None, 2: "", 3: "You know it", 4: "y" * 70_000}
    assert "version" in codec.decoded(spark.createDataFrame([(1, "ELO|7|x|")], "doc_id long, payload string"), entries).first().error
    monkeypatch.setattr(codec, "MOST_SENT", 3)
    large = {r.doc_id: r.payload for r in codec.encoded(docs, entries, binary=True).collect()}
    assert large == {k: r.payload for k, r in got.items()}
    assert codec.encoded(docs.limit(0), entries).count() == 0


@pytest.mark.parametrize("binary", [False, True])
def test_large_dictionaries_decode_the_same(spark, monkeypatch, binary):
    docs = spark.createDataFrame([*enumerate(PAYLOADS), (None, "You know it")], "doc_id long, text string")
    entries = spark.createDataFrame(list(ENTRIES.items()), "surface string, base64_id string")
    rows = [(r.doc_id, r.payload) for r in codec.encoded(docs, entries, binary=binary).collect()]
    whole = next(p for _, p in rows if p is not None and len(p) > 20)
    rows += [(900, whole[:-1]), (901, whole[:2]), (902, whole[:20] + whole[9:]), (903, whole + (b"\x7f\x3f" if binary else "|zz")), (904, None)]
    streams = spark.createDataFrame(rows, f"doc_id long, payload {'binary' if binary else 'string'}")
    key = lambda r: tuple(map(str, r))
    small = [sorted(codec.decoded(streams, entries, binary).collect(), key=key), sorted(codec.round_trip(docs, entries, binary).collect(), key=key)]
    monkeypatch.setattr(codec, "MOST_SENT", 3)
    assert [sorted(codec.decoded(streams, entries, binary).collect(), key=key), sorted(codec.round_trip(docs, entries, binary).collect(), key=key)] == small
    assert any(r.error for r in small[0]) and sum(r.text is not None for r in small[0]) > 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_dictionaries_take_no_shuffle_of_documents(spark, monkeypatch):
    docs = texts(spark, "You know it", None, "").withColumn("doc_id", F.monotonically_increasing_id())
    entries = spark.createDataFrame(list(ENTRIES.items()), "surface string, base64_id string")
    monkeypatch.setattr(codec, "MOST_SENT", 3)
    for binary in (False, True):
        streams = codec.encoded(docs, entries, binary)
        for df in (streams, codec.decoded(streams, entries, binary), codec.round_trip(docs, entries, binary), codec.timed(docs, entries, binary)):
            assert "Exchange" not in _plan(df) and "Join" not in _plan(df)


@pytest.mark.parametrize("binary", [False, True])
def test_packed_dictionary_is_the_same_codec(spark, binary):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "ß", "σας", "日本"]
    surfaces = dict.fromkeys([*map(str.lower, words), "-", "|", "\n", " ", *(" ".join(rng.choices(words, k=rng.randrange(2, 10))).lower() for _ in range(400))])
    entries = {s: "g" + BASE64[k // 64] + BASE64[k % 64] if k % 3 else "h" + BASE64[k // 4096] + BASE64[k // 64 % 64] + BASE64[k % 64] for k, s in enumerate(surfaces)}
    small = Codec(entries)
    large = codec.PackedCodec(codec.packed(spark.createDataFrame(list(entries.items()), "surface string, base64_id string")))
    for _ in range(300):
        text = "".join(rng.choice([*surfaces, rng.choice(words).upper(), "unknown", "ΣΑΣ", "İx"]) + rng.choice([" ", " ", "", ", ", "\n"]) for _ in range(30))
        stream = small.encode(text, ".txt", binary)
        assert large.encode(text, ".txt", binary) == stream
        assert (large.decode_binary if binary else large.decode_text)(stream[0]) == (".txt", text)
    with pytest.raises(ValueError):
        (large.decode_binary if binary else large.decode_text)(b"ELO\x02\x00\x7f\x3f" if binary else "ELO|1||zz")
    assert large.ids.get("no such word") is None and all(large.ids.get(s) == i for s, i in entries.items())


def test_written_tables_leave_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = set(str(tracker.shuffleStatuses().keys().mkString(",")).split(","))
    scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert not set(str(tracker.shuffleStatuses().keys().mkString(",")).split(",")) - before


def test_words_by_joins_are_the_same_stream(spark):
    words = {k: v for k, v in ENTRIES.items() if " " not in k or k == " "}
    entries = spark.createDataFrame([(s, i, len(i) - 1) for s, i in words.items()], "surface string, base64_id string, tier int")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(PAYLOADS) if t and len(t) < 1000], "doc_id long, text string")
    c = Codec(words)
    got = codec.encoded_words(docs, entries)
    assert {r.doc_id: r.payload for r in got.collect()} == {k: c.encode(t, "txt", False)[0] for k, t in enumerate(PAYLOADS) if t and len(t) < 1000}
    assert {r.doc_id: r.text for r in codec.decoded_words(got, entries).collect()} == {r.doc_id: r.text for r in docs.collect()}
    with pytest.raises(Exception, match="unknown id"):
        codec.decoded_words(spark.createDataFrame([(1, "ELO|1|txt|??")], "doc_id long, payload string"), entries).collect()


def test_known_repeats():
    f = lambda t: " ".join(transcripts.without_repeats(t.split()))
    assert f("a b a b c") == "a b c" and f("a b a b a b") == "a b" and f("a a b") == "a a b" and f("x x x x") == "x x"
    w = [str(k) for k in range(100)]
    assert transcripts.without_overlap(w[:50], w[46:60]) == w[50:60]
    assert transcripts.without_overlap(w[:50], w[47:60]) == w[47:60]
    assert transcripts.without_overlap(w[:70], w[10:80]) == w[70:80]
    assert transcripts.without_overlap(w[:70], w[9:80]) == w[9:80]


def folded(rows):
    """The rule as one pass over a video's chunks."""
    out, before = [], []
    for chunk, text in sorted(rows):
        words = (text or "").split()
        if not words:
            continue
        kept = transcripts.without_overlap(before, transcripts.without_repeats(words))
        before = kept
        if kept:
            out.append((chunk, " ".join(kept)))
    return out


def test_chunks_in_blocks_are_the_fold(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 5)
    random.seed(4)
    rows = []
    for video in range(6):
        line = [random.choice("abcdefgh") for _ in range(2000)] if video else list("abcd") * 500
        at = 0
        for chunk in range(60):
            size = random.randrange(0, 25) if chunk % 9 else random.randrange(60, 140)
            rows.append((f"v{video}", chunk, " ".join(line[max(0, at - random.choice([0, 3, 4, 5, 9, 20])) : at + size]) if chunk % 7 else random.choice([None, "", "  "]), 0))
            at += size
    rows += rows[:20] + [(None, 1, "a b", 0), ("v1", None, "a b", 0)]
    got = transcripts.cleaned(spark.createDataFrame(rows, "video_id string, chunk_id int, text string, n_words int")).collect()
    for video in range(6):
        assert sorted((r.chunk_id, r.text) for r in got if r.video_id == f"v{video}") == folded([(c, t) for v, c, t, _ in rows[:360] if v == f"v{video}"])
    assert {r.video_id for r in got} == {f"v{k}" for k in range(6)}


def test_lemmas_of_all_surfaces(spark):
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    surfaces = spark.range(100_050).select(letters.alias("surface"), F.lit(1).alias("freq"))
    assert library.lemmas(surfaces).count() == 100_050
    assert library.lemmas(surfaces, most=7).count() == 7


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, None)], "id string, n int, at int")
    new = spark.createDataFrame([("a", 2, 5), ("a", 3, 4), ("c", 9, None)], "id string, n int, at int")
    assert {r.id: r.n for r in transcripts.upserted(old, new, "id", "at").collect()} == {"a": 2, "b": 1, "c": 9}


def test_fillers(spark):
    df = texts(spark, "Um, you know what I mean? I mean it. so you know", None, "", "kind of")
    got = sorted((r.doc_id, r.pos, r.filler) for r in fillers.occurrences(df).collect())
    assert got == [(0, 0, "um"), (0, 1, "you know what i mean"), (0, 2, "know what i mean"), (0, 4, "i mean"), (0, 6, "i mean it"), (0, 9, "so"), (0, 10, "you know"), (3, 0, "kind of")]
    assert fillers.weights(spark).count() == 12


def test_library_ids_run_out(spark):
    words = spark.createDataFrame([(f"w{k}", 10) for k in range(5)], "lemma string, frequency int")
    taken = spark.createDataFrame([("gA",), ("gC",), (None,), ("T",)], "id string")
    assert sorted(r.id for r in library.with_ids(words, taken).collect()) == ["gB", "gD", "gE", "gF", "gG"]


def test_library_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    near = library.nearest_vectors(v, v.where("vec_id <= 2"), 2).collect()
    assert sorted((r.query_id, r.vec_id, r.rank) for r in near) == [(1, 1, 1), (1, 3, 2), (2, 2, 1), (2, 3, 2)]
    axes = library.poles(spark.createDataFrame([("+", [1.0, 0.0]), ("+", [3.0, 0.0]), ("-", [0.0, 1.0]), (None, [1.0, 1.0])], "pole string, embedding array<double>"))
    got = {r.vec_id: r.e for r in library.projected(v, axes, {"e": ("+", "-")}).collect()}
    assert math.isclose(got[1], 1, abs_tol=1e-6) and math.isclose(got[2], -1, abs_tol=1e-6) and abs(got[3]) < 1e-6
    stage = spark.createDataFrame([(0.0, 0.0, 0.4), (0.6, 0.2, -0.3), (None, 0.0, 0.0)], "e double, p double, a double").select(library.stage_of(F.col("e"), F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in stage] == ["STAGE_PERCEPTION", "STAGE_RESULT", None]
    model = library.embedded(spark.createDataFrame([("a",), ("bb",)], "lemma string"), lambda words: [[float(len(w)), 0.0] for w in words])
    assert [round(x, 4) for r in model.collect() for x in r.embedding] == [1.0, 0.0, 1.0, 0.0]


def test_first_delivery_of_a_chunk_counts(spark):
    rows = spark.createDataFrame([("v", 0, "a late one here", 2), ("v", 0, "the first one here", 1), ("v", 1, "more of it", 5)], "video_id string, chunk_id int, text string, at int")
    assert {r.text for r in transcripts.cleaned(rows, "at").collect()} == {"the first one here", "more of it"}
    assert "a late one here" in {r.text for r in transcripts.cleaned(rows).collect()}


def test_ngrams_of_any_length_behind_sieves(spark):
    rng = random.Random(5)
    phrase = " ".join(f"w{k}" for k in range(14))
    rows = [" ".join(rng.choice(["x", "y", phrase]) for _ in range(rng.randrange(6))) for _ in range(80)]
    want = {}
    for t in rows:
        w = t.split()
        for n in range(3, 13):
            for k in range(len(w) - n + 1):
                want[n, " ".join(w[k : k + n])] = want.get((n, " ".join(w[k : k + n])), 0) + 1
    got = {(r.n, r.phrase): r.freq for r in ngrams.ngram_counts(texts(spark, *rows), 3, 12, 4).collect()}
    assert got == {k: v for k, v in want.items() if v >= 4} and len(got) > 50


@pytest.mark.parametrize(("least", "most"), [(1, 1), (2, 9), (3, 4), (2, 12)])
def test_length_totals_are_those_of_the_counts(spark, least, most):
    rng = random.Random(7)
    phrase = " ".join(f"w{k}" for k in range(11))
    rows = [" ".join(rng.choice(["x", "Y", "z.z", f"u{k}", phrase]) for _ in range(rng.randrange(9))) for k in range(120)] + [None, "", "one"]
    want = {tuple(r) for r in ngrams.distinct_by_length(ngrams.ngram_counts(texts(spark, *rows), least, most)).collect()}
    assert {tuple(r) for r in ngrams.length_totals(texts(spark, *rows), least, most).collect()} == want
    assert not ngrams.length_totals(texts(spark, None, ""), least, most).collect()


def test_length_totals_shuffle_no_phrases(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngrams, "written", lambda df, name: seen.append(df) or scratch.written(df, name))
    ngrams.length_totals(texts(spark, "a b c", "a b c"))
    assert seen and all("phrase" not in df._jdf.queryExecution().executedPlan().toString() for df in seen)


def test_frequent_runs_are_shuffled_packed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngrams, "written", lambda df, name: seen.append(df) or scratch.written(df, name))
    got = ngrams.ngram_counts(texts(spark, "A b c. É_x", "a b c", "b c é_x", None, ""), 2, 9, 2)
    assert {(r.n, r.phrase, r.freq) for r in got.collect()} == {(2, "a b", 2), (2, "b c", 3), (2, "c é_x", 2), (3, "a b c", 2), (3, "b c é_x", 2)}
    assert seen and all("hashpartitioning(part" in _plan(df) and "hashpartitioning(n" not in _plan(df) for df in seen)


def test_packed_dictionary_is_sent_compressed(spark):
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    surfaces = sorted({" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(40_000)})
    entries = [(s, "ghij"[k >> 18] + BASE64[k >> 12 & 63] + BASE64[k >> 6 & 63] + BASE64[k & 63]) for k, s in enumerate(surfaces)]
    sent = codec.packed(spark.createDataFrame(entries, "surface string, base64_id string"))
    assert len(pickle.dumps(sent)) < 24 * len(entries)
    large = codec.PackedCodec(sent)
    assert codec.PackedCodec(sent).ids is large.ids
    assert all(large.ids.get(s) == i and large.surfaces[i][0] == s for s, i in entries)


@pytest.mark.parametrize(("binary", "query"), [(True, "decode_binary_stream"), (False, "decode_phrase_stream")])
def test_there_and_back_is_decoding_what_was_encoded(spark, binary, query):
    assert _plan(queries.QUERIES[query](spark, FOLDER)).count("MapInArrow") == 1
    docs = texts(spark, "You know it", None, "", "y" * 70_000).select("doc_id", "text")
    entries = spark.createDataFrame(list(ENTRIES.items()), "surface string, base64_id string")
    both = codec.decoded(codec.encoded(docs, entries, binary), entries, binary).select("doc_id", "text")
    got = codec.there_and_back(docs, entries, binary)
    assert sorted(got.select("doc_id", "text").collect(), key=str) == sorted(both.collect(), key=str)
    assert [r.doc_id for r in got.where("error is not null").collect()] == ([3] if binary else [])


def test_only_the_dictionary_stays_of_its_tables(spark):
    with scratch.scratch(spark) as made:
        entries, counts = queries._v03(spark, FOLDER)
        there = [p for p in made if scratch.file_system(spark, p)[0].exists(scratch.file_system(spark, p)[1])]
        assert len(there) == 2 < len(made) and entries.count() > 500 < counts.count()
    assert not any(scratch.file_system(spark, p)[0].exists(scratch.file_system(spark, p)[1]) for p in made)
