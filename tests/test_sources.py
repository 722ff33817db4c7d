import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstack.operators import dictionary, frequency, ngrams, phrases
from quillstack.sources import formats, library, tables, transcripts
from quillstack.streaming import corpus

SAMPLES = {
    "a.txt": b"Plain text, 3.5 times \"quoted\".\n", "b.MD": "# T\u2014itle\n```\ncode\n```\n".encode(), "c.json": b'{"k": {"v": "1.2.3"}}\n', "d.csv": b'a,"b, c"\nO\'Brien,x@y.z\n', "e.xml": b"<a href='u'>b</a>\r\n",
    "f.htm": b"<p class=x>y</p>", "g.yml": b"a:\n  - b: |\n      c\n", "h.log": b"12:00:01 INFO /x/y 0.5x\n", "i.srt": b"1\n00:00:01,000 --> 00:00:02,000\nHi\n\n", "sub/j.vtt": b"WEBVTT\n\n00:01.000 --> 00:02.000\nHi\n", "k.exe": b"MZ", "l.txt": b"\xff\xfe bad",
}


@pytest.fixture
def folder(tmp_path):
    for name, content in SAMPLES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_files_come_back(spark, folder, tmp_path):
    rows = formats.read_files(spark, str(folder))
    got = {Path(r.path).name: r for r in rows.collect()}
    assert set(got) == {Path(n).name for n in SAMPLES} - {"k.exe"}
    assert (got["b.MD"].fmt, got["f.htm"].fmt, got["g.yml"].fmt, got["l.txt"].text) == (".md", ".html", ".yaml", None)
    assert {Path(r.path).name for r in formats.same_bytes(rows).where("not same").collect()} == {"l.txt"}
    with pytest.raises(Exception, match="unknown format"):
        formats.read_files(spark, str(folder), strict=True).collect()
    out = tmp_path / "out"
    assert formats.write_files(rows.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content"), str(out)) == 11
    assert all((out / Path(n).name).read_bytes() == c for n, c in SAMPLES.items() if n != "k.exe")
    with pytest.raises(Exception, match="not below"):
        formats.write_files(spark.createDataFrame([("../x", b"a")], "name string, content binary").select("name", "content"), str(out))


def test_adapters():
    formats.register_adapter("ABC", formats.UTF8)
    assert formats.get_adapter(".abc") is formats.UTF8 and formats.canonical("htm") == ".html"
    with pytest.raises(KeyError):
        formats.get_adapter(".xyz")


@pytest.fixture
def talks(tmp_path):
    put = lambda name, data: ((tmp_path / name).parent.mkdir(exist_ok=True), (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data)))
    chunk = lambda t, **k: {"text": t, "start": 2, **k}
    put("a.json", {"video_id": "v1", "chunks": [chunk("one two three four"), chunk("  "), chunk("one two three four five &amp; six", speaker="S")]})
    put("sub/b.json", {"video_id": "v1", "title": "later", "chunks": [chunk("other")]})
    put("c.json", {"title": "no id", "channel_name": "C", "chunks": [chunk("x x x x"), {"start": 1}]})
    put("d.json", "{broken")
    put("e.json", {"video_id": "v2"})
    return tmp_path


def test_scan(spark, talks):
    files = {r.video_id: r for r in transcripts.read_files(spark, str(talks)).collect()}
    assert set(files) == {"v1", "c", "v2"} and files["v1"].title == "" and files["v1"].channel_name == "unknown"
    got = sorted((r.video_id, r.chunk_id, r.text, r.meta.speaker, r.meta.start) for r in transcripts.scan(spark, str(talks)).collect())
    assert got == [("c", 0, "x x", "unknown", 2.0), ("v1", 0, "one two three four", "unknown", 2.0), ("v1", 2, "five & six", "S", 2.0)]
    done = spark.createDataFrame([("v1",), (None,)], "video_id string")
    assert {r.video_id for r in transcripts.scan(spark, str(talks), done).collect()} == {"c"}
    assert {r.video_id for r in transcripts.read_files(spark, str(talks), limit=2).collect()} == {"v1", "c"}
    assert transcripts.read_files(spark, str(talks), limit=0).count() == 0
    assert transcripts.raw_texts(transcripts.read_files(spark, str(talks))).where("text is null").count() == 1


def test_tables_come_back(spark, tmp_path):
    texts = spark.createDataFrame([("a b a b\té\n|",), ("a b c",)], "text string")
    counts = frequency.token_counts(texts)
    tables.write_frequencies(counts, str(tmp_path / "f"))
    assert sorted(map(tuple, tables.read_frequencies(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, counts.collect()))
    scored = ngrams.with_savings(ngrams.ngram_counts(texts), 1)
    tables.write_ngrams(scored, str(tmp_path / "n"))
    assert sorted((r.n, r.phrase, r.freq) for r in tables.read_ngrams(spark, str(tmp_path / "n")).collect()) == sorted((r.n, r.phrase, r.freq) for r in scored.collect())
    mined = phrases.mined(ngrams.ngram_counts(texts), counts, 1)
    tables.write_phrases(mined, str(tmp_path / "p"))
    assert {r.phrase for r in tables.read_phrases(spark, str(tmp_path / "p")).collect()} == {r.phrase for r in mined.collect()}
    entries = dictionary.dictionary(counts, mined, 1)
    tables.write_dictionary(entries, str(tmp_path / "d"))
    again = tables.read_dictionary(spark, str(tmp_path / "d"))
    assert again.count() == entries.count()
    cuts = dictionary.profile_cuts(spark, dictionary.content_size(again))
    tables.write_token_ids(dictionary.token_ids(again, cuts), str(tmp_path / "t"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "t")).count() == again.where("int_id is not null").count()
    tables.write_csv(dictionary.byte_fallback(cuts), str(tmp_path / "b"))
    tables.write_json(cuts, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    assert tables.read_ngrams(spark).count() == 0


def test_library_tables(spark, tmp_path):
    for name in library.SCHEMAS:
        assert library.merged(name, library.empty(spark, name), library.empty(spark, name)).count() == 0
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    library.write_index(v, str(tmp_path / "i"))
    assert library.read_index(spark, str(tmp_path / "i")).collect() == v.collect()


def test_streams(spark, talks, tmp_path):
    chunks = corpus.chunk_stream(corpus.file_stream(spark, str(talks)))
    run = corpus.token_counts(chunks).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counted").where("token = 'one'").first().freq == 2
    out = corpus.cleaned_stream(chunks.where("video_id = 'v1'")).writeStream.format("memory").queryName("cleaned").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert {r.text for r in spark.table("cleaned").collect()} >= {"one two three four", "five & six"}
    batch = {(r.video_id, r.chunk_id, r.text) for r in transcripts.scan(spark, str(talks)).where("video_id = 'v1'").collect()}
    assert {(r.video_id, r.chunk_id, r.text) for r in spark.table("cleaned").collect()} == batch


def test_files_go_to_mounted_folders_alone(spark):
    rows = spark.createDataFrame([("a", b"x")], "name string, content binary")
    with pytest.raises(ValueError, match="mounted"):
        formats.write_files(rows, "s3a://bucket/folder")


def test_new_library_rows_are_stamped(spark):
    new = spark.createDataFrame([("v1", "c", 1, 2)], "video_id string, channel_name string, chunk_count int, token_count int")
    assert library.merged("corpus_stats", library.empty(spark, "corpus_stats"), new).first().processed_at is not None


def test_event_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 10:05:00", "a", 1.0), ("2025-01-01 10:50:00", "a", 2.0), ("2025-01-01 12:30:00", "b", 5.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    run = corpus.event_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").where("event_type = 'a'").collect()] == [(2, 3.0)]
