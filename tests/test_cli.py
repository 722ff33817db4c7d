import json

from quillstack.cli import main


def test_pipeline(spark, tmp_path):
    talks, docs = tmp_path / "talks", tmp_path / "docs"
    talks.mkdir()
    (docs / "sub").mkdir(parents=True)
    for k in range(4):
        (talks / f"{k}.json").write_text(json.dumps({"video_id": f"v{k}", "chunks": [{"text": "you know what the second speaker said"}, {"text": "Well, you know what I mean | right"}]}))
    (docs / "a.txt").write_bytes("You know what — the Second speaker\r\nsaid 3.5!\n".encode())
    (docs / "sub/b.md").write_bytes(b"# Title | x\n")
    at = lambda name: str(tmp_path / name)
    assert main(["count", str(talks), at("counts")]) == 0
    assert main(["ngrams", str(talks), at("ngrams"), "--min", "2", "--nmax", "4"]) == 0
    assert main(["phrases", at("counts"), at("phrases"), at("ngrams"), "--report", "5"]) == 0
    assert main(["dictionary", at("counts"), at("phrases"), at("dict"), "--min", "2"]) == 0
    for flag in ([], ["--binary"]):
        out, back = at(f"out{len(flag)}"), at(f"back{len(flag)}")
        assert main(["encode", at("dict"), str(docs), out, "--stats", *flag]) == 0
        assert main(["decode", at("dict"), out, back, *flag]) == 0
        for name in ("a.txt", "sub/b.md"):
            assert (tmp_path / f"back{len(flag)}" / name).read_bytes() == (docs / name).read_bytes()
        assert main(["verify", at("dict"), str(docs), *flag]) == 0
    assert main(["encode", at("dict"), str(docs / "a.txt"), at("one")]) == 0
    assert (tmp_path / "one/a.txt.elo").exists()
    (tmp_path / "one/a.txt.elo").rename(tmp_path / "one/plain.elo")
    assert main(["decode", at("dict"), at("one")]) == 0  # beside the stream, with the header's extension
    assert (tmp_path / "one/plain.txt").read_bytes() == (docs / "a.txt").read_bytes()
    assert main(["bench", at("dict"), str(docs), "--binary", "--out-json", at("bench")]) == 0
    rows = [json.loads(x) for f in (tmp_path / "bench/files").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["name"]: r["same"] for r in rows} == {"a.txt": True, "sub/b.md": True}
    total = [json.loads(x) for f in (tmp_path / "bench/totals").glob("*.json") for x in f.read_text().splitlines()]
    assert total[0]["n_docs"] == 2 and total[0]["src_bytes"] == sum(r["src_bytes"] for r in rows) and total[0]["all_same"]
