"""The command line, a verb at a time."""

import json

from lexispark.cli import main


def run(spark, capsys, *argv):
    code = main(list(argv), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_verbs(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "tests_encoder.py").write_text("def lengths(texts):\n    return [[len(t), 1.0] for t in texts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "tests_encoder.py"))
    root, out = tmp_path / "root", str(tmp_path / "ix")
    root.mkdir()
    (root / "a.txt").write_text("the quick brown fox jumps over the lazy dog\n")
    (root / "b.txt").write_text("a slow green turtle walks under the busy bridge\n")
    at = ("--out", out)
    code, text, _ = run(spark, capsys, "index", str(root), *at)
    assert code == 0 and json.loads(text)["rows"] == 2
    assert "a.txt:1" in run(spark, capsys, "query", "fox", *at)[1] and "no hits" in run(spark, capsys, "query", "zzz", *at)[1]
    (root / "c.txt").write_text("another fox with novel vocabulary appears here\n")
    assert json.loads(run(spark, capsys, "update", *at)[1])["kind"] == "staged"
    tag = json.loads(run(spark, capsys, "segment", "list", *at)[1])[0]["tag"]
    assert json.loads(run(spark, capsys, "segment", "fold", "--tag", tag, *at)[1])["tag"] == tag
    assert "page 0 of 3" in run(spark, capsys, "browse", *at)[1] and json.loads(run(spark, capsys, "browse", "--files", *at)[1]) == ["a.txt", "b.txt", "c.txt"]
    assert json.loads(run(spark, capsys, "params", "--k1", "0.9", "--save", *at)[1])["persisted"]
    assert json.loads(run(spark, capsys, "info", *at)[1])["k1"] == 0.9
    assert json.loads(run(spark, capsys, "config", "--set", "approx_topk=true", *at)[1])["after"]["approx_topk"] is True
    assert json.loads(run(spark, capsys, "compact", *at)[1])["parts"] == 1
    assert "ok" in run(spark, capsys, "explain", "fox", *at)[1] and json.loads(run(spark, capsys, "diagnose", "zzz", "--json", *at)[1])["status"] == "all_oov"
    (tmp_path / "v.json").write_text("[[1, 0], [0, 1], [1, 1]]")
    (tmp_path / "q.json").write_text("[1, 0]")
    view = ("--name", "v", *at)
    assert json.loads(run(spark, capsys, "view", "attach", "--vectors", str(tmp_path / "v.json"), *view)[1])["covered_live"] == 3
    assert "a.txt" in run(spark, capsys, "view", "fuse", "fox", "--qvec", str(tmp_path / "q.json"), *view)[1]
    assert json.loads(run(spark, capsys, "view", "list", *at)[1])[0]["name"] == "v" and json.loads(run(spark, capsys, "view", "detach", *view)[1]) == {"detached": "v"}
    monkeypatch.setattr("sys.stdin", io.StringIO("fox\n\nturtle\n"))
    assert "b.txt:1" in run(spark, capsys, "repl", *at)[1]
    assert run(spark, capsys, "query", "fox", "--out", str(tmp_path / "none"))[0] == 1
    second = ("--out", str(tmp_path / "dense"))
    log = tmp_path / "log.txt"
    code, text, shown = run(spark, capsys, "--log", str(log), "index", str(root), *second, "--dense", "--model", "tests_encoder:lengths", "--w-cache", "--workers", "2", "--stream", "ids")
    assert code == 0 and "rows at" in shown and "rows at" in log.read_text()
    assert "a.txt" in run(spark, capsys, "query", "fox", *second, "--dense", "--model", "tests_encoder:lengths")[1]
    assert run(spark, capsys, "query", "fox", *second, "--dense")[0] == 1
    assert (tmp_path / "dense" / "views" / "dense").is_dir() and '"weights"' in "".join(p.read_text() for p in (tmp_path / "dense" / "_log").glob("*.json"))
    assert run(spark, capsys, "segment", "unmount", "--tag", "none", *at)[0] == 1
