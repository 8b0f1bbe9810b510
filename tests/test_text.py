"""Tokens, query words, spans, chunks and scan rules against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import chunks
from lexispark.sources import files
from lexispark.sources.local import local_rows

CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def plain_tokens(text):
    out, before = [], None
    for u in re.findall(rf"[{CJK}]|[^\W]+", text.lower()):
        single = re.fullmatch(f"[{CJK}]", u) is not None
        out.append(u)
        if single and before:
            out.append(before + u)
        before = u if single else None
    return out


TEXTS = ["", "Hello World_1 x2", "中文检索，测试。", "BM25权重 and 权重BM25", "かなカナ한국 漢字", "１２３ full", "a,b;c", "ÄÖü éà", "单 字 a 字", "x\ny\r\nz", "…!?", "tab\tsep", "中，文、a，中"]


def test_tokens(spark):
    out = local_rows(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string").select("i", tx.tokens("t").alias("k")).orderBy("i").collect()
    assert [r["k"] for r in out] == [*(plain_tokens(t) for t in TEXTS), []]


def test_custom_tokenizer_and_fallback(spark):
    split = tx.custom_tokens(str.split)
    assert local_rows(spark, [("a B  c",), (None,)], "t string").select(split("t").alias("k")).collect()[0]["k"] == ["a", "B", "c"]
    assert tx.tokenizer_status() in ({"name": "units", "degraded": True}, {"name": "jieba", "degraded": False})


def plain_ranges(text, words):
    found = [(i, i + len(w), w) for w in words if w for i in range(len(text) - len(w) + 1) if text.startswith(w, i)]
    return sorted(found, key=lambda r: (r[0], -r[1]))


@pytest.mark.parametrize("seed", range(3))
def test_ranges_and_spans(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice("ab.*\\E 中") for _ in range(rng.randrange(0, 40))), ["".join(rng.choice("ab.*\\E中") for _ in range(rng.randrange(0, 4))) for _ in range(3)]) for _ in range(60)]
    rows += [("", ["a"]), ("aaaa", ["aa", "a", "aa"]), ("x\\Ey", ["\\E", "\\Q"]), ("ab", ["abc"])]
    out = local_rows(spark, [(i, t, w) for i, (t, w) in enumerate(rows)], "i int, t string, w array<string>").select("i", tx.hit_ranges("t", "w").alias("r")).orderBy("i").collect()
    for (t, w), r in zip(rows, out, strict=True):
        assert sorted((x["start"], x["end"], x["tok"]) for x in r["r"]) == sorted(plain_ranges(t, w)), (t, w)
        assert [(x["start"], -x["end"]) for x in r["r"]] == sorted((x["start"], -x["end"]) for x in r["r"])


def test_span_of_a_query(spark):
    cases = [("one two three two", "two", (4, 7)), ("one two three two", "two, one", (0, 17)), ("one two", "  two ", (4, 7)), ("one", "four", None), ("one", "  ", None), (None, "a", None), ("a，b、c", "b、c", (2, 5)), ("a-b", "b-a", (0, 3)), ("Two", "two", None)]
    out = local_rows(spark, [(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q string").select("i", tx.hit_span("t", "q").alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) if r["s"] else None for r in out] == [c[2] for c in cases]
    words = local_rows(spark, [("a，b、c d-e «f»　g",)], "q string").select(tx.query_tokens("q").alias("w")).first()["w"]
    assert words == ["a", "b", "c", "d", "e", "«f»", "g"]


def plain_prose(text):
    paras, buf, start = [], [], 1
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        if not line.strip():
            if buf:
                paras.append(("".join(buf).strip(), start))
            buf = []
        else:
            start = start if buf else n
            buf.append(line)
    if buf:
        paras.append(("".join(buf).strip(), start))
    return [(body[i : i + 1200], n) for body, n in paras if len(body) >= 20 for i in range(0, len(body), 1200)]


def plain_code(text):
    lines = text.splitlines()
    out = [("\n".join(lines[i : i + 80]).strip(), i + 1) for i in range(0, len(lines), 80)]
    return [c for c in out if len(c[0]) >= 20]


def chunk_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    texts = ["", " \n\t\n", "x" * 19, "x" * 20, "y" * 1200, "y" * 1201, "z" * 2410, "first line here\r\nsecond line here\r\n\r\nthird paragraph of text", "page one of the text\fpage two of the text", "no newline at the end of this", "\n\n  lead of a paragraph\n trail  \n\n", "a b and some more letters\x85next line of text", "　　wide blanks around this text　"]
    texts += ["\n".join(" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts += ["\n".join(f"line {i}" for i in range(n)) for n in (79, 80, 81, 160, 161, 162)]
    return texts


def test_chunks(spark):
    texts = chunk_texts()
    df = local_rows(spark, [(f"{i}.{'py' if i % 2 else 'md'}", t) for i, t in enumerate(texts)], "file string, text string")
    for f, plain in ((chunks.prose_chunks, plain_prose), (chunks.code_chunks, plain_code)):
        got = {}
        for r in f(df).orderBy("file", "seq").collect():
            got.setdefault(r["file"], []).append((r["text"], r["line"]))
        for i, t in enumerate(texts):
            assert got.get(f"{i}.{'py' if i % 2 else 'md'}", []) == plain(t), (f.__name__, t[:60])
    both = {r["file"] for r in chunks.chunk_files(df).collect()}
    assert both == {f"{i}.{'py' if i % 2 else 'md'}" for i, t in enumerate(texts) if (plain_code if i % 2 else plain_prose)(t)}


def test_snippet(spark):
    out = local_rows(spark, [("a\r\nb  ",), ("x" * 151,), ("y" * 150,)], "t string").select(tx.snippet("t").alias("s")).collect()
    assert [r["s"] for r in out] == ["a  b", "x" * 150 + "…", "y" * 150]


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.txt": b"x", ".x.txt": b"x", "_x.txt": b"x", "sub/__init__.py": b"x", "node_modules/b.txt": b"x", "sub/.git/c.txt": b"x", "pic.PNG": b"x", ".env": b"x", "sub/.env.local": b"x", "skip/Me/d.txt": b"x", "ok.png.txt": b"x", ".png": b"x", "big.txt": b"b" * 2_000_000, "huge.txt": b"b" * 2_000_001, "bad.txt": b"caf\xe9 \xff ok"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    return str(tmp_path)


def test_scan(spark, tree):
    names = [r[0] for r in files.list_files(tree, ["Skip\\me"])]
    assert names == sorted([".png", ".x.txt", "_x.txt", "a.txt", "bad.txt", "big.txt", "ok.png.txt", "sub/__init__.py"])
    rows = {r["rel"]: r for r in files.scan(spark, tree).collect()}
    assert rows["bad.txt"]["text"] == "caf  ok" and rows["a.txt"]["md5"] == "9dd4e461268c8034f5c8564e155c67a6"
    every = [(r, 1) for r in (".png", "a/b.png", "dist/x.txt", "a/dist", "x.DLL", ".env", "a/.env.local", "..png", "a.b.log")] + [("n.txt", 2_000_001), ("m.txt", 2_000_000)]
    out = local_rows(spark, every, "rel string, size long").select("rel", files.accepted(F.col("rel"), F.col("size")).alias("ok")).collect()
    assert {r["rel"] for r in out if r["ok"]} == {".png", "a/dist", "m.txt", "..png"}
    with pytest.raises(FileNotFoundError):
        files.list_files(tree + "/none")
    with pytest.raises(ValueError):
        files.scan(spark, tree, verify="some")


def test_spans_and_snippets_strip_all_white_space(spark):
    df = spark.createDataFrame([("xx foo bar. foo", "\tfoo bar\n"), ("\t\u3000 line\r\nend\x0b ", "\u00a0end\u2003")], "t string, q string")
    out = df.select(tx.hit_span("t", "q").alias("s"), tx.snippet("t").alias("n")).collect()
    assert [(r["s"]["start"], r["s"]["end"]) for r in out] == [(3, 10), (9, 12)] and out[1]["n"] == "line  end"


def test_sql_of_spans_counts_overlapping_words():
    """The SQL that the driver compares with, on a word that overlaps itself."""
    import duckdb

    from lexispark.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'ntou thathati é heron'), (2, 'none')) v(doc_id, text)")
    assert sorted(con.execute(catalogue.ORACLES["hit_ranges"]).fetchall()) == [(1, 5, 9, "that"), (1, 8, 12, "that"), (1, 16, 21, "heron")]
    assert sorted(con.execute(catalogue.ORACLES["hit_span"]).fetchall()) == [(1, 5, 21), (2, None, None)]
