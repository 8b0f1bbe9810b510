"""Command line: python -m lexispark VERB ..."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.text import SNIPPET
from .index.index import Index
from .log import show
from .sources.local import local_rows

DEFAULT, DENSE = ".lexispark_index", "dense"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lexispark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def located(out: str | None) -> str:
    """The index of the option, else the nearest one in this folder or above it."""
    if out:
        return out
    here = Path.cwd()
    for folder in (here, *here.parents):
        if (folder / DEFAULT / "_log").is_dir():
            return str(folder / DEFAULT)
    raise FileNotFoundError(f"no {DEFAULT} here or above; name one with --out")


def shown(text: str, n: int = SNIPPET) -> str:
    line = text.replace("\r", " ").replace("\n", " ").strip()
    return line if len(line) <= n else line[:n] + "…"


def print_hits(hits: list[dict]) -> None:
    for h in hits:
        print(f"{h['rank']:>3}  {h['score']:.4f}  {h['file']}:{h['line']}\n     {shown(h['text'])}")
    if not hits:
        print("no hits")


def numbers(path: str) -> list:
    """Values of an .npy or a JSON file."""
    if path.endswith(".npy"):
        import numpy as np

        return np.load(path).tolist()
    return json.loads(Path(path).read_text())


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="lexispark", description="lexical retrieval on Spark")
    ap.add_argument("--quiet", action="store_true", help="warnings only on standard error")
    ap.add_argument("--log", help="file that gets progress and warnings too")
    sub = ap.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument("--out", help=f"folder of the index (the nearest {DEFAULT} if not given)")
        return p

    def dense(p: argparse.ArgumentParser) -> None:
        p.add_argument("--dense", action="store_true", help=f"with vectors, kept as the view {DENSE}; needs --model")
        p.add_argument("--model", help="encoder as module:function, from a list of texts to their vectors")

    def tuned(p: argparse.ArgumentParser) -> None:
        p.add_argument("--workers", type=int, default=0, help="accepted; Spark deals out the work")

    p = verb("index", "build an index of a directory")
    p.add_argument("root")
    p.add_argument("--skip", action="append", default=[], help="folder to leave out, relative to the root; may be repeated")
    p.add_argument("--w-cache", action="store_true", help="keep materialised weights with the index")
    dense(p)
    tuned(p)
    p.add_argument("--stream", choices=["off", "on", "ids"], default="off", help="accepted; texts are never held in memory here")
    p = verb("query", "best chunks for a query")
    p.add_argument("q")
    p.add_argument("--k", type=int, default=10)
    dense(p)
    p = verb("update", "bring the index in line with its directory")
    p.add_argument("root", nargs="?")
    p.add_argument("--verify", default="auto", choices=["auto", "full", "stat"])
    dense(p)
    tuned(p)
    p = verb("browse", "chunks in order, or the files")
    p.add_argument("--file")
    p.add_argument("--page", type=int, default=0)
    p.add_argument("--n", type=int, default=20)
    p.add_argument("--files", action="store_true")
    p = verb("repl", "queries from standard input, a line each")
    p.add_argument("--k", type=int, default=10)
    verb("info", "numbers, settings, segments, views")
    p = verb("params", "show or change k1 and b")
    p.add_argument("--k1", type=float)
    p.add_argument("--b", type=float)
    p.add_argument("--save", action="store_true", help="keep them in the index")
    p = verb("config", "show or change settings of this process")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    p = verb("segment", "list, mount, unmount or fold segments")
    p.add_argument("action", choices=["list", "mount", "unmount", "fold"])
    p.add_argument("--tag")
    p.add_argument("--dir", help="folder that write_segment has made")
    p = verb("view", "list, attach, detach or fuse dense views")
    p.add_argument("action", choices=["list", "attach", "detach", "fuse"])
    p.add_argument("q", nargs="?")
    p.add_argument("--name")
    p.add_argument("--vectors", help="attach: .npy or JSON, a vector a row")
    p.add_argument("--rows", help="attach: .npy or JSON, row numbers (all live rows in order if not given)")
    p.add_argument("--replace", action="store_true")
    p.add_argument("--qvec", help="fuse: .npy or JSON")
    p.add_argument("--alpha", type=float, default=0.35)
    p.add_argument("--k", type=int, default=10)
    verb("compact", "fold all segments and rewrite the tables")
    p = verb("explain", "parts of a hit's score")
    p.add_argument("q")
    p.add_argument("--k", type=int, default=1, help="rank of the hit")
    p.add_argument("--docid", help="part of a file name")
    p.add_argument("--json", action="store_true")
    p = verb("diagnose", "why a query finds what it finds")
    p.add_argument("q")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--json", action="store_true")
    return ap


def encoder(model: str | None):
    """The function that `--model` names."""
    if not model or ":" not in model:
        raise ValueError("--dense needs --model module:function")
    module, _, name = model.partition(":")
    return getattr(importlib.import_module(module), name)


def encode(index: Index, a) -> None:
    """Vectors of all live chunks, made anew and saved."""
    index.encode_view(DENSE, encoder(a.model), {"model": a.model}, replace=True)
    index.save_view(DENSE)


def view(index: Index, a) -> object:
    for v in index.load_views():
        if not v["attached"]:
            print(f"view {v['name']}: {v['reason']}", file=sys.stderr)
    if a.action == "list":
        return index.views()
    if a.name is None:
        raise ValueError("--name is needed")
    if a.action == "attach":
        vectors = numbers(a.vectors)
        rows = numbers(a.rows) if a.rows else [r["row"] for r in index.chunks().select("row").orderBy("row").limit(len(vectors)).collect()]
        if len(rows) != len(vectors):
            raise ValueError(f"{len(vectors)} vectors and {len(rows)} rows")
        made = index.attach_view(a.name, local_rows(index.spark, zip(rows, vectors, strict=True), "row long, vec array<float>"), replace=a.replace)
        index.save_view(a.name)
        return made
    if a.action == "detach":
        index.drop_view(a.name)
        return {"detached": a.name}
    print_hits(index.fuse(a.q or "", a.name, numbers(a.qvec), a.k, a.alpha))
    return None


def run(a, spark: SparkSession) -> object:
    """Carry out a verb; what isn't printed is returned."""
    if a.verb == "index":
        index = Index.build(spark, a.root, a.out or DEFAULT, a.skip)
        if a.w_cache:
            index.config(w_cache=True)
            index.weights()
        if a.dense:
            encode(index, a)
        return index.stats()
    index = Index(spark, located(a.out))
    if a.verb == "query" and a.dense:
        index.load_views()
        found = index.search_dense(a.q, DENSE, [float(x) for x in encoder(a.model)([a.q])[0]], a.k)
        print_hits(found)
    elif a.verb == "query":
        print_hits(index.search(a.q, a.k))
    elif a.verb == "update":
        done = index.update(a.root, a.verify)
        if a.dense:
            encode(index, a)
        return done
    elif a.verb == "browse":
        if a.files:
            return index.files()
        rows, total = index.browse(a.page, a.n, a.file)
        for r in rows:
            print(f"{r['row']:>6}  {r['file']}:{r['line']}  {shown(r['text'])}")
        print(f"page {a.page} of {total} chunks")
    elif a.verb == "repl":
        for line in sys.stdin:
            if line.strip():
                print_hits(index.search(line.strip(), a.k))
    elif a.verb == "info":
        return index.stats() | {"mounted": index.segments(), "views": index.load_views()}
    elif a.verb == "params":
        return index.tune(a.k1, a.b, a.save)
    elif a.verb == "config":
        return index.config(**{k: value(v) for k, v in (x.split("=", 1) for x in a.set)})
    elif a.verb == "segment":
        if a.action == "list":
            return index.remount()
        if a.action == "mount":
            return index.mount(a.dir, a.tag)
        return index.unmount(a.tag) if a.action == "unmount" else index.fold(a.tag)
    elif a.verb == "view":
        return view(index, a)
    elif a.verb == "compact":
        return index.compact()
    elif a.verb == "explain":
        rows = index.explain(a.q, a.docid, a.k)
        if a.json or not rows:
            return rows or index.diagnose(a.q, a.k)
        for r in rows:
            print(f"{r['term']:<24} {r['status']:<6} tf {r['tf']:>4}  df {r['df']:>7}  idf {r['idf']:.4f}  {r['contribution']:.4f}")
    elif a.verb == "diagnose":
        found = index.diagnose(a.q, a.k)
        if a.json:
            return found
        print(found["status"])
        for m in found["messages"]:
            print(f"{m['level']}: {m['what']} {m['evidence']} {m['action']}")
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    show(not a.quiet, a.log)
    try:
        found = run(a, spark or session())
    except (FileNotFoundError, KeyError, ValueError, RuntimeError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    if found is not None:
        print(json.dumps(found, ensure_ascii=False, indent=1, default=str))
    return 0
