"""File trees as tables: listing on the driver (names and stamps only, as Spark's own file index does), contents read and hashed by the executors.

A root without a scheme is a folder that driver and executors share, read by Python. A root with one (hdfs://, s3a://, viewfs://, file:// ...) is listed through Hadoop and read by Spark's `binaryFile` source; names that this
source hides (a leading dot or underscore) are read through Hadoop by the driver, HIDDEN_BYTES at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import cut_lineage
from .hadoop import Files
from .local import local_rows

MAX_BYTES, HIDDEN_BYTES = 2_000_000, 64_000_000
#: Folders, names and extensions that are never indexed (the last folder is this package's own default for an index).
EXCLUDE_DIRS = {".git", ".workbuddy", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", ".next", ".pytest_cache", ".mypy_cache", ".idea", ".vscode", ".idx", ".lexispark_index"}
EXCLUDE_NAMES = {".env", ".env.local"}
EXCLUDE_EXTENSIONS = {".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".zip", ".npz", ".npy", ".log", ".out", ".pyc", ".bin", ".woff", ".woff2", ".exe", ".dll"}
LISTED = "rel string, path string, size long, mtime_ns long"
LEDGER = "rel string, md5 string, size long, mtime_ns long"
VERIFY = ("full", "stat", "auto")


def list_files(root: str, skip_dirs: Iterable[str] = ()) -> list[tuple[str, str, int, int]]:
    """(rel, path, size, mtime_ns) of the files under `root`, by rel. Links are not followed; what can't be read is left out."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    skip = {s.replace("\\", "/").strip("/").casefold() for s in skip_dirs}
    out, todo = [], [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except OSError:
            continue
        for e in entries:
            rel = os.path.relpath(e.path, root).replace(os.sep, "/")
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in EXCLUDE_DIRS and rel.casefold() not in skip:
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    if e.name not in EXCLUDE_NAMES and os.path.splitext(e.name)[1].lower() not in EXCLUDE_EXTENSIONS and s.st_size <= MAX_BYTES:
                        out.append((rel, e.path, s.st_size, s.st_mtime_ns))
            except OSError:
                continue
    return sorted(out)


def accepted(rel: Column, size: Column) -> Column:
    """The rules of `list_files` for a table of names and sizes, such as a listing made elsewhere."""
    parts = F.split(rel, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1))
    return ~F.arrays_overlap(folders, F.array(*(F.lit(d) for d in sorted(EXCLUDE_DIRS)))) & ~name.isin(*sorted(EXCLUDE_NAMES)) & ~extension.isin(*sorted(EXCLUDE_EXTENSIONS)) & (size <= MAX_BYTES)


def has_scheme(root: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", root) is not None


def list_hadoop(spark: SparkSession, root: str, skip_dirs: Iterable[str] = (), left_out: list[str] | None = None) -> list[tuple[str, str, int, int]]:
    """As `list_files`, for any path that Spark can read. Times are in whole milliseconds there. `left_out` gets the names that are not indexed."""
    fs = Files(spark)
    if not fs.is_dir(root):
        raise FileNotFoundError(root)
    skip = {s.replace("\\", "/").strip("/").casefold() for s in skip_dirs}
    out, todo = [], [(root, "")]
    while todo:
        folder, above = todo.pop()
        for name, path, is_dir, size, time in fs.entries(folder):
            rel = f"{above}{name}"
            if is_dir:
                if name not in EXCLUDE_DIRS and rel.casefold() not in skip:
                    todo.append((path, f"{rel}/"))
                elif left_out is not None:
                    left_out.append(rel)
            elif name not in EXCLUDE_NAMES and os.path.splitext(name)[1].lower() not in EXCLUDE_EXTENSIONS and size <= MAX_BYTES:
                out.append((rel, path, size, time * 1_000_000))
            elif left_out is not None:
                left_out.append(rel)
    return sorted(out)


READ = "rel string, size long, mtime_ns long, md5 string, text string"


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore")


def read_files(listed: DataFrame) -> DataFrame:
    """(rel, size, mtime_ns, md5, text) of listed files of a shared folder; invalid UTF-8 bytes are dropped."""

    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    with open(r["path"], "rb") as f:
                        raw = f.read()
                except OSError:
                    continue
                rows.append({"rel": r["rel"], "size": r["size"], "mtime_ns": r["mtime_ns"], "md5": hashlib.md5(raw).hexdigest(), "text": _text(raw)})
            names = [x.split()[0] for x in READ.split(", ")]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return listed.mapInArrow(work, READ)


def read_hadoop(spark: SparkSession, listed: DataFrame, root: str | None = None) -> DataFrame:
    """As `read_files`, through Spark's readers. `root`: the folder whose files are all listed; Spark then finds them itself, as it takes milliseconds of the driver and a task for each path that it is given."""
    name = F.element_at(F.split("rel", "/"), -1)
    hidden = F.startswith(name, F.lit(".")) | F.startswith(name, F.lit("_")) | F.rlike("rel", F.lit("(^|/)[._]"))
    paths = [r["path"] for r in listed.where(~hidden).select("path").collect()]  # names are on the driver already, as in Spark's own file index

    def work(batches):
        for batch in batches:
            raw = [x.as_py() for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([hashlib.md5(x).hexdigest() for x in raw], pa.string()), pa.array([_text(x) for x in raw], pa.string())], ["path", "md5", "text"])

    out = local_rows(spark, [], READ)
    if paths:
        source = spark.read.format("binaryFile")
        held = (source.load(paths) if root is None else source.option("recursiveFileLookup", "true").load(root)).select("path", "content").mapInArrow(work, "path string, md5 string, text string")
        # a path in the listing and the same path from the reader may differ in the slashes behind the scheme
        plain = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]+:)/+", "$1/")
        out = listed.where(~hidden).withColumn("at", plain(F.col("path"))).drop("path").join(held.withColumn("at", plain(F.col("path"))), "at").select("rel", "size", "mtime_ns", "md5", "text")
    fs, rows, size = Files(spark), [], 0
    for r in [*listed.where(hidden).collect(), None]:
        if rows and (r is None or size + r["size"] > HIDDEN_BYTES):
            out = out.unionByName(cut_lineage(local_rows(spark, rows, READ)))
            rows, size = [], 0
        if r is not None:
            raw = fs.bytes_of(r["path"])
            rows.append((r["rel"], r["size"], r["mtime_ns"], hashlib.md5(raw).hexdigest(), _text(raw)))
            size += r["size"]
    return out


def scan(spark: SparkSession, root: str, skip_dirs: Iterable[str] = (), ledger: DataFrame | None = None, verify: str = "full") -> DataFrame:
    """(rel, size, mtime_ns, md5, text); `text` is null where the ledger knows the file unchanged: by its hash, or with verify='stat' by size and time without reading it."""
    if verify not in VERIFY:
        raise ValueError(f"verify must be one of {VERIFY}")
    left_out: list[str] = []
    listed = local_rows(spark, list_hadoop(spark, root, skip_dirs, left_out) if has_scheme(root) else list_files(root, skip_dirs), LISTED)
    read_all = (lambda x: read_hadoop(spark, x)) if has_scheme(root) else read_files
    if ledger is None:
        return read_hadoop(spark, listed, None if left_out else root) if has_scheme(root) else read_files(listed)
    known = ledger.select("rel", F.col("md5").alias("old_md5"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"))
    both = listed.join(known, "rel", "left")
    same = (F.col("old_size") == F.col("size")) & (F.col("old_mtime") == F.col("mtime_ns"))
    trusted = both.where(same) if verify != "full" else both.where("false")
    unread = listed.join(trusted.select("rel"), "rel", "left_anti") if verify != "full" else listed
    read = read_all(unread).join(known.select("rel", "old_md5"), "rel", "left")
    fresh = read.select("rel", "size", "mtime_ns", "md5", F.when(F.col("old_md5") == F.col("md5"), F.lit(None)).otherwise(F.col("text")).alias("text"))
    return fresh.unionByName(trusted.select("rel", "size", "mtime_ns", F.col("old_md5").alias("md5"), F.lit(None).cast("string").alias("text")))


def ledger_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, change): added, removed, changed or unchanged between two ledgers (rel, md5)."""
    a, b = old.select("rel", F.col("md5").alias("old")), new.select("rel", F.col("md5").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "rel", "full_outer").select("rel", change.alias("change"))


def ledger_state(events: DataFrame) -> DataFrame:
    """(rel, md5) after a log of events (seq, rel, md5): the last of each rel holds, a null md5 deletes."""
    last = events.groupBy("rel").agg(F.max_by(F.struct("md5"), "seq").alias("last"))
    return last.select("rel", F.col("last.md5").alias("md5")).where("md5 is not null")
