"""Chunks: the retrieval units of files and long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

MIN_CHARS, MAX_CHARS, CODE_LINES = 20, 1200, 80
#: Extensions of files that are cut by lines.
CODE_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".sh", ".bat", ".ps1", ".yaml", ".yml", ".toml")
#: Line ends, and the places behind them.
END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
LINES = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}])"


def lines(text: Column | str) -> Column:
    """The lines of a text with their ends; null: none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), LINES), lambda x: x != "")


def _numbered(chunks: DataFrame, key: str) -> DataFrame:
    """One row a chunk. Outer, as else the planner would test the array's size in a filter of its own, which works everything out once more."""
    return chunks.select(key, F.posexplode_outer("chunks").alias("seq", "c")).where("seq is not null").select(key, "seq", "c.line", "c.text")


def prose_chunks(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, seq, line, text): paragraphs between blank lines, stripped, from 20 characters on; longer ones than 1,200 in windows of 1,200, the rest whatever its length.

    `line` is the first line of the paragraph, from 1. A row's lines stay in that row: no shuffle.
    """
    every = files.select(F.col(key), lines(text).alias("lines"))
    marked = every.select(key, "lines", F.transform("lines", lambda x: stripped(x) != "").alias("full"), F.size("lines").alias("n"))
    # places where a paragraph begins and the places behind its end
    i = F.sequence(F.lit(0), F.col("n"))
    begins = F.filter(i, lambda i: F.get("full", i) & (i.eqNullSafe(F.lit(0)) | ~F.coalesce(F.get("full", i - 1), F.lit(False))))
    ends = F.filter(i, lambda i: F.get("full", i) & ~F.coalesce(F.get("full", i + 1), F.lit(False)))
    placed = marked.select(key, "lines", begins.alias("begins"), ends.alias("ends"))
    bodies = F.zip_with("begins", "ends", lambda a, b: F.struct((a + 1).alias("line"), stripped(F.array_join(F.slice("lines", a + 1, b - a + 1), "")).alias("body")))
    kept = placed.select(key, F.filter(bodies, lambda p: F.length(p["body"]) >= MIN_CHARS).alias("bodies"))

    def windows(p: Column) -> Column:
        every = F.sequence(F.lit(0), F.floor((F.length(p["body"]) - 1) / MAX_CHARS).cast("int"))
        return F.transform(every, lambda w: F.struct(p["line"].alias("line"), F.substring(p["body"], w * MAX_CHARS + 1, F.lit(MAX_CHARS)).alias("text")))

    return _numbered(kept.select(key, F.flatten(F.transform("bodies", windows)).alias("chunks")), key)


def code_chunks(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, seq, line, text): windows of 80 lines, stripped, from 20 characters on."""
    every = files.select(F.col(key), lines(text).alias("lines")).select(key, "lines", F.size("lines").alias("n"))
    ends = f"({END})$"

    def block(b: Column) -> Column:
        own = F.transform(F.slice("lines", b * CODE_LINES + 1, F.lit(CODE_LINES)), lambda x: F.regexp_replace(x, ends, ""))
        return F.struct((b * CODE_LINES + 1).alias("line"), stripped(F.array_join(own, "\n")).alias("text"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CODE_LINES).cast("int")), block)
    return _numbered(every.select(key, F.filter(blocks, lambda c: F.length(c["text"]) >= MIN_CHARS).alias("chunks")), key)


def is_code(name) -> F.Column:
    return F.lower(F.regexp_extract(name, r"[^./\\][^/\\]*?(\.[^./\\]+)$", 1)).isin(*CODE_EXTENSIONS)


def chunk_files(files: DataFrame, key: str = "file", text: str = "text", name: str | None = None) -> DataFrame:
    """Code files in windows of lines, all others in paragraphs. `name`: the column with the file's name where that isn't the key."""
    code = is_code(F.col(name or key))
    return code_chunks(files.where(code), key, text).unionByName(prose_chunks(files.where(~code), key, text))
