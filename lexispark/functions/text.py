"""Token, span and snippet expressions. All are column expressions that stay in the JVM; `custom_tokens` is the one door for a Python tokenizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, as a class of a regular expression.
BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Han, kana and Hangul code points that are tokens of their own.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
UNIT = rf"[{CJK}]|[\p{{L}}\p{{N}}_]+"
#: The same for texts without such code points. Letters that are named one by one are looked up in a bit set, which is faster than a property.
WORD = r"[abcdefghijklmnopqrstuvwxyz0123456789_\p{L}\p{N}]++"
#: Separators of query words, a fixed value: white space (of all scripts) and CJK or Latin punctuation.
QUERY_SPLIT = r"(?U)[\s，。；：、！？（）「」『』《》〈〉【】〔〕(){}\[\]'\"“”‘’·…—\-~,.;:!?\\|/*+]+"
SNIPPET = 150


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(as_column(x), f"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column | str) -> Column:
    """Tokens of a text, lower-cased: words, and for CJK each character and its bigram with the CJK character before it.

    Bigrams reach over punctuation, as only units count; a word that begins with another letter takes the CJK characters behind it along. Null: no tokens.
    """
    low = F.lower(F.coalesce(as_column(text), F.lit("")))
    foreign = (F.octet_length(low) > F.length(low)) & low.rlike(f"[{CJK}]")
    units = F.regexp_extract_all(low, F.lit(UNIT), F.lit(0))
    single = f"^[{CJK}]$"
    before = F.concat(F.array(F.lit("")), units)  # one longer than `units`, so the last pair has no unit

    def pair(u: Column, p: Column) -> Column:
        both = F.when(u.rlike(single) & p.rlike(single), F.array(u, F.concat(p, u))).otherwise(F.array(u))
        return F.when(u.isNull(), F.array().cast("array<string>")).otherwise(both)

    return F.when(foreign, F.flatten(F.zip_with(units, before, pair))).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def series_udf(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """Column function of a function of a pandas Series. pandas is loaded here and not with the package, as Python workers load the package too."""
    import pandas as pd

    def run(values):
        return f(values)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def custom_tokens(tokenize: Callable[[str], list[str]]) -> Callable[[Column | str], Column]:
    """Column function of a Python tokenizer, run on Arrow batches."""

    run = series_udf(lambda texts: texts.map(lambda t: list(tokenize(t or ""))), "array<string>")

    return lambda text: run(as_column(text))


def tokenizer_status() -> dict[str, object]:
    """Which word tokenizer serves `word_tokens`, and whether it is the fallback."""
    try:
        import jieba  # noqa: F401
    except ImportError:
        return {"name": "units", "degraded": True}
    return {"name": "jieba", "degraded": False}


def word_tokens(text: Column | str) -> Column:
    """Dictionary segmentation where a segmenter is installed (lower-cased pieces, punctuation kept, white space dropped), else `tokens`."""
    if tokenizer_status()["degraded"]:
        return tokens(text)

    def cut(t: str) -> list[str]:
        import jieba

        return [w.lower() for w in jieba.cut(t) if w.strip()]

    return custom_tokens(cut)(text)


def query_tokens(query: Column | str) -> Column:
    """Words of a query as they stand, split at white space and punctuation."""
    return F.filter(F.split(as_column(query), QUERY_SPLIT), lambda x: x != "")


def occurrences(text: Column, tok: Column) -> Column:
    """Places (from 0) of a word in a text, overlapping ones too: the text is split in front of each, so long texts are read once."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(tok, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.transform(F.split(text, quoted), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    ends = F.aggregate(pieces, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["places"], F.array(s["at"] + n)).alias("places")))["places"]
    inner = F.filter(ends, lambda i: (i > 0) & (i < F.length(text)))
    return F.concat(F.when(F.startswith(text, tok), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), inner)


def hit_ranges(text: Column | str, words: Column | str) -> Column:
    """All occurrences (overlapping ones too) of the words in a text: array of (start, end, tok), by start, longer ones first. Case counts; a word that is asked twice is found twice."""
    text, words = as_column(text), as_column(words)

    def of(tok: Column) -> Column:
        return F.transform(occurrences(text, tok), lambda i: F.struct(i.alias("start"), (-(i + F.length(tok))).alias("back"), tok.alias("tok")))

    found = F.array_sort(F.flatten(F.transform(F.filter(words, lambda w: w != ""), of)))
    return F.transform(found, lambda r: F.struct(r["start"].alias("start"), (-r["back"]).alias("end"), r["tok"].alias("tok")))


def hit_span(text: Column | str, query: Column | str) -> Column:
    """(start, end) of the first place of the whole query, else from the first to the last place of any of its words, else null."""
    text, query = as_column(text), stripped(query)
    words = F.array_distinct(query_tokens(query))
    places = F.transform(F.filter(words, lambda w: F.call_function("locate", w, text) > 0), lambda w: F.struct(
        (F.call_function("locate", w, text) - 1).alias("start"),
        (F.length(text) - F.call_function("locate", F.reverse(w), F.reverse(text)) + 1).alias("end"),
    ))
    whole = F.call_function("locate", query, text)
    start = F.array_min(F.transform(places, lambda p: p["start"]))
    end = F.array_max(F.transform(places, lambda p: p["end"]))
    none = F.lit(None).cast("struct<start:int,end:int>")
    return (
        F.when(query.isNull() | (query == "") | text.isNull(), none)
        .when(whole > 0, F.struct((whole - 1).cast("int").alias("start"), (whole - 1 + F.length(query)).cast("int").alias("end")))
        .when(F.size(places) > 0, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        .otherwise(none)
    )


def snippet(text: Column | str, n: int = SNIPPET) -> Column:
    """First n characters on one line, with an ellipsis if more follow."""
    line = stripped(F.translate(as_column(text), "\r\n", "  "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def content_md5(content: Column | str) -> Column:
    return F.md5(as_column(content))
