"""Dense views: vectors beside the index, fused with its scores where they cover a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, FLOOR = 0.35, 1e-12


class ViewError(ValueError):
    """A view that doesn't fit the index."""


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column | str) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(FLOOR))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def attach(vectors: DataFrame, rows: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(row, vec, norm) of a view; raises ViewError for no rows, uneven lengths, repeated, tombstoned or unknown rows. All checks run in one pass over (row, size)."""
    shape = vectors.groupBy("row").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"))
    known = rows.select("row").withColumn("known", F.lit(True))
    flags = shape.join(known, "row", "left")
    flags = flags.join(dead.select("row").distinct().withColumn("gone", F.lit(True)), "row", "left") if dead is not None else flags.withColumn("gone", F.lit(None))
    got = flags.agg(F.count("*").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("gone")).alias("gone")).first()
    for bad, what in ((got["rows"] == 0, "a view needs a row at least"), (got["lo"] != got["hi"] or got["hi"] == 0, "vectors differ in length"), (got["twice"], "repeated rows"), (got["unknown"], "rows outside the index"), (got["gone"], "tombstoned rows")):
        if bad:
            raise ViewError(what)
    return vectors.select("row", "vec", length("vec").alias("norm"))


def cosine(view: DataFrame, query: list[float]) -> DataFrame:
    """(row, cos); a query of another dimension raises ViewError."""
    first = view.select(F.size("vec").alias("n")).first()
    if first is not None and first["n"] != len(query):
        raise ViewError(f"the view has dimension {first['n']}, the query {len(query)}")
    q = vector(query)
    return view.select("row", (dot("vec", q) / (F.col("norm") * length(q))).alias("cos"))


def fuse(scored: DataFrame, cosines: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(row, base, cos, fused): base + alpha * cos * span for covered rows, cos cut to 0..1, span the largest base or 1. `scored`: (row, score) of all live rows."""
    top = scored.agg(F.max("score")).first()[0]
    span = float(top) if top and top > 0 else 1.0
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cos")))
    joined = scored.join(cosines, "row", "left")
    return joined.select("row", F.col("score").alias("base"), "cos", F.when(F.col("cos").isNull(), F.col("score")).otherwise(F.col("score") + F.lit(alpha) * near * F.lit(span)).alias("fused"))


def dense_rerank(scored: DataFrame, view: DataFrame, query: list[float], k: int, share: float = 0.6) -> DataFrame:
    """(row, score, fused): the best max(10 k, 100) rows by score, ordered anew by `share` of their scaled dot product and the rest of their scaled score."""
    candidates = scored.orderBy(F.desc("score"), "row").limit(max(10 * k, 100)).where("score > 0")
    q = vector(query)
    joined = candidates.join(view, "row", "left").withColumn("d", F.coalesce(dot("vec", q) / (F.col("norm") * length(q)), F.lit(0.0)))
    top = joined.agg(F.max("d").alias("d"), F.max("score").alias("s")).first()
    d, s = max(top["d"] or 0.0, 1e-9), max(top["s"] or 0.0, 1e-9)
    fused = F.lit(share) * F.col("d") / F.lit(d) + F.lit(1.0 - share) * F.col("score") / F.lit(s)
    return joined.select("row", "score", fused.alias("fused")).orderBy(F.desc("fused"), "row").limit(max(k, 0))


def coverage(rows: DataFrame, dead: DataFrame, view: DataFrame) -> DataFrame:
    """One row: n_live, covered_live, covered_total."""
    flags = rows.select("row").join(view.select("row").distinct().withColumn("covered", F.lit(True)), "row", "left").join(dead.select("row").distinct().withColumn("gone", F.lit(True)), "row", "left")
    alive = F.col("gone").isNull()
    return flags.agg(F.count_if(alive).alias("n_live"), F.count_if(alive & F.col("covered").isNotNull()).alias("covered_live"), F.count_if(F.col("covered").isNotNull()).alias("covered_total"))


def covered(rows: DataFrame, view: DataFrame) -> DataFrame:
    """(row, covered): whether the view has a vector of each row."""
    return rows.select("row").join(view.select("row").distinct().withColumn("covered", F.lit(True)), "row", "left").na.fill(False, ["covered"])


def by_docid(saved: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, vec) of a saved view (docid, vec), the first chunk of a docid, and its docids that no chunk has."""
    first = chunks.groupBy("docid").agg(F.min("row").alias("row"))
    return saved.join(first, "docid").select("row", "vec"), saved.join(first, "docid", "left_anti").select("docid")
