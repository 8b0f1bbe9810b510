"""Comparison of a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _sorted(rows, order) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rows), key=repr)


def difference(frame, con, sql: str) -> str | None:
    """None if both give the same rows under the same names and types, else what differs."""
    got = con.execute(sql)
    names, types = [x[0] for x in got.description], [TYPES.get(str(x[1]), str(x[1])) for x in got.description]
    ours, theirs = sorted(frame.dtypes), sorted(zip(names, types, strict=True))
    if ours != theirs:
        return f"{ours} and {theirs}"
    a = _sorted(frame.collect(), [frame.columns.index(n) for n, _ in ours])
    b = _sorted(got.fetchall(), [names.index(n) for n, _ in ours])
    if a == b:
        return None
    seen_a, seen_b = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only Spark: {[x for x in a if x not in seen_b][:3]}; only SQL: {[x for x in b if x not in seen_a][:3]}"
