"""Compare a Spark result with DuckDB on the same parquet tables."""

import math

import duckdb

from plumbline.plans.fixtures import TABLES


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return v


SPARK_KIND = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "double", "float": "float",
              "string": "str", "boolean": "bool", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts"}
DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "double", "FLOAT": "float",
             "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts"}


def compare(df, sql, con):
    """Return a list of problems; empty means equal."""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    problems = []
    if sorted(dcols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(dcols)}"]
    names = sorted(dcols)
    for n, t in df.dtypes:
        a, b = SPARK_KIND.get(t, t), DUCK_KIND.get(dtypes[n], dtypes[n])
        if a != b and not (a.startswith(("array", "struct", "map"))):
            problems.append(f"type of {n}: {a} vs {b}")
    got = sorted([tuple(norm(r[n]) for n in names) for r in df.collect()], key=repr)
    ix = [dcols.index(n) for n in names]
    exp = sorted([tuple(norm(r[i]) for i in ix) for r in want], key=repr)
    if len(got) != len(exp):
        problems.append(f"rows {len(got)} vs {len(exp)}; first got {got[:2]} want {exp[:2]}")
    elif got != exp:
        bad = [(g, e) for g, e in zip(got, exp) if g != e]
        problems.append(f"{len(bad)}/{len(got)} rows differ in {names}; e.g. {bad[0]}")
    return problems
