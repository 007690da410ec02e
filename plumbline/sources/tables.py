"""Reading tables: by extension, all-text, typed, across schema versions; numeric shadows of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordered import melt

# A token no file holds: with it set, an empty field is the only source of null.
IMPOSSIBLE = "\u0001never\u0001"


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension: parquet, csv, tsv or jsonl/json. Delimited files come in as text."""
    low = path.rstrip("/").lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".jsonl", ".ndjson", ".json")):
        return spark.read.json(path)
    if low.endswith((".tsv", ".tab")):
        return read_text_table(spark, path, "\t")
    if low.endswith((".csv", ".txt")):
        return read_text_table(spark, path, ",")
    raise ValueError(f"no reader for {path}")


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every column as text with no missing-value vocabulary: an empty field is ''."""
    head = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    d = (spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", IMPOSSIBLE)
         .option("multiLine", False).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))
    return d.fillna("")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", strict: bool = True) -> DataFrame:
    """Explicit types per column. Strict reading stops at a bad row; otherwise it is kept in `_corrupt`."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    if strict:
        d = r.schema(schema).option("mode", "FAILFAST").csv(path)
    else:
        full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
        d = r.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    # always true; it makes every field be parsed, so a bad one is seen even if nobody selects its column
    return d.where(F.xxhash64(*schema.names) >= F.lit(-(2**63)))


def shadow_columns(df: DataFrame, min_parse: float = 0.95) -> list[str]:
    """Text columns whose non-blank values are overwhelmingly numbers and never start with 0 and a digit."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not cols:
        return []
    full = {c: F.trim(c) != "" for c in cols}
    s = df.agg(*[x for c in cols for x in (
        F.count_if(full[c]).alias(f"n_{c}"), F.count_if(full[c] & F.trim(c).try_cast("double").isNotNull()).alias(f"p_{c}"),
        F.count_if(full[c] & F.col(c).rlike("^0[0-9]")).alias(f"z_{c}"))]).first()
    return [c for c in cols if s[f"n_{c}"] and s[f"p_{c}"] / s[f"n_{c}"] >= min_parse and not s[f"z_{c}"]]


def numeric_shadow(df: DataFrame, min_parse: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The table with numeric text columns as doubles, and the values that did not parse: `(column, value, n)`."""
    cols = shadow_columns(df, min_parse)
    out = df.withColumns({c: F.trim(c).try_cast("double") for c in cols}) if cols else df
    if not cols:
        return out, df.sparkSession.createDataFrame([], "column string, value string, n long")
    lost = melt(df, [], cols, "string").where((F.trim("value") != "") & F.trim("value").try_cast("double").isNull())
    return out, lost.groupBy("column", "value").agg(F.count("*").alias("n"))


def read_versions(*frames: DataFrame) -> DataFrame:
    """UNION ALL across schema versions; columns a version lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


WIDENINGS = {("int", "bigint"), ("float", "double")}  # fixed values: types that may widen


def evolution_violations(spark: SparkSession, old: T.StructType, new: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Schema changes that would break readers: `(column, problem)`.

    Allowed: a new nullable column, a declared rename, int to long, float to double.
    """
    renames = renames or {}
    was = {renames.get(f.name, f.name): f for f in old}
    rows = []
    for f in new:
        if f.name not in was:
            if not f.nullable:
                rows.append((f.name, "new column is not nullable"))
            continue
        a, b = was[f.name].dataType.simpleString(), f.dataType.simpleString()
        if a != b and (a, b) not in WIDENINGS:
            rows.append((f.name, f"type changed from {a} to {b}"))
        if was[f.name].nullable and not f.nullable:
            rows.append((f.name, "became required"))
    kept = {f.name for f in new}
    rows += [(n, "column dropped") for n in was if n not in kept]
    return spark.createDataFrame(rows, "column string, problem string")


def evolution_report(df: DataFrame, new: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Breaking changes with the number of stored values each would touch."""
    bad = evolution_violations(df.sparkSession, df.schema, new, renames)
    back = {v: k for k, v in (renames or {}).items()}
    rows = [(r["column"], r["problem"], back.get(r["column"], r["column"])) for r in bad.collect()]
    have = [c for _, _, c in rows if c in df.columns]
    n = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in dict.fromkeys(have)]).first()
    return df.sparkSession.createDataFrame([(c, p, n[o] if o in have else 0) for c, p, o in rows], "column string, problem string, n_values long")


def parse_raw(raw: DataFrame, schema: T.StructType | str, body: str = "raw") -> DataFrame:
    """Parse bodies that were landed untouched; `_ok` is false where the body does not fit."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    p = F.from_json(F.col(body), ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("_p", p).select(*raw.columns, "_p.*").withColumn("_ok", F.col("_bad").isNull()).drop("_bad")
