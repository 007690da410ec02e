"""Scalar expressions shared by operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def measure_state(value: Column, observed: Column) -> Column:
    """Three states that keep an unmeasured row from reading as zero."""
    return (F.when(~F.coalesce(observed, F.lit(False)) | value.isNull(), "not_measured")
            .when(value == 0, "measured_zero").otherwise("measured_positive"))


def stable_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """Bucket in [0, buckets) from the md5 of the key, the same on every run and engine."""
    text = F.concat(F.lit(salt), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def stable_uniform(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the md5 of the key, on a grid of 2^-52."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)


# What counts as a number token, and the year or date tokens left out.
NUMBER_TOKEN = r"-?\d[\d,]*(?:\.\d+)?|-?\.\d+"
CALENDAR_TOKEN = r"^(?:19|20)\d{2}$|^(?:19|20)\d{6}$"

# Markup removed before numbers are read, in this order.
MARKUP = [
    r"\\(?:label|ref|cref|Cref|cite[a-z]*|input|include|includegraphics)\s*\{[^}]*\}",
    r"(?m)(?<!\\)%.*$",
    r"\\[a-zA-Z]+\d*",
    r"(?s)```.*?```",
]


def strip_markup(text: Column) -> Column:
    """Text without reference commands, comments, macros and fenced code."""
    for pattern in MARKUP:
        text = F.regexp_replace(text, pattern, " ")
    return text


def number_tokens(text: Column, min_abs: float = 2.0, precise_only: bool = False) -> Column:
    """Distinct numbers in the text as an array of doubles.

    Years, compact dates and small whole numbers are left out. A hyphen directly
    before digits is read as a minus sign, so a range yields a negative number.
    """
    raw = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER_TOKEN})"), F.lit(1)),
                      lambda t: F.struct(t.alias("t"), F.replace(t, F.lit(","), F.lit("")).alias("c")))
    val = F.transform(raw, lambda r: F.struct(r["t"].alias("t"), r["c"].alias("c"), r["c"].try_cast("double").alias("v")))

    def keep(r):
        ok = r["v"].isNotNull() & ~r["c"].rlike(CALENDAR_TOKEN) & ~((F.abs(r["v"]) < min_abs) & (r["v"] == F.floor(r["v"])))
        return ok & (r["t"].contains(".") | (F.abs(r["v"]) >= 100)) if precise_only else ok

    return F.array_distinct(F.transform(F.filter(val, keep), lambda r: r["v"]))


def all_numbers(text: Column) -> Column:
    """Every number in an artifact, with no exclusions."""
    vals = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER_TOKEN})"), F.lit(1)),
                       lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    return F.array_distinct(F.filter(vals, lambda v: v.isNotNull()))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no built-in for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def strict_key(text: Column) -> Column:
    """Trim and collapse whitespace only."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def loose_key(text: Column, variants: dict[str, str] | None = None, unicode: bool = True) -> Column:
    """Case, whitespace, punctuation and Unicode forms removed; whole-word variants mapped."""
    t = F.lower(nfkc(text) if unicode else text)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[\p{Punct}]+", " "), r"\s+", " "))
    for old, new in (variants or {}).items():
        t = F.regexp_replace(t, rf"\b{old}\b", new)
    return t


def redact_key(value: Column) -> Column:
    """One-way digest of an identifier."""
    return F.sha2(value.cast("string"), 256)
