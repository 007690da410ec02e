"""Allow and block entries for URLs, matched by a broadcast trie of reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pack, q

RULES_PER_TRIE = 100_000  # entries in one broadcast trie; longer lists are matched block by block
FOUND = "host_labels int, path_length int, block int, rule string"


def build_trie(entries: Iterable[tuple[str, str, str]]) -> dict:
    """Entries `(host, path, allow or block)` as nested dicts: reversed host labels, then path segments.

    An entry's last, possibly partial segment is kept as a tail that the rest of the path has to start with.
    """
    root: dict = {}
    for host, path, verdict in entries:
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"not an entry: {(host, path, verdict)}")
        node, labels = root, host.translate(LOWER_AZ).split(".")
        for label in reversed(labels):
            node = node.setdefault(label, {})
        *whole, tail = (path or "").split("/")
        node = node.setdefault(PATHS, {})
        for segment in whole:
            node = node.setdefault(segment, {})
        old = node.setdefault(TAILS, {}).get(tail)
        if old is None or verdict == "block":  # the same entry twice: block holds
            node[TAILS][tail] = (len(labels), len(path or ""), int(verdict == "block"), host + (path or ""))
        node[SIZES] = sorted({len(t) for t in node[TAILS]}, reverse=True)
    return root


def longest_entry(root: dict, host: str, path: str) -> tuple | None:
    """The entry that fits with most host labels, then the longest path."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at, below = 0, node.get(PATHS)
        longest = None
        while below is not None:
            for n in below.get(SIZES, ()):
                hit = below[TAILS].get(path[at:at + n]) if at + n <= len(path) else None
                if hit:
                    longest = hit
                    break
            cut = path.find("/", at)
            if cut < 0:
                break
            below, at = below.get(path[at:cut]), cut + 1
        best = longest or best
    return best


PATHS, TAILS, SIZES = ("paths",), ("tails",), ("sizes",)  # keys that no label or segment can equal
LOWER_AZ = {i: i + 32 for i in range(65, 91)}


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _blocks(rules: DataFrame | Sequence[tuple[str, str, str]], size: int) -> Iterator[list]:
    rows = iter(rules.select("host", "path", "verdict").toLocalIterator() if isinstance(rules, DataFrame) else rules)
    while block := [tuple(r) for r in islice(rows, size)]:
        yield block


def _finder(trie):
    """The trie's answers for a batch of hosts and paths."""
    @F.pandas_udf(FOUND)
    def find(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        none = (None,) * 4
        return pd.DataFrame([longest_entry(trie.value, h, p) or none for h, p in zip(host, path)],
                            columns=["host_labels", "path_length", "block", "rule"], dtype=object)
    return find


def judge_urls(df: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow",
               block_size: int = RULES_PER_TRIE) -> DataFrame:
    """Add `host`, `path`, `rule` and `verdict` to every row.

    `rules` has `(host, path, allow|block)`. An entry fits its host and all subdomains
    when the path starts with the entry's. Most host labels win, then the longest path,
    then block. `rule` is the entry as `host` + `path`, null when none fits; `verdict`
    is then `default`. Null urls and urls without `://` have an empty host and path.
    Entries are broadcast `block_size` at a time, so a list of any length works: each
    block adds one pass over the urls and no shuffle. Repeated rows are judged alike,
    an empty table gives an empty result, and input columns named like an output are
    replaced.
    """
    sc = df.sparkSession.sparkContext
    out = ["host", "path", "rule", "verdict"]
    whole, columns = pack(df, out)
    d = df.select(whole, host_of(q(url)).alias("host"), path_of(q(url)).alias("path"))
    found = [_finder(sc.broadcast(build_trie(block)))("host", "path") for block in _blocks(rules, block_size)]
    if not found:
        return d.select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    names = [f"__f{i}" for i in range(len(found))]
    d = d.withColumns(dict(zip(names, found)))
    known = [F.when(F.col(n)["rule"].isNotNull(), F.col(n)) for n in names]
    best = F.greatest(*known) if len(known) > 1 else known[0]
    d = d.withColumn("__best", best)
    return d.select(*columns, "host", "path", F.col("__best.rule").alias("rule"),
                    F.when(F.col("__best.rule").isNull(), default).when(F.col("__best.block") == 1, "block").otherwise("allow").alias("verdict"))
