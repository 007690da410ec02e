"""Exact vector search: top-k by cosine, Euclidean distance or dot product."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import fetch_small

MAX_TOP_K = 100
MAX_QUERIES = 1_000
METRICS = {"cosine": True, "euclidean": False, "dot-product": True}  # True: higher is better


def _scores(base: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """One row per query, one column per base vector."""
    if metric == "euclidean":
        # differences, not the expanded square, so near neighbours keep their digits
        return np.stack([np.sqrt(((base - q) ** 2).sum(axis=1)) for q in queries])
    s = queries @ base.T
    if metric == "cosine":
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(base, axis=1)[None, :]
        s = np.divide(s, size, out=np.full_like(s, np.nan), where=size > 0)
    return s


def top_k(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, metric: str = "cosine",
          min_score: float | None = None, drop_self: bool = False) -> DataFrame:
    """The `k` best rows per query: `(query_id, <key>, score, rank)`, ties by key.

    Queries are a size-checked batch shipped with the job; the base is read once
    in Arrow batches. Each batch keeps its own best `k` per query, so only those
    rows are shuffled. A vector of another length than the queries' fails the job; a
    null vector has no score.
    """
    if k > MAX_TOP_K:
        raise ValueError(f"k may be at most {MAX_TOP_K}")
    up = METRICS[metric]
    rows = fetch_small(queries.select(F.col(key).alias("k"), F.col(vector).alias("v")), MAX_QUERIES)
    if rows is None:
        raise ValueError(f"send at most {MAX_QUERIES} queries per batch")
    qid = [r["k"] for r in rows]
    qv = np.array([r["v"] for r in rows], dtype=float)
    kind = base.schema[key].dataType.simpleString()

    def best(batches):
        for pdf in batches:
            if not len(pdf) or not len(qid):
                continue
            odd = pdf["v"].map(len) != dim
            if odd.any():
                raise ValueError(f"{int(odd.sum())} vectors of another length than {dim}, the first with key {pdf['k'][odd].iloc[0]}")
            ids = pdf["k"].to_numpy()
            s = _scores(np.stack(pdf["v"].to_numpy()).astype(float), qv, metric)
            out = []
            for i, q in enumerate(qid):
                row = s[i]
                ok = ~np.isnan(row)
                if drop_self:
                    ok &= ids != q
                if min_score is not None:
                    ok &= (row >= min_score) if up else (row <= min_score)
                cand = np.flatnonzero(ok)
                if not len(cand):
                    continue
                rank_by = -row[cand] if up else row[cand]
                if len(cand) > k:  # keep ties at the boundary, then settle them by key
                    edge = np.partition(rank_by, k - 1)[k - 1]
                    near = rank_by <= edge
                    cand, rank_by = cand[near], rank_by[near]
                cand = cand[np.lexsort((ids[cand], rank_by))[:k]]
                out.append(pd.DataFrame({"query_id": q, key: ids[cand], "score": row[cand]}))
            if out:
                yield pd.concat(out)

    dim = qv.shape[1] if len(qid) else 0
    part = base.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(
        best, f"query_id {kind}, `{key}` {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if up else F.asc("score"), key)
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_by_id(base: DataFrame, ids: Sequence[int], key: str, vector: str, **kw) -> DataFrame:
    """Neighbours of stored vectors."""
    return top_k(base, base.where(F.col(key).isin(list(ids))), key, vector, **kw)


def search(base: DataFrame, queries: DataFrame, key: str, vector: str, min_score: float = 0.3, max_results: int = 10) -> DataFrame:
    """Cosine search with a score threshold and a result limit."""
    return top_k(base, queries, key, vector, max_results, "cosine", min_score)


def describe_index(base: DataFrame, vector: str) -> DataFrame:
    """Count, dimensions and whether every vector has them."""
    a = base.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("dimensions"), F.max(F.size(vector)).alias("_hi"))
    return a.select("n", "dimensions", F.when(F.col("dimensions") == F.col("_hi"), "pass").otherwise("fail").alias("status"))


def get_by_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids, key, "left_semi")


def delete_by_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids, key, "left_anti")
