"""Cosine top-k: exact, filtered, by range, in two stages, over layers, and for many queries at once.

A single query is scored by numpy over Arrow batches in one narrow stage, with a partial top-k in
every task. Many queries go to the executors in blocks of a fixed size, are scored by matrix
products against Arrow batches, and leave each task as k rows a query before anything is shuffled. Scores are rounded to ``DIGITS`` before they are ordered; equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcavec.operators import filters

DIGITS = 6
QUERY_BLOCK = 2048


def rerank_width(k: int) -> int:
    """How many rows of the coarse stage are scored exactly."""
    return max(8 * k, 64)


def vector_of(vectors: DataFrame, vec_id: int) -> list[float] | None:
    """The stored vector of an id."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding) if row else None


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``vectors`` with their score; null vectors are left out, one of another length than the query is an error."""
    q = _unit(np.array([query], np.float64))[0]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "score"), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            if (np.diff(column.offsets.to_numpy()) != len(q)).any():
                raise ValueError(f"a vector has not {len(q)} components")
            score = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 2048):  # a few MB as doubles
                rows = column.slice(lo, 2048).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
                length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                score[lo : lo + 2048] = np.divide(rows @ q, length, out=np.zeros(len(rows)), where=length > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, DIGITS))], names=[*batch.schema.names, "score"])

    return vectors.drop("score").where("embedding is not null").mapInArrow(run, schema)


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "vec_id").limit(max(0, k))


def search(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """(vec_id, score) of the k nearest vectors, of those that satisfy ``where`` if it is given."""
    rows = vectors if where is None else vectors.where(where)
    return top(scored(rows.select("vec_id", "embedding"), query).select("vec_id", "score"), k)


def search_filtered(vectors: DataFrame, payloads: DataFrame, query: Sequence[float], k: int, text: str) -> DataFrame:
    """The k nearest of the vectors whose payload matches a filter."""
    ids = payloads.where(filters.predicate(text, F.col("payload"))).select("vec_id")
    return score_ids(vectors, ids, query, k)


def score_ids(vectors: DataFrame, ids: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest of a list of ids; unknown ids are skipped and repeated ones count once."""
    return search(vectors.join(ids.select("vec_id"), "vec_id", "left_semi"), query, k)


def search_range(vectors: DataFrame, query: Sequence[float], k: int, low: int, high: int, attribute: str = "attr") -> DataFrame:
    """The k nearest of the vectors whose attribute is in a range, bounds included."""
    return search(vectors, query, k, F.col(attribute).between(low, high))


def with_payload(hits: DataFrame, payloads: DataFrame) -> DataFrame:
    """Hits with their payload, null if they have none; the few hits meet the payloads after the limit."""
    return hits.join(payloads.select("vec_id", "payload"), "vec_id", "left")


def two_stage(vectors: DataFrame, proxy: Column, query: Sequence[float], k: int, budget: int | None = None) -> DataFrame:
    """The exact top k of the ``budget`` rows of the greatest proxy score, by default ``rerank_width(k)``."""
    coarse = vectors.withColumn("_proxy", proxy).orderBy(F.desc("_proxy"), "vec_id").limit(max(k, rerank_width(k) if budget is None else budget))
    return search(coarse, query, k)


def blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of queries (query_id, embedding), one block on the driver at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.embedding)
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the k greatest scores of each row, equal ones by id."""
    width = min(k, scores.shape[1])
    least = -np.partition(-scores, width - 1, axis=1)[:, width - 1 : width]
    row, col = np.nonzero(scores >= least)  # more than k where scores tie
    by = np.lexsort((ids[row, col], -scores[row, col], row))
    first = np.searchsorted(row, np.arange(len(scores)))
    take = by[first[:, None] + np.arange(width)]
    return ids[row[take], col[take]], scores[row[take], col[take]]


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        # the best k of each query over all batches of the task: that is all that is shuffled
        kept_ids, kept = np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            rows = _unit(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))
            parts = []
            for lo in range(0, len(query_ids), 256):
                part = slice(lo, lo + 256)
                scores = np.concatenate([kept[part], np.round(queries[part] @ rows.T, DIGITS)], axis=1)
                every = np.concatenate([kept_ids[part], np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)
                parts.append(_best(every, scores, k))
            kept_ids, kept = (np.concatenate(x) for x in zip(*parts, strict=True))
        if kept.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, kept.shape[1])), pa.array(kept_ids.ravel()), pa.array(kept.ravel())], names=["query_id", "vec_id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of every query (query_id, embedding). All vectors have one length."""
    sc, parts = vectors.sparkSession.sparkContext, []
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    for ids, matrix in blocks(queries, block):
        parts.append(rows.mapInArrow(_nearest(sc.broadcast((ids, _unit(matrix))), max(1, k)), "query_id long, vec_id long, score double"))
    if not parts or k < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank long")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, on: Sequence[str] = ("query_id", "vec_id")) -> float:
    """The share of the exact hits that were found."""
    n = exact.count()
    return found.join(exact, list(on), "left_semi").count() / n if n else 1.0
