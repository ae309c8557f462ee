"""Decisions that need the domain: which way a search goes. Everything below them is Catalyst's."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcavec.operators import codes, ivf, search

SCAN_ROWS = 12_288
SHORTLIST = 4_096
WIDE_RANGE = 4_096
IVF_ROWS = 50_000


@dataclass(frozen=True)
class Router:
    """An assigned table (vec_id, cell, attr) and its centroids."""

    assigned: DataFrame
    centroids: DataFrame


def filtered(vectors: DataFrame, ids: DataFrame, query: Sequence[float], k: int, stored: codes.Codes, router: Router | None = None, budget: int | None = None, scan_rows: int = SCAN_ROWS, shortlist: int | None = SHORTLIST) -> DataFrame:
    """Top k of a set of ids: few are scanned by code and scored again, more than ``scan_rows`` first pass the router, which leaves ``shortlist`` of them or, where that is None, all."""
    if router is not None and shortlist is not None and ids.limit(scan_rows + 1).count() > scan_rows:
        ids = ivf.probe(router.assigned, ids, router.centroids, query, shortlist)
    mine = replace(stored, table=stored.table.join(ids.select("vec_id"), "vec_id", "left_semi"))
    return codes.search_codes(mine, vectors, query, k, budget)


def ranged(vectors: DataFrame, query: Sequence[float], k: int, low: int, high: int, router: Router | None = None, attribute: str = "attr", wide: int = WIDE_RANGE, shortlist: int | None = SHORTLIST) -> DataFrame:
    """Top k in an attribute range: by the zone map's estimate wide ranges probe cells for ``shortlist`` rows, narrow ones, or all where that is None, are filtered and scored."""
    if router is not None and shortlist is not None:
        zones = ivf.estimated_members(ivf.zone_map(router.assigned, attribute), low, high)
        if (zones.agg(F.sum("estimate").alias("n")).first().n or 0) >= wide:
            ids = ivf.probe_range(router.assigned, router.centroids, query, low, high, max(shortlist, search.rerank_width(k)), attribute)
            return search.score_ids(vectors, ids, query, k)
    return search.search_range(vectors, query, k, low, high, attribute)


def wants_router(n: int) -> bool:
    return n >= IVF_ROWS


def build_router(vectors: DataFrame, rounds: int = 5, cells: int | None = None) -> Router:
    """Fits cells on a sample and assigns all rows; write ``assigned`` partitioned by cell to have cells pruned at the scan."""
    centroids: np.ndarray = ivf.fit(vectors, cells or ivf.cells_for(vectors.count()), rounds)
    return Router(ivf.assign(vectors, centroids), ivf.centroid_table(vectors, centroids))


def save_router(router: Router, path: str) -> None:
    """Writes a router: rows by cell, so that a probe reads its cells only, and the centroids."""
    router.assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/assigned")
    router.centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def open_router(spark: SparkSession, path: str) -> Router:
    return Router(spark.read.parquet(f"{path}/assigned"), spark.read.parquet(f"{path}/centroids"))
