"""Inverted-file routing: cells by nearest centroid, probes by budget, and a zone map of an attribute.

Centroids are at most ``MAX_CELLS`` rows; they go to the executors as one matrix and assignment is a
matrix product over Arrow batches. Fitting is a distributed Lloyd iteration: sums of the members of
each cell are formed where the vectors are, and only centroids reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcavec.functions import vector as V
from arcavec.operators.quantize import unit

MIN_CELLS, MAX_CELLS = 64, 65_536
SAMPLE_ROWS = 50_000
#: Ranges of ids that are counted to find ranks.
RANGES = 65_536
DIGITS = 6


def cells_for(n: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, round(n**0.5)))


def seeds(vectors: DataFrame, n_cells: int) -> np.ndarray:
    """Vectors evenly spaced in the order of ids, the same in each run.

    Ids are counted by ``RANGES`` equal ranges of values, which tells in which range each wanted rank
    is and how far; only ids of those ranges are ranked.
    """
    ids = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"))
    low, high, n = ids.agg(F.min("vec_id"), F.max("vec_id"), F.count("*")).first()
    if not n:
        return np.zeros((0, 0))
    n_cells = max(1, min(n_cells, n))
    step = max(1, n // n_cells)
    wanted = sorted({(c * step) % n for c in range(n_cells)})
    width = (high - low) // RANGES + 1
    ranged = ids.withColumn("range", F.floor((F.col("vec_id") - F.lit(low)) / F.lit(width)).cast("int"))
    counts = np.zeros(RANGES + 1, np.int64)
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect():  # at most RANGES + 1 rows
        counts[r.range] = r.n
    ends = np.cumsum(counts)
    of = np.searchsorted(ends, wanted, side="right")
    picks = vectors.sparkSession.createDataFrame([(int(r), int(w - (ends[r] - counts[r])), w) for r, w in zip(of, wanted, strict=True)], "range int, at int, rank long")
    picks = F.broadcast(picks)  # at most MAX_CELLS rows
    near = ranged.join(picks.select("range").distinct(), "range", "left_semi")
    placed = near.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("vec_id")) - 1)
    chosen = F.broadcast(placed.join(picks, ["range", "at"]).select("vec_id", "rank"))
    rows = vectors.where("embedding is not null").join(chosen, "vec_id").groupBy("rank").agg(F.first("embedding").alias("embedding")).orderBy("rank").collect()
    return np.array([r.embedding for r in rows], np.float64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with cell and sim: the centroid of the greatest cosine, rounded, the first of equals."""
    shared = vectors.sparkSession.sparkContext.broadcast(unit(centroids))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "cell int, sim double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit(batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1))
                sim = np.round(rows @ shared.value.T, DIGITS)
                cell = sim.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(sim[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "sim"])

    return vectors.where("embedding is not null").mapInArrow(run, schema)


def fit(vectors: DataFrame, n_cells: int, rounds: int = 5, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids by Lloyd iterations with cosine assignment on at most about ``sample_rows`` rows; means aren't normalised again."""
    vectors = vectors.where("embedding is not null")
    n = vectors.count()
    part = vectors if n <= sample_rows else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(sample_rows / n * (1 << 20)))
    centroids = seeds(vectors, n_cells)
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(shared.value.shape), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = batch.column(0).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                    cell = (unit(rows) @ unit(shared.value).T).argmax(axis=1)
                    np.add.at(total, cell, rows)
                    count += np.bincount(cell, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(count[some])], names=["cell", "total", "n"])

        partial = part.select("embedding").mapInArrow(sums, "cell int, total array<double>, n long")
        dims = partial.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        for r in dims.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).toLocalIterator():
            centroids[r.cell] = [e.x for e in r.v]
    return centroids


def rank_cells(cells: DataFrame, query: Sequence[float]) -> DataFrame:
    """``cells`` (cell, centroid, n) with sim, and before: the members of nearer cells. There are at most ``MAX_CELLS`` rows."""
    sim = F.round(V.cosine(F.col("centroid"), V.literal(query)), DIGITS)
    order = Window.orderBy(F.desc("sim"), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("sim", sim).withColumn("before", F.sum("n").over(order) - F.col("n"))


def probe(assigned: DataFrame, ids: DataFrame, centroids: DataFrame, query: Sequence[float], budget: int) -> DataFrame:
    """vec_id of a shortlist of ``ids``: whole cells of matches, nearest first, until the budget is reached; all of them if they fit it."""
    mine = assigned.join(ids.select("vec_id"), "vec_id", "left_semi").select("vec_id", "cell")
    counts = mine.groupBy("cell").agg(F.count("*").alias("n"))
    chosen = rank_cells(centroids.join(counts, "cell"), query).where(F.col("before") < budget).select("cell")
    return mine.join(F.broadcast(chosen), "cell", "left_semi").select("vec_id")  # at most MAX_CELLS rows


def zone_map(rows: DataFrame, attribute: str = "attr") -> DataFrame:
    """(cell, low, high, n) of an attribute."""
    return rows.groupBy("cell").agg(F.min(attribute).alias("low"), F.max(attribute).alias("high"), F.count("*").alias("n"))


def estimated_members(zones: DataFrame, low: int, high: int) -> DataFrame:
    """``zones`` with estimate: all members of cells inside the range, a proportional share, rounded down, of those across its edge."""
    overlap = F.least(F.lit(high), F.col("high")) - F.greatest(F.lit(low), F.col("low")) + 1
    share = F.expr("n") * overlap
    return zones.withColumn(
        "estimate",
        F.when((F.col("high") < low) | (F.col("low") > high), F.lit(0)).when((F.col("low") >= low) & (F.col("high") <= high), F.col("n"))
        .otherwise(F.floor(share / (F.col("high") - F.col("low") + 1))).cast("long"),
    )


def probe_range(assigned: DataFrame, centroids: DataFrame, query: Sequence[float], low: int, high: int, budget: int, attribute: str = "attr") -> DataFrame:
    """vec_id of rows in the range, from the nearest cells that overlap it until the budget is reached; other cells aren't read where ``assigned`` is partitioned by cell."""
    inside = assigned.where(F.col(attribute).between(low, high))
    counts = inside.groupBy("cell").agg(F.count("*").alias("n"))
    chosen = rank_cells(centroids.join(counts, "cell"), query).where(F.col("before") < budget).select("cell")
    return inside.join(F.broadcast(chosen), "cell", "left_semi").select("vec_id")  # at most MAX_CELLS rows


def centroid_table(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")
