"""Stored codes of an index and searches through them, by kind.

A table of codes is made once and kept beside the vectors; a search reads the codes, scores them with
numpy over Arrow batches, and joins only the best rows to their vectors for exact scores. Proxy
scores grow with closeness and are rounded to ``PROXY_DIGITS`` before they are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcavec.operators import quantize as Q, search
from arcavec.operators.controller import EVERY, FAST, FULL

PROXY_DIGITS = 9
SEED, ROUNDS = 0x42, 3
MODES = ("bitplane", "asymmetric", "popcount", "hybrid")
#: How many times the re-ranked rows a hybrid search takes by popcount.
WIDER = 4
SHADOW = 64
# Margin of the bound, quantiles and limits of the calibration, and its least number of rows.
MARGIN = 0.02
LOW_SHARE, HIGH_SHARE, LEAST_SCALE, MOST_SCALE, CALIBRATION_ROWS = 0.1587, 0.8413, 0.25, 4.0, 256


@dataclass(frozen=True)
class Codes:
    """Codes (vec_id, code, scale) of one kind and what reads them."""

    kind: str
    dim: int
    table: DataFrame
    scale: float = 1.0
    book: np.ndarray | None = None
    rounds: int = ROUNDS
    seed: int | None = SEED
    spread: np.ndarray | None = field(default=None)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/codes")
        flat = lambda x: None if x is None else [float(v) for v in x.ravel()]
        row = (self.kind, self.dim, self.scale, self.rounds, self.seed, None if self.book is None else list(self.book.shape), flat(self.book), flat(self.spread))
        self.table.sparkSession.createDataFrame([row], "kind string, dim int, scale double, rounds int, seed long, shape array<int>, book array<double>, spread array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/reader")


def open_codes(spark: SparkSession, path: str) -> Codes:
    r = spark.read.parquet(f"{path}/reader").first()
    book = None if r.book is None else np.array(r.book).reshape(r.shape)
    return Codes(r.kind, r.dim, spark.read.parquet(f"{path}/codes"), r.scale, book, r.rounds, r.seed, None if r.spread is None else np.array(r.spread))


def _unit_rows(batch: pa.RecordBatch) -> np.ndarray:
    return Q.unit(batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def unit_scale(vectors: DataFrame) -> float:
    """The greatest absolute component of all unit vectors over 127; 1 if there is none."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.abs(_unit_rows(b)).max() for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([max(found, default=0.0)])], names=["m"])

    top = vectors.select("embedding").where("embedding is not null").mapInArrow(most, "m double").agg(F.max("m").alias("m")).first().m
    return top / 127 if top else 1.0


def int8_of(rows: np.ndarray, scale: float) -> np.ndarray:
    x = rows / scale
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int8)


def int8_levels(bits: int) -> tuple[np.ndarray, float]:
    """The levels of a rotated code as 8-bit integers and their scale."""
    levels = np.array(Q.LEVELS[bits])
    scale = float(np.abs(levels).max() / 127)
    return int8_of(levels, scale), scale


def dense_rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix from Gaussian rows, each made orthogonal to those above it."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)).T)
    return (q * np.sign(np.diag(r))).T


def sign_vectors(vectors: DataFrame, rounds: int = ROUNDS, seed: int | None = SEED) -> DataFrame:
    """(vec_id, embedding) of the signs of rotated unit vectors, as +1 and -1: a metric that ranks as their Hamming distance, to build graphs on."""
    turned = Q.rotated(vectors, rounds, seed, normalise=True)
    return turned.select("vec_id", F.transform("rotated", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0).cast("float")).alias("embedding"))


def calibration(vectors: DataFrame, rounds: int = ROUNDS, seed: int | None = SEED) -> np.ndarray | None:
    """How much wider than expected each rotated component spreads, by its quantiles; 0 for one that never moves, null below ``CALIBRATION_ROWS`` rows."""
    turned = Q.rotated(vectors, rounds, seed, normalise=True).select(F.posexplode("rotated").alias("i", "x"))
    found = turned.groupBy("i").agg(F.count("*").alias("n"), F.percentile_approx("x", [LOW_SHARE, HIGH_SHARE], 10_000).alias("q")).orderBy("i").collect()
    if not found or found[0].n < CALIBRATION_ROWS:
        return None
    width = np.array([r.q[1] - r.q[0] for r in found])
    return np.where(width < 1e-6, 0.0, np.clip(width * np.sqrt(len(found)) / 2, LEAST_SCALE, MOST_SCALE))


def build(vectors: DataFrame, kind: str, parts: int = 16, rounds: int = ROUNDS, seed: int | None = SEED, book: np.ndarray | None = None) -> Codes:
    """Codes of all vectors; null vectors have none. ``parts`` and ``book`` are for product codes, whose codebook is trained where none is given."""
    rows = vectors.select("vec_id", "embedding").where("embedding is not null")
    head = rows.select(F.size("embedding").alias("n")).first()
    dim = head.n if head else 1
    Q.check_kind(kind, dim, parts)
    if kind.startswith("tq"):
        return Codes(kind, dim, Q.turbo_codes(rows, int(kind[2:]), rounds, seed), rounds=rounds, seed=seed)
    if kind == "pq":
        book = Q.train_pq(rows, parts) if book is None else book
        return Codes(kind, dim, Q.pq_codes(rows, book).withColumn("scale", F.lit(1.0)), book=book)
    scale = unit_scale(rows) if kind == "int8" else 1.0
    pack = {"f32": lambda x: x.astype("<f4"), "int8": lambda x: int8_of(x, scale), "binary": lambda x: np.packbits(x > 0, axis=1, bitorder="little")}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _bytes(pack(_unit_rows(batch))), pa.array(np.ones(batch.num_rows))], names=["vec_id", "code", "scale"])

    return Codes(kind, dim, rows.mapInArrow(run, "vec_id long, code binary, scale double"), scale)


def _levels(raw: np.ndarray, bits: int, width: int) -> np.ndarray:
    per = 8 // bits
    return ((raw[:, :, None] >> (np.arange(per) * bits).astype(np.uint8)) & (2**bits - 1)).reshape(len(raw), -1)[:, :width]


def proxy_scores(codes: Codes, raw: np.ndarray, scale: np.ndarray, query: np.ndarray, mode: str) -> np.ndarray:
    """The proxy of each code (rows of bytes) with a query."""
    unit = Q.unit(query[None].astype(np.float64))[0]
    if codes.kind == "f32":
        return raw.view("<f4").astype(np.float64) @ unit
    if codes.kind == "int8":
        return (raw.view(np.int8).astype(np.int64) @ int8_of(unit, codes.scale).astype(np.int64)).astype(np.float64)
    if codes.kind == "binary":
        return -np.bitwise_count(raw ^ np.packbits(unit > 0, bitorder="little")).sum(axis=1).astype(np.float64)
    if codes.kind == "pq":
        table = np.stack([((b - x) ** 2).sum(axis=1) for b, x in zip(codes.book, np.split(unit, len(codes.book)), strict=True)])
        return -table[np.arange(raw.shape[1]), raw].sum(axis=1)
    bits = int(codes.kind[2:])
    width = Q.WIDE if bits == 1 and codes.dim < Q.NARROW else codes.dim
    if bits > 1 or mode == "asymmetric":
        return Q.turbo_scores(unit, _levels(raw, bits, width), scale, bits, codes.rounds, codes.seed)
    turned = Q.rotate(np.concatenate([unit, np.zeros(width - len(unit))])[None], codes.rounds, codes.seed)[0]
    if mode in ("popcount", "hybrid"):
        return -np.bitwise_count(raw ^ np.packbits(turned > 0, bitorder="little")).sum(axis=1).astype(np.float64)
    low, high, top = turned.min(), turned.max(), 15
    step = (high - low) / top if high > low else 0.0
    level = np.floor((turned - low) / step + 0.5).astype(np.int64) if step else np.zeros(width, np.int64)
    planes = [np.packbits(level >> p & 1, bitorder="little") for p in range(4)]
    weighted = sum((np.bitwise_count(raw & plane).sum(axis=1).astype(np.int64) << p for p, plane in enumerate(planes)), np.zeros(len(raw), np.int64))
    ones = np.bitwise_count(raw).sum(axis=1).astype(np.int64)
    inner = 2 * (low * ones + step * weighted) - (low * width + step * level.sum())
    return scale * inner * Q.LEVELS[1][1] / np.sqrt(width)


def proxies(codes: Codes, query: Sequence[float], mode: str = "bitplane", table: DataFrame | None = None) -> DataFrame:
    """(vec_id, proxy, scale) of all codes, or of those in ``table``."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    q, reader = np.array(query, np.float64), replace(codes, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                scale = batch.column("scale").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.round(proxy_scores(reader, raw, scale, q, mode), PROXY_DIGITS)), pa.array(scale)], names=["vec_id", "proxy", "scale"])

    return (codes.table if table is None else table).select("vec_id", "code", "scale").mapInArrow(run, "vec_id long, proxy double, scale double")


def coarse(codes: Codes, query: Sequence[float], budget: int, mode: str = "bitplane") -> DataFrame:
    """(vec_id, proxy, scale) of the ``budget`` rows of the greatest proxy. A hybrid search takes more by popcount and orders them by the asymmetric proxy."""
    order = (F.desc("proxy"), "vec_id")
    if codes.kind == "tq1" and mode == "hybrid":
        wide = proxies(codes, query, "popcount").orderBy(*order).limit(WIDER * budget).select("vec_id")
        near = codes.table.join(F.broadcast(wide), "vec_id", "left_semi")  # WIDER * budget ids
        return proxies(codes, query, "asymmetric", near).orderBy(*order).limit(budget)
    return proxies(codes, query, mode).orderBy(*order).limit(budget)


def search_codes(codes: Codes, vectors: DataFrame, query: Sequence[float], k: int, budget: int | None = None, mode: str = "bitplane") -> DataFrame:
    """Top k by the index's kind: exact for f32, else by proxy and then exactly among the best."""
    if codes.kind == "f32":
        return search.search(vectors, query, k)
    best = coarse(codes, query, max(k, search.rerank_width(k) if budget is None else budget), mode)
    return search.score_ids(vectors, best, query, k)


def search_layers(codes: Codes, layers: DataFrame, query: Sequence[float], k: int, budget: int | None = None) -> DataFrame:
    """Top k over (vec_id, layer, embedding): base and runs share one budget of re-ranked rows, the delta is scored whole."""
    indexed = codes.table.join(layers.where("layer <> 'delta'").select("vec_id"), "vec_id", "left_semi")
    best = proxies(codes, query, table=indexed).orderBy(F.desc("proxy"), "vec_id").limit(search.rerank_width(k) if budget is None else budget).select("vec_id")
    return search.score_ids(layers, best.unionByName(layers.where("layer = 'delta'").select("vec_id")), query, k)


def search_bounded(codes: Codes, vectors: DataFrame, query: Sequence[float], k: int, budget: int | None = None, margin: float = MARGIN) -> DataFrame:
    """Top k of rotated codes; a row is only scored exactly where its estimated cosine and a bound on its error reach the k-th exact cosine of the k best by proxy."""
    best = coarse(codes, query, max(k, search.rerank_width(k) if budget is None else budget), "asymmetric").collect()  # at most the budget
    sure = search.score_ids(vectors, codes.table.sparkSession.createDataFrame([(r.vec_id,) for r in best[:k]] or [], "vec_id long"), query, k).collect()
    least = sure[-1].score if len(sure) >= k else -2.0
    quality = lambda r: min(1.0, 1.0 / max(r.scale, 1e-10))
    stay = [r.vec_id for n, r in enumerate(best) if n < k or r.proxy + margin * np.sqrt(1 - quality(r) ** 2) >= least]
    return search.score_ids(vectors, codes.table.sparkSession.createDataFrame([(i,) for i in stay], "vec_id long"), query, k)


def search_adaptive(codes: Codes, vectors: DataFrame, query: Sequence[float], k: int, index: int, mode: str = FAST) -> tuple[DataFrame, float | None]:
    """(top k in the mode in force, the agreement of both proxies where this query, by its number, measures it). Agreements are samples of ``controller_modes`` against a full share of 1."""
    found = search_codes(codes, vectors, query, k, mode=mode)
    if index % EVERY or k < 1:
        return found, None
    both = [{r.vec_id for r in search_codes(codes, vectors, query, k, SHADOW, m).collect()} for m in (FAST, FULL)]
    return found, len(both[0] & both[1]) / k


def memory_bytes(codes: Codes) -> DataFrame:
    """(kind, rows, bytes) of the codes as they are stored, scales included where the kind has them."""
    own = F.octet_length("code") + (4 if codes.kind.startswith("tq") else 0)
    return codes.table.agg(F.count("*").alias("rows"), F.sum(own).cast("long").alias("bytes")).select(F.lit(codes.kind).alias("kind"), "rows", "bytes")
