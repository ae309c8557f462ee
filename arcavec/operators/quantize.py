"""Quantised codes and their proxy scores: int8, signs, product quantisation, rotated 1, 2 and 4 bit codes.

Codes are columns. Simple ones are Catalyst expressions; rotations and codebooks are numpy over Arrow
batches. Calibration is one aggregation; codebooks and query tables have fixed sizes and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcavec.functions import vector as V

# Lloyd-Max levels of the standard normal distribution for 1, 2 and 4 bits, and the bounds between them.
LEVELS = {
    1: [-0.7978846, 0.7978846],
    2: [-1.5104, -0.4528, 0.4528, 1.5104],
    4: [-2.7326, -2.0691, -1.6180, -1.2562, -0.9424, -0.6568, -0.3881, -0.1284, 0.1284, 0.3881, 0.6568, 0.9424, 1.2562, 1.6180, 2.0691, 2.7326],
}
BOUNDS = {
    1: [0.0],
    2: [-0.9816, 0.0, 0.9816],
    4: [-2.4009, -1.8436, -1.4371, -1.0993, -0.7996, -0.5225, -0.2583, 0.0, 0.2583, 0.5225, 0.7996, 1.0993, 1.4371, 1.8436, 2.4009],
}
#: Vectors of fewer components are padded to WIDE for 1-bit codes.
NARROW, WIDE = 256, 512

KINDS = ("f32", "int8", "binary", "tq1", "tq2", "tq4", "pq")


def check_kind(kind: str, dim: int, m: int = 1) -> None:
    """Raises where vectors of ``dim`` components can't be packed."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    if dim < 1:
        raise ValueError("a vector needs a component")
    if kind.startswith("tq") and dim % (8 // int(kind[2:])):
        raise ValueError(f"{dim} components don't fill bytes of {kind}")
    if kind == "pq" and dim % m:
        raise ValueError(f"{dim} components don't split into {m} parts")


def code_bytes(kind: str, dim: int, m: int = 128) -> int:
    """Bytes of one row's code."""
    wide = WIDE if kind == "tq1" and dim < NARROW else dim
    return {"f32": 4 * dim, "int8": dim, "binary": -(-dim // 8), "tq1": wide // 8 + 4, "tq2": dim // 4 + 4, "tq4": dim // 2 + 4, "pq": m}[kind]


def int8_scale(vectors: DataFrame) -> float:
    """The greatest absolute component over 127, as a 32-bit float; 1 if all are 0."""
    most = vectors.agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("m")).first().m
    return float(np.float32(float(most) / 127)) if most else 1.0


def int8_proxy(query: Sequence[float], scale: float) -> Column:
    """The integer dot product of a row's code with the query's."""
    s = F.lit(scale)
    return V.int_dot(V.int8_code(F.col("embedding"), s), V.int8_code(V.literal(query), s))


def binary_proxy(query: Sequence[float]) -> Column:
    """Minus the number of signs that differ."""
    dim = len(query)
    return -V.hamming(V.sign_words(F.col("embedding"), dim), V.sign_words(V.literal(query), dim))


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    out, h = rows.astype(np.float64), 1
    n = out.shape[1]
    while h < n:
        pairs = out.reshape(len(out), n // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        h *= 2
    return out


def rotate(rows: np.ndarray, rounds: int = 1, seed: int | None = None) -> np.ndarray:
    """An orthogonal rotation: rounds of sign flips (none without a seed) and Walsh-Hadamard transforms of the largest power-of-two blocks."""
    n = rows.shape[1]
    block = n & -n
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (rounds, n)) if seed is not None else np.ones((rounds, n))
    for s in signs:
        rows = walsh_hadamard((rows * s).reshape(-1, block)).reshape(-1, n) / np.sqrt(block)
    return rows


def _rows(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def unit(rows: np.ndarray) -> np.ndarray:
    n = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)


def rotated(vectors: DataFrame, rounds: int = 1, seed: int | None = None, normalise: bool = False) -> DataFrame:
    """(vec_id, rotated array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch)
                out = rotate(unit(rows) if normalise else rows, rounds, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "rotated"])

    return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "vec_id long, rotated array<double>")


def turbo_encode(rows: np.ndarray, bits: int, rounds: int = 3, seed: int | None = 0x42) -> tuple[np.ndarray, np.ndarray]:
    """(level of each rotated component, scale of each row): unit rows are rotated and cut at the Lloyd-Max bounds; the scale makes the code's inner product with the row right."""
    dim = rows.shape[1]
    if bits == 1 and dim < NARROW:
        rows = np.concatenate([rows, np.zeros((len(rows), WIDE - dim))], axis=1)
    length = np.sqrt((rows * rows).sum(axis=1))
    turned = rotate(unit(rows), rounds, seed)
    root = np.sqrt(turned.shape[1])
    code = np.searchsorted(np.array(BOUNDS[bits]) / root, turned, side="left").astype(np.uint8)
    inner = np.maximum((turned * (np.array(LEVELS[bits])[code] / root)).sum(axis=1), 1e-10)
    return code, length / inner


def turbo_scores(query: Sequence[float], code: np.ndarray, scale: np.ndarray, bits: int, rounds: int = 3, seed: int | None = 0x42) -> np.ndarray:
    """Estimated inner products of the query with encoded rows."""
    q = np.array([query], np.float64)
    if q.shape[1] < code.shape[1]:
        q = np.concatenate([q, np.zeros((1, code.shape[1] - q.shape[1]))], axis=1)
    q = rotate(unit(q), rounds, seed)[0]
    return scale * ((np.array(LEVELS[bits])[code] / np.sqrt(code.shape[1])) @ q)


def turbo_codes(vectors: DataFrame, bits: int, rounds: int = 3, seed: int | None = 0x42) -> DataFrame:
    """(vec_id, code binary of packed levels, scale double); null vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, scale = turbo_encode(_rows(batch), bits, rounds, seed)
                per = 8 // bits
                packed = (code.reshape(len(code), -1, per) << (np.arange(per) * bits).astype(np.uint8)).sum(axis=2).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(scale)], names=["vec_id", "code", "scale"])

    return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "vec_id long, code binary, scale double")


def turbo_search(codes: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, bits: int, budget: int | None = None, rounds: int = 3, seed: int | None = 0x42) -> DataFrame:
    """Top k: codes are scanned, the best are joined to their vectors and scored exactly."""
    from arcavec.operators import search

    width = WIDE if bits == 1 and len(query) < NARROW else len(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                per = 8 // bits
                code = ((packed[:, :, None] >> (np.arange(per) * bits).astype(np.uint8)) & (2**bits - 1)).reshape(batch.num_rows, width)
                scores = turbo_scores(query, code, batch.column("scale").to_numpy(), bits, rounds, seed)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(scores)], names=["vec_id", "proxy"])

    coarse = codes.mapInArrow(run, "vec_id long, proxy double").orderBy(F.desc("proxy"), "vec_id").limit(max(k, search.rerank_width(k) if budget is None else budget))
    return search.score_ids(vectors, coarse, query, k)


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids under squared distance; a centroid without rows is moved to a random row."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centroid(rows, centroids)
        for c in range(len(centroids)):
            own = rows[near == c]
            centroids[c] = own.mean(axis=0) if len(own) else rows[rng.integers(len(rows))]
    return centroids


def nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = ((rows[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2) if rows.size * len(centroids) < 1 << 24 else (centroids**2).sum(axis=1)[None, :] - 2 * rows @ centroids.T
    return d.argmin(axis=1)


def train_pq(vectors: DataFrame, m: int, k: int = 256, sample_rows: int = 50_000, rounds: int = 12) -> np.ndarray:
    """Codebooks (m, k, dim / m) of unit vectors, trained on at most about ``sample_rows`` rows that a hash of the id picks."""
    n = vectors.count()
    part = vectors if n <= sample_rows else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(sample_rows / n * (1 << 20)))
    rows = unit(np.array([r.embedding for r in part.select("embedding").collect()], np.float64))
    return np.stack([kmeans(x, k, rounds, s) for s, x in enumerate(np.split(rows, m, axis=1))])


def pq_codes(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(vec_id, code binary): for each part of the unit vector the nearest centroid, the first of equals."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if batch.num_rows:
                parts = np.split(unit(_rows(batch)), len(book), axis=1)
                code = np.stack([nearest_centroid(x, b) for x, b in zip(parts, book, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in code], pa.binary())], names=["vec_id", "code"])

    return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "vec_id long, code binary")


def pq_distances(codes: DataFrame, codebook: np.ndarray, query: Sequence[float]) -> DataFrame:
    """(vec_id, distance): squared distances summed from one table of the query's distances to all centroids."""
    q = np.split(unit(np.array([query], np.float64))[0], len(codebook))
    table = np.stack([((b - x) ** 2).sum(axis=1) for b, x in zip(codebook, q, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(table[np.arange(code.shape[1]), code].sum(axis=1))], names=["vec_id", "distance"])

    return codes.mapInArrow(run, "vec_id long, distance double")


def query_planes(query: Sequence[float], bits: int = 4) -> tuple[list[list[int]], list[int]]:
    """(planes of 64-bit words, level of each component): components on a scale of 2**bits levels from least to greatest, one word list for each bit."""
    q = np.array(query, np.float64)
    low, high = q.min(), q.max()
    top = (1 << bits) - 1
    level = np.floor((q - low) / (high - low) * top + 0.5).astype(np.int64) if high > low else np.zeros(len(q), np.int64)
    planes = []
    for p in range(bits):
        words = []
        for lo in range(0, len(q), 64):
            w = sum(int(x >> p & 1) << i for i, x in enumerate(level[lo : lo + 64]))
            words.append(w - (1 << 64) if w >> 63 else w)
        planes.append(words)
    return planes, level.tolist()


def bitplane_score(words: Sequence[Column], planes: Sequence[Sequence[int]]) -> Column:
    """The sum over planes of 2**p times the bits that plane and code share."""
    total = F.lit(0).cast("long")
    for p, plane in enumerate(planes):
        for w, x in zip(words, plane, strict=True):
            total = total + F.bit_count(w.bitwiseAND(F.lit(x).cast("long"))).cast("long") * (1 << p)
    return total
