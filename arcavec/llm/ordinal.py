"""Cumulative-link ordinal regression on sparse hashed features, shared by toxicity and quality.

P(grade <= k) is the logistic function of threshold k less the row's score; the weights of the
score are the same for all thresholds and the thresholds are in order. A row's features are the
distinct hashes, of ``FEATURE_BITS`` bits, of its words, of the beginnings of its longer words and,
where asked for, of the shapes of its words, so the length of a text gives no feature more weight.

Fitting takes about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their key (all when there
are fewer). Features that ``MIN_ROWS`` rows or more hold, and whose mean grade is ``MIN_Z`` standard
errors or more from the overall mean, enter a lasso whose penalty is ``MIN_Z`` standard errors of
each feature's gradient, so a feature gets a weight only for what no other explains; those with a
weight are fitted once more with a light ridge. The weights, at most ``MAX_FEATURES``, are broadcast;
scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K
from arcavec.llm.decontaminate import WORD
from arcavec.llm.language_id import hash_sample, row_sums

FEATURE_BITS = 22
SAMPLE_ROWS = 20_000
MIN_ROWS = 5
MIN_Z = 4.0
MAX_FEATURES = 1 << 14
#: Bytes of the beginnings of longer words that are features beside the whole words.
STEMS = (4, 5)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes by class, for shapes: a small letter, A capital, 0 digit, e beyond ASCII, others themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 101
_CLASS[_SPACE] = 32


def features(data: np.ndarray, offsets: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every word and shape; rows ascend within each kind, repeats are kept."""
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offsets, WORD)
    prefix, of = K.prefix_hash(low), np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    out, row = [word := K.slice_hash(prefix, starts, ends)], [of]
    for k in STEMS:
        long = ends - starts > k
        out.append(K.slice_hash(prefix, starts[long], starts[long] + k) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
        row.append(of[long])
    if shapes:
        kind = _CLASS[data]
        first = K.row_starts(offsets, len(kind))
        new = np.ones(len(kind), bool)  # the first byte of a run of one class
        new[1:] = kind[1:] != kind[:-1]
        new |= first[:-1]
        at = np.flatnonzero(new)
        kept, begins = kind[at], np.searchsorted(at, offsets)
        starts, ends, rows = K.words(kept, begins, ~_SPACE)
        h = K.slice_hash(K.prefix_hash(kept), starts, ends) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        share = _levels(word, of, kept, begins)
        out += [h, share[0]]
        row += [np.repeat(np.arange(len(offsets) - 1), np.diff(rows)), share[1]]
    return np.concatenate(out) >> np.uint64(64 - FEATURE_BITS), np.concatenate(row)


def _levels(word: np.ndarray, of: np.ndarray, kept: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features for the share, in eighths, of repeated words and of runs of digits, capitals, symbols and bars in each row."""
    n = len(begins) - 1
    total = np.maximum(np.diff(begins), 1)
    again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    shares = [np.bincount(of[1:][again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)]
    shares += [row_sums(marked.astype(np.float64), begins) / total for marked in (kept == 48, kept == 65, (kept < 48) & (kept != 32), kept == 124)]
    out = [K.mix((8 * x).astype(np.uint64) + np.uint64(1000 * (k + 1))) for k, x in enumerate(shares)]
    return np.concatenate(out), np.tile(np.arange(n), len(out))


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (feature, row) pairs, by row."""
    both = np.unique(row.astype(np.uint64) << np.uint64(FEATURE_BITS) | feature)
    return (both & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), (both >> np.uint64(FEATURE_BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Model:
    """Sorted features with their weights, and the thresholds between the grades."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, thresholds: np.ndarray, shapes: bool):
        self.feature, self.weight, self.thresholds, self.shapes = feature, weight, thresholds, shapes

    def table(self) -> np.ndarray:
        out = np.zeros(1 << FEATURE_BITS, np.float32)
        out[self.feature] = self.weight
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        feature, row = features(data, offsets, self.shapes)
        weighty = table[feature.astype(np.int64)] != 0
        feature, row = distinct(feature[weighty], row[weighty])
        return np.bincount(row, table[feature], minlength=len(offsets) - 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k; their sum over k is the expected grade."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_rows(feature: np.ndarray, row: np.ndarray, grade: np.ndarray, n_grades: int, shapes: bool, steps: int = 400, l2: float = 1e-6) -> Model:
    """Fits distinct (feature, row) pairs to the grades 0 .. n_grades - 1 of the rows."""
    n = len(grade)
    share = (np.bincount(grade, minlength=n_grades) + 0.5) / (n + 0.5 * n_grades)
    upto = np.clip(np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
    theta = np.log(upto / (1 - upto))
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), theta, shapes)
    # in slices: the driver holds the pairs once and little else
    slices = [slice(a, a + (1 << 19)) for a in range(0, len(feature), 1 << 19)]
    have = np.zeros(1 << FEATURE_BITS, np.int32)
    for s in slices:
        np.add.at(have, feature[s], 1)
    seen = np.flatnonzero((have >= MIN_ROWS) & (have <= n - MIN_ROWS))
    number = np.full(1 << FEATURE_BITS, -1, np.int32)
    number[seen] = np.arange(len(seen))
    off, centred = np.zeros(len(seen)), grade - grade.mean()
    for s in slices:
        at = number[feature[s]]
        np.add.at(off, at[at >= 0], centred[row[s]][at >= 0])
    z = np.abs(off) / np.sqrt(np.maximum(have[seen], 1)) / max(grade.std(), 1e-9)
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(seen[best[z[best] >= MIN_Z]])
    number[:] = -1
    number[chosen] = np.arange(len(chosen))
    kept = [(row[s][number[feature[s]] >= 0], number[feature[s]][number[feature[s]] >= 0]) for s in slices]
    row, col = (np.concatenate([x[i] for x in kept] or [np.zeros(0, np.int32)]) for i in (0, 1))
    penalty = MIN_Z * grade.std() * np.sqrt(have[chosen]) / n
    weight, _ = _descend(row, col, grade, len(chosen), theta, steps // 2, penalty, 0.0)
    active = np.abs(weight) > 1e-3
    number = np.where(active, np.cumsum(active) - 1, -1)
    row, col = row[number[col] >= 0], number[col[number[col] >= 0]]
    weight, theta = _descend(row, col, grade, int(active.sum()), theta, 2 * steps, 0.0, l2)
    return Model(chosen[active], weight.astype(np.float32), theta, shapes)


def _descend(row: np.ndarray, col: np.ndarray, grade: np.ndarray, m: int, theta: np.ndarray, steps: int, l1: np.ndarray | float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by proximal Adam on the negative log likelihood of all rows."""
    n, k = len(grade), len(theta)
    x = np.concatenate([np.zeros(m), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, gaps = x[:m], np.exp(x[m + 1 :])
        cuts = np.concatenate([[-np.inf], x[m] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        eta = np.bincount(row, w[col], minlength=n)
        hi, lo = _sigmoid(cuts[grade + 1] - eta), _sigmoid(cuts[grade] - eta)
        p = np.maximum(hi - lo, 1e-12)
        g_eta = 1.0 - hi - lo  # of the negative log likelihood
        g_cut = np.bincount(grade + 1, -hi * (1 - hi) / p, minlength=k + 2) + np.bincount(grade, lo * (1 - lo) / p, minlength=k + 2)
        after = np.cumsum(g_cut[1:-1][::-1])[::-1]
        g = np.concatenate([np.bincount(col, g_eta[row], minlength=m) / n + l2 * w, [after[0] / n], after[1:] * gaps / n])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = 0.1 * (1 - 0.9 * step / steps) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        x = x - rate * first / (1 - 0.9**step)
        x[:m] = np.sign(x[:m]) * np.maximum(np.abs(x[:m]) - rate[:m] * l1, 0)
        x[m + 1 :] = np.clip(x[m + 1 :], -7, 6)
    return x[:m], x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))])


def fit(rows: DataFrame, n_grades: int, unlabelled: int, key: str = "doc_id", text: str = "text", grade: str = "grade", shapes: bool = False, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits rows with a text and a grade from 0 to n_grades - 1; what reaches the driver is bounded by the sample. Without such rows every text has the grade ``unlabelled``."""
    labelled = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(grade).cast("long").alias("grade")).where(f"text is not null and grade between 0 and {n_grades - 1}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column(0)):
                feature, row = distinct(*features(data, offsets, shapes))
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))], names=["grade", "features"])

    # texts below are sampled by key before they are read, and features are 4 bytes a distinct word
    got = hash_sample(labelled, "key", sample_rows).select("text", "grade").mapInArrow(run, "grade long, features array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), np.where(np.arange(n_grades - 1) < unlabelled, -40.0, 40.0), shapes)
    lists = got.column("features").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    counts = np.diff(lists.offsets.to_numpy())
    model = fit_rows(lists.flatten().to_numpy(), np.repeat(np.arange(len(counts), dtype=np.int32), counts), got.column("grade").to_numpy(), n_grades, shapes)
    del got, lists
    K.release()
    return model


def grade_rows(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with tails array<double>, P(grade > k) for each k, in place of a column of that name; a null text counts as empty."""
    rows = rows.drop("tails")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "tails array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            scores = [model.scores(data, offsets, table) for _, _, data, offsets in K.text_chunks(batch.column(text))]
            tails = model.tails(np.concatenate(scores) if scores else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tails.size + 1, tails.shape[1]), pa.int32()), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "tails"])

    return rows.mapInArrow(run, schema)


def keep_below(rows: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of which P(grade > 0) is below ``limit``, with all their columns as they are."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            scores = [model.scores(data, offsets, table) for _, _, data, offsets in K.text_chunks(batch.column(text))]
            if scores:
                yield batch.filter(pa.array(model.tails(np.concatenate(scores))[:, 0] < limit))

    return rows.mapInArrow(run, rows.schema)
