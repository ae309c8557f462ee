"""Language identification: multinomial naive Bayes over hashed character bigrams and trigrams.

Counts are summed where the texts are, one row of the matrix for each language; the matrix of log
probabilities has at most ``CELLS`` cells, for with many languages there are fewer buckets, and is
broadcast. The prior of a language is its share of the texts learned from. A batch is scored in
numpy: the n-grams of all its rows index the matrix at once and are summed row by row.

Learning uses the rows of a hash sample of about ``SAMPLE_ROWS`` labelled rows, all of them when
there are fewer. Prediction reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
row every text is ``und``; a text without a bigram goes by the prior; equal scores go to the language first in order; a null key is neither
held out nor learned from; repeated rows each give a row; of a very long text every n-gram counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS = 20_000
CELLS = 1 << 25
CHUNK = 2 << 20

_LETTER = regex.compile(r"\p{L}")
_LOW = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x250)], np.uint32)


def bucket_bits(languages: int) -> int:
    """As many as ``BUCKET_BITS``, fewer where the matrix would have more than ``CELLS`` cells."""
    return max(1, min(BUCKET_BITS, (CELLS // max(1, languages)).bit_length() - 1))


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, row offsets) of the bigrams, then of the trigrams, of each row."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.where(points < len(_LOW), _LOW[np.minimum(points, len(_LOW) - 1)], points)
    for n in (2, 3):
        h = np.full(max(0, len(points) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ points[j : j + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        counts = np.maximum(np.diff(begins) - n + 1, 0)
        inside = h if len(begins) == 2 else h[K.ragged(begins[:-1], counts)]
        yield inside, np.concatenate([[0], np.cumsum(counts)])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; 0 for an empty row."""
    out = np.zeros(len(offsets) - 1)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], dtype=np.float64)
    return out


def _count(bits: int):
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def out():
            at = {lang: np.flatnonzero(c) for lang, c in sums.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([at[x].astype(np.int32).tobytes() for x in sums], pa.binary()), pa.array([c[at[x]].tobytes() for x, c in sums.items()], pa.binary()), pa.array([texts[x] for x in sums], pa.int64())], names=["lang", "at", "n", "texts"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in K.text_chunks(batch.column("text"), CHUNK):
                code = {x: k for k, x in enumerate(sorted(set(langs[lo:hi])))}
                which = np.array([code[x] for x in langs[lo:hi]])
                for lang, n in zip(code, np.bincount(which).tolist(), strict=True):
                    texts[lang] = texts.get(lang, 0) + n
                for buckets, begins in ngram_buckets(data, offsets, bits):
                    n = np.bincount(np.repeat(which, np.diff(begins)) * size + buckets, minlength=len(code) * size)
                    for lang, k in code.items():
                        sums[lang] = sums.get(lang, 0) + n[k * size : (k + 1) * size]
            if len(sums) > 64:
                yield from out()
                sums.clear()
                texts.clear()
        if sums:
            yield from out()

    return run


def _add(bits: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits, np.int64)
        for at, n in zip(table.column("at"), table.column("n"), strict=True):
            total[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(n.as_py(), np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary()), "texts": pa.array([sum(table.column("texts").to_pylist())], pa.int64())})

    return run


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows chosen by a hash of their key, all if there are fewer: the same rows each time."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, texts: np.ndarray):
        self.langs = langs
        self.bits = counts.shape[1].bit_length() - 1
        smooth = counts + 0.5
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32) if langs else counts
        self.prior = np.log(texts / texts.sum()) if langs else texts

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its posterior) for each row."""
        score = np.repeat(self.prior[:, None], len(offsets) - 1, axis=1)
        for buckets, begins in ngram_buckets(data, offsets, self.bits):
            for k in range(len(self.langs)):
                score[k] += row_sums(self.weights[k][buckets], begins)
        best = score.argmax(axis=0)
        odds = np.exp(score - score.max(axis=0))
        return best, 1.0 / odds.sum(axis=0)


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows with a text and a language."""
    labelled = rows.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    part = hash_sample(labelled, "key", sample_rows).select("lang", "text")
    bits = bucket_bits(part.select("lang").distinct().count())
    found = part.mapInArrow(_count(bits), "lang string, at binary, n binary, texts long").groupBy("lang").applyInArrow(_add(bits), "lang string, n binary, texts long").orderBy("lang").collect()
    return Model([r.lang for r in found], np.array([np.frombuffer(r.n, np.int64) for r in found]).reshape(len(found), 1 << bits), np.array([r.texts for r in found], np.float64))


def identify(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without their text, with lang_pred and score, which replace columns of these names."""
    rows = rows.drop("lang_pred", "score")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column, preds, scores = batch.column(0), [], []
            for lo, hi, data, offsets in K.text_chunks(column, CHUNK):
                part = column.slice(lo, hi - lo)
                real = [x is not None and _LETTER.search(x) is not None for x in part.to_pylist()]
                best, score = model.predict(data, offsets) if model.langs else ([0] * (hi - lo), [0.0] * (hi - lo))
                preds += [model.langs[b] if r and model.langs else "und" for b, r in zip(best, real, strict=True)]
                scores += [float(s) if r and model.langs else 0.0 for s, r in zip(score, real, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return rows.select(F.col(text).cast("string").alias(text), *(f.name for f in others)).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The rows that are kept from learning: a quarter, by the CRC of the key as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
