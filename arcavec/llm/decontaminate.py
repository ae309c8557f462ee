"""Benchmark decontamination: an FM-index per training shard, searched for every window of the test items.

A window is 13 consecutive words of an item, or a shorter item whole. Words are runs of digits,
letters and non-ASCII characters after A-Z are lower-cased. A shard is a few megabytes of
consecutive documents. Its sequence of words goes into the index without the words that no item
has and without runs too short to hold a window, which no window can touch. All windows are
searched backwards through wavelet-tree ranks at once, occurrences are located by sampled suffix
positions, and their spans are merged within each document.

Documents are never shuffled. The windows travel to the executors in blocks of at most
``BLOCK_WORDS`` item words, so what is broadcast has a fixed bound; with more than one block each
is a pass of its own, and each row carries its text, spans and items from pass to pass.

Defined cases: a null or empty text has no words and comes out with zeros; an item that is null or
has no words has no window; rows of an item_id that repeats count as one item; an item with a null
id is left out; repeated document rows each give a row; an empty benchmark gives zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K
from arcavec.llm.fm_index import FMIndex

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20

#: Bytes that words are made of, after lower-casing.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


class Windows:
    """The distinct windows of a block of items, as word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        numbers: dict[int, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        self.items = sorted({i for i, _ in items})
        at = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            data = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = K.words(data, np.array([0, len(data)]), WORD)
            seq = [numbers.setdefault(int(h), len(numbers) + 2) for h in K.slice_hash(K.prefix_hash(data), starts, ends)]
            for k in range(max(1, len(seq) - width + 1) if seq else 0):
                windows.setdefault(tuple(seq[k : k + width]), []).append(at[item])
        hashes = np.array(list(numbers), np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.numbers = hashes[by], np.arange(2, len(numbers) + 2)[by]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.patterns[k, : len(w)] = w
        owners = [sorted(set(v)) for v in windows.values()]
        self.owner_offsets = np.concatenate([[0], np.cumsum([len(v) for v in owners])]).astype(np.int64)
        self.owners = np.array([x for v in owners for x in v], np.int64)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        """The number of each word hash, 0 for words of no item."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == h[maybe]
            out[maybe[same]] = self.numbers[at[same]]
        return out


def scan_shard(data: np.ndarray, offsets: np.ndarray, windows: Windows):
    """For a shard of documents: (word starts, word ends, word offsets, hit flags, document of each item found, item)."""
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offsets, WORD)
    hit, none = np.zeros(len(starts), bool), np.zeros(0, np.int64)
    if not len(starts) or not len(windows.lengths):
        return starts, ends, rows, hit, none, none
    number = windows.number(K.slice_hash(K.prefix_hash(low), starts, ends))
    first = K.row_starts(rows, len(number))
    lo, hi = K.runs(number > 0, first)
    keep = hi - lo >= windows.lengths.min()
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return starts, ends, rows, hit, none, none
    place = K.ragged(lo, hi - lo + 1)  # word of each symbol; the symbol after a run parts it from the next
    seq = number[np.minimum(place, len(number) - 1)]
    seq[np.cumsum(hi - lo + 1) - 1] = 1
    index = FMIndex(seq, int(windows.numbers.max()))
    a, b = index.search(windows.patterns, windows.lengths)
    pattern = np.repeat(np.arange(len(a)), b - a)
    if not len(pattern):
        return starts, ends, rows, hit, none, none
    at = place[index.locate(K.ragged(a, b - a))]
    hit = K.covered(at, at + windows.lengths[pattern], len(starts))
    count = np.diff(windows.owner_offsets)[pattern]
    pairs = np.unique(np.stack([np.repeat(np.searchsorted(rows, at, side="right") - 1, count), windows.owners[K.ragged(windows.owner_offsets[:-1][pattern], count)]]), axis=1)
    return starts, ends, rows, hit, pairs[0], pairs[1]


def _extended(before: pa.Array, new: pa.ListArray) -> pa.Array:
    """Lists with the values of ``new`` after those of ``before``, row by row."""
    if not len(new.values):
        return before
    own = new.to_pylist()
    return pa.array([x + y if y else x for x, y in zip(before.to_pylist(), own, strict=True)], before.type)


def _scan(windows: Windows, first: bool, last: bool):
    """mapInArrow function over (key, text) and, after the first pass, what passes before it found: the row's number of words, hit spans as word and byte ranges, and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column(1), SHARD_BYTES):
                starts, ends, rows, hit, doc, item = scan_shard(data, offsets, windows)
                a, b = K.runs(hit, K.row_starts(rows, len(hit)))
                row = np.searchsorted(rows, a, side="right") - 1
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                found = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                origin = offsets[row]
                lists = {n: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64))) for n, x in (("w0", a - rows[row]), ("w1", b - rows[row]), ("b0", starts[a] - origin), ("b1", ends[b - 1] - origin))}
                lists["items"] = pa.ListArray.from_arrays(pa.array(found), pa.array([windows.items[k] for k in item], pa.string()))
                if not first:
                    lists = {n: _extended(batch.column(n).slice(lo, hi - lo), x) for n, x in lists.items()}
                kept = [n for n in ("key", "text")[: 1 if last else 2]]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in kept), pa.array(np.diff(rows).astype(np.int64)), *lists.values()], names=[*kept, "n_words", *lists])

    return run


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most about ``block_words`` words, one block on the driver at a time."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").distinct()
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += text.count(" ") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` by its key, with n_words, the merged hit spans and the items found.

    spans: array of (w0, w1, b0, b1), word and byte ranges, ends excluded. items: sorted item ids.
    """
    found = "n_words long, w0 array<long>, w1 array<long>, b0 array<long>, b1 array<long>, items array<string>"
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    passes, ahead = 0, blocks(benchmark, block_words)
    block = next(ahead)
    while block is not None:
        after = next(ahead, None)
        rows = rows.mapInArrow(_scan(Windows(block, width), passes == 0, after is None), f"key {kind}, {'' if after is None else 'text string, '}{found}")
        passes, block = passes + 1, after
    spans = F.arrays_zip("w0", "w1", "b0", "b1")
    if passes == 1:
        return rows.select(F.col("key").alias(key), "n_words", spans.alias("spans"), F.array_sort("items").alias("items"))
    empty = F.array().cast("array<struct<w0:bigint,w1:bigint,b0:bigint,b1:bigint>>")

    def merged(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["w0"].alias("w0"), F.greatest(last["w1"], x["w1"]).alias("w1"), last["b0"].alias("b0"), F.greatest(last["b1"], x["b1"]).alias("b1"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["w1"] < x["w0"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return rows.select(F.col("key").alias(key), "n_words", F.aggregate(F.array_sort(spans), empty, merged).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document with the counts and the digest of its items; contaminated from a twentieth of its words on."""
    found = contamination(docs, benchmark, key, text, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["w1"] - x["w0"])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "spans",
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _mark(windows: Windows):
    """mapInArrow function: adds the hit byte spans of a block of items to the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            before0, before1 = batch.column("_b0"), batch.column("_b1")
            lists0, lists1 = [], []
            for lo, hi, data, offsets in K.text_chunks(batch.column(at), SHARD_BYTES):
                starts, ends, rows, hit, _, _ = scan_shard(data, offsets, windows)
                a, b = K.runs(hit, K.row_starts(rows, len(hit)))
                row = np.searchsorted(rows, a, side="right") - 1
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                b0, b1 = starts[a] - offsets[row], ends[b - 1] - offsets[row]
                for k in range(hi - lo):
                    x, y = cut[k], cut[k + 1]
                    lists0.append([*(before0[lo + k].as_py() or []), *b0[x:y].tolist()] if y > x else before0[lo + k].as_py())
                    lists1.append([*(before1[lo + k].as_py() or []), *b1[x:y].tolist()] if y > x else before1[lo + k].as_py())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lists0, kind), pa.array(lists1, kind)], names=batch.schema.names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keep = [], []
        for text, b0, b1 in zip(batch.column("_text"), batch.column("_b0"), batch.column("_b1"), strict=True):
            data = text.as_py()
            keep.append(True)
            if b0.is_valid and len(b0):
                raw = np.frombuffer(data.encode(), np.uint8)
                stays = ~K.covered(np.array(b0.as_py()), np.array(b1.as_py()), len(raw))
                keep[-1] = bool((WORD[K.LOWER[raw]] & stays).any())
                data = raw[stays].tobytes().decode()
            texts.append(data)
        out = pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])
        yield out.filter(pa.array(keep, pa.bool_()))


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the words of benchmark windows cut out of their text; a row that is left without a word goes. Rows without hits stay as they are."""
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("_row"), F.col(text).cast("string").alias("_text"), F.lit(None).cast("array<long>").alias("_b0"), F.lit(None).cast("array<long>").alias("_b1"))
    parts = [_mark(Windows(block, width)) for block in blocks(benchmark, block_words)]
    for mark in parts[:-1]:
        both = both.mapInArrow(mark, both.schema)
    last = parts[-1]
    done = both.mapInArrow(lambda batches: _cut(last(batches)), both.select("_row", "_text").schema)
    return done.select(*(F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
