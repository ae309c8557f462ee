"""License scans: winnowed template fingerprints pick places, banded alignment reports coverage and spans.

Templates are texts by license id. They are scanned in blocks of about ``BLOCK_WORDS`` words, so the
inverted index that is broadcast has a fixed bound; each block is a pass over the documents. Of the
hashes of ``GRAM`` consecutive words of a template the least of each ``WINDOW`` are kept (winnowing),
of templates shorter than ``SHORT`` words all. Every word sequence of a document is looked up in that
index. Hits of one template whose offsets follow each other by at most ``BAND``, or a third of a short
template, form a candidate place; its band is the whole range of their offsets and ``BAND`` more on
each side. A range longer than the template is cut into overlapping ones, so an occurrence into which
up to half as many words were inserted is whole in one of them. There the template is aligned with
the document's words within the band: the alignment keeps the most template words in order. A place
is a match when it keeps ``COVERAGE`` of them or more; of overlapping matches of one template the one
that keeps the most stays. Documents are read whole and never shuffled.

Result: one row for each match, with the words kept, their share of the template and the span in
words and bytes. Defined cases: a null or empty text matches nothing; a template without words is
left out; a document with a license twice has two rows; repeated rows each give their own rows;
overlapping matches of different templates all count; of matches that keep as many words the first
stays; memory follows the longest text; columns other than the key and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K
from arcavec.llm.decontaminate import WORD
from arcavec.llm.licenses import TEMPLATES

GRAM = 3
WINDOW, SHORT = 4, 32
BAND = 6
COVERAGE = 0.8
BLOCK_WORDS = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offsets, WORD)
    return K.slice_hash(K.prefix_hash(low), starts, ends), starts, ends, rows


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash, the last of equals, of every ``window`` consecutive ones."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - view.argmin(axis=1))


class Index:
    """The inverted index of template fingerprints: hash, template, position."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.ids, self.words = gram, [], []
        prints: list[tuple[int, int, int]] = []
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            h, _, _, _ = word_hashes(data, np.array([0, len(data)]))
            if not len(h):
                continue
            grams, _ = K.shingle_hash(h, np.array([0, len(h)]), gram)
            prints += [(int(grams[p]), len(self.ids), int(p)) for p in winnow(grams, window if len(h) >= SHORT else 1)]
            self.ids.append(name)
            self.words.append(h)
        prints.sort()
        self.hashes = np.array([p[0] for p in prints], np.uint64)
        self.template = np.array([p[1] for p in prints], np.int64)
        self.position = np.array([p[2] for p in prints], np.int64)


def blocks(templates: dict[str, str], block_words: int = BLOCK_WORDS) -> Iterator[dict[str, str]]:
    """The templates in blocks of about so many words; there is one block at least."""
    block, size = {}, 0
    for name, text in sorted(templates.items()):
        if block and size + text.count(" ") + 1 > block_words:
            yield block
            block, size = {}, 0
        block[name] = text
        size += text.count(" ") + 1
    yield block


def _kept(template: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of one template with many windows of words, whose surplus over the template is the band.

    Returns (template words kept in order, window position of the first of them), the latest such
    position. A state is words kept << 32 | first position; a gap costs nothing, so a row's best so
    far is a running maximum.
    """
    n, width = len(text), text.shape[1] - len(template) + 1
    state = np.zeros((n, width), np.int64)
    for i, word in enumerate(template):
        here = text[:, i : i + width] == word
        first = np.broadcast_to(np.arange(i, i + width), here.shape)
        match = np.where(state == 0, (1 << 32) | first, state + (1 << 32))  # along the diagonal
        skip = np.zeros_like(state)
        skip[:, :-1] = state[:, 1:]  # a template word that the text lacks
        state = np.maximum.accumulate(np.maximum(np.where(here, match, 0), skip), axis=1)
    best = state.max(axis=1)
    return best >> 32, best & ((1 << 32) - 1)


def _places(template: np.ndarray, row: np.ndarray, diagonal: np.ndarray, sizes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, row, least diagonal, width of the band) of the candidate places of hits."""
    by = np.lexsort((diagonal, row, template))
    template, diagonal, row = template[by], diagonal[by], row[by]
    bands = np.minimum(band, np.maximum(1, sizes // 3))  # a short notice that follows itself is another place
    new = np.flatnonzero(np.append(True, (template[1:] != template[:-1]) | (row[1:] != row[:-1]) | (diagonal[1:] - diagonal[:-1] > bands[template[1:]])))
    template, row, least, most = template[new], row[new], diagonal[new], diagonal[np.append(new[1:], len(diagonal)) - 1]
    length = np.maximum(sizes[template], 2 * bands[template])
    step = np.maximum(1, length // 2)
    parts = np.where(most - least <= length, 1, -(-(most - least) // step))
    nth = K.ragged(np.zeros(len(parts), np.int64), parts)
    template, row, least, most, length, step = (np.repeat(x, parts) for x in (template, row, least, most, length, step))
    start = least + nth * step
    return template, row, start - bands[template], np.minimum(most - start, length) + 2 * bands[template]


def _best_apart(row: np.ndarray, template: np.ndarray, kept: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matches that stay: of those of one template that overlap the one that keeps the most, the first of equals."""
    stay: list[int] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in np.lexsort((a, -kept, template, row)):
        spans = taken.setdefault((int(row[k]), int(template[k])), [])
        if all(b[k] <= x or a[k] >= y for x, y in spans):
            spans.append((int(a[k]), int(b[k])))
            stay.append(int(k))
    return np.array(sorted(stay, key=lambda k: (row[k], template[k], a[k])), np.int64)


def scan(data: np.ndarray, offsets: np.ndarray, index: Index, band: int = BAND, coverage: float = COVERAGE):
    """Matches of a chunk: (row, template, words kept, first word, end word, first byte, end byte), words and bytes within the row."""
    h, starts, ends, rows = word_hashes(data, offsets)
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if not len(h) or not len(index.hashes):
        return none
    out = []
    counts = np.diff(rows)
    for gram in sorted({index.gram, *(len(w) for w in index.words if len(w) < index.gram)}):
        # sequences of one length; shorter ones stand for templates shorter than the usual length
        size = np.maximum(counts - gram + 1, 0)
        at = K.ragged(rows[:-1], size)
        g = np.zeros(len(at), np.uint64)
        for j in range(gram):
            g = K.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[at + j] + np.uint64(j + 1))
        g ^= K.mix(np.array([gram], np.uint64))
        lo, hi = np.searchsorted(index.hashes, g), np.searchsorted(index.hashes, g, side="right")
        hit = np.flatnonzero(hi > lo)
        which = K.ragged(lo[hit], (hi - lo)[hit])
        place = np.repeat(at[hit], (hi - lo)[hit])
        out.append((index.template[which], place - index.position[which], np.searchsorted(rows, place, side="right") - 1))
    template, diagonal, row = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(template):
        return none
    template, row, least, width = _places(template, row, diagonal, np.array([len(w) for w in index.words]), band)
    found = []
    padded = np.concatenate([h, np.zeros(1, np.uint64)])
    # places of one template are aligned side by side, those of like widths of the band together
    wide = np.int64(1) << np.ceil(np.log2(width + 1)).astype(np.int64)
    for t, w in sorted({(int(x), int(y)) for x, y in zip(template, wide, strict=True)}):
        words = index.words[t]
        of = np.flatnonzero((template == t) & (wide == w))
        size = len(words) + w
        for part in range(0, len(of), max(1, (1 << 21) // size)):
            c = of[part : part + max(1, (1 << 21) // size)]
            at = least[c][:, None] + np.arange(size)
            inside = (at >= rows[row[c]][:, None]) & (at < rows[row[c] + 1][:, None]) & (np.arange(size) < len(words) + width[c][:, None])
            text = np.where(inside, padded[np.where(inside, at, len(h))], np.uint64(0))
            kept, first = _kept(words, text)
            back, last = _kept(words[::-1], text[:, ::-1])
            ok = kept >= coverage * len(words)
            c, kept, a, b = c[ok], kept[ok], at[ok, 0] + first[ok], at[ok, -1] - last[ok] + 1
            found.append((row[c], np.full(len(c), t), kept, a, b))
    row, template, kept, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    stay = _best_apart(row, template, kept, a, b)
    row, template, kept, a, b = (x[stay] for x in (row, template, kept, a, b))
    return row, template, kept, a - rows[row], b - rows[row], starts[a] - offsets[row], ends[np.maximum(b - 1, a)] - offsets[row]


def find_licenses(rows: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, band: int = BAND, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each match: key, license_id, words_kept, template_words, coverage, word and byte spans."""
    kind = dict(rows.dtypes)[key]
    schema = f"key {kind}, license_id string, words_kept long, template_words long, coverage double, word_start long, word_end long, byte_start long, byte_end long"
    texts = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(shared):
        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for lo, _, data, offsets in K.text_chunks(batch.column(1)):
                    row, t, kept, w0, w1, b0, b1 = scan(data, offsets, index, band, coverage)
                    size = np.array([len(index.words[k]) for k in t], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + lo)), pa.array([index.ids[k] for k in t], pa.string()), pa.array(kept), pa.array(size), pa.array(kept / np.maximum(size, 1)), pa.array(w0), pa.array(w1), pa.array(b0), pa.array(b1)],
                        names=["key", "license_id", "words_kept", "template_words", "coverage", "word_start", "word_end", "byte_start", "byte_end"],
                    )

        return scanned

    passes = [texts.mapInArrow(run(rows.sparkSession.sparkContext.broadcast(Index(block))), schema) for block in blocks(TEMPLATES if templates is None else templates, block_words)]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("key", key)
