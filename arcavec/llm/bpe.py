"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Codepoints are classed by table (letter, number, white space, space, apostrophe, other); with what
follows them they become the symbols of a small automaton whose states say what kind of piece is
open. Each symbol is a function from state to state, functions compose associatively, and their
products are found by a blocked scan over a table of all compositions (the transition monoid), so
the state at every codepoint, and with it every boundary, comes without a regular expression. A
text's first codepoint carries the constant function, which resets the state.

The slices between boundaries are hashed; each distinct one is merged by rank once and kept in a
bounded cache, and its ids are copied to all its places. A slice is compared byte by byte with the
one that stands for its hash. Token offsets are kept, so decoding is a gather of the tokens' bytes.

Defined cases: a null or empty text has no tokens; no special token is ever produced; repeated rows
each give a row; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K

#: Pieces in each of two generations of the cache; what is used again moves to the younger.
CACHE_PIECES = 250_000
CHUNK = 2 << 20

# classes of codepoints
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE = range(6)
# symbols: what a codepoint is together with what follows it
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_LAST, S_INNER, S_QUOTE1, S_QUOTE2 = range(8)
# states: the piece that is open; JOINED is a space that belongs to what follows; TAILn wants n more letters of a contraction
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_BLANKS, TAIL1, TAIL2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins here)."""
    if state == TAIL2:
        return TAIL1, False
    if state == TAIL1:
        return NONE, False
    if symbol == S_LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, JOINED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHERS, JOINED):
            return IN_OTHERS, False
        return (TAIL1 if symbol == S_QUOTE1 else TAIL2), True
    if symbol == S_OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, JOINED)
    if symbol == S_JOIN:  # the space before something; a run of white space before it is a piece of its own
        return JOINED, True
    if symbol == S_LAST:  # other white space before something
        return NONE, True
    return IN_BLANKS, state != IN_BLANKS


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, element of each symbol at a text's start, products, the state that each element makes of each state)."""
    maps: list[tuple[int, ...]] = []
    known: dict[tuple[int, ...], int] = {}

    def add(m: tuple[int, ...]) -> int:
        if m not in known:
            known[m] = len(maps)
            maps.append(m)
        return known[m]

    plain = [add(tuple(_step(s, y)[0] for s in range(8))) for y in range(8)]
    start = [add((_step(NONE, y)[0],) * 8) for y in range(8)]
    at = 0
    while at < len(maps):
        for g in [*plain, *start]:
            add(tuple(maps[g][s] for s in maps[at]))
            add(tuple(maps[at][s] for s in maps[g]))
        at += 1
    n = len(maps)
    product = np.array([[known.get(tuple(b[s] for s in a), -1) for b in maps] for a in maps])
    while (product < 0).any():
        raise AssertionError("the monoid is not closed")
    kind = np.uint8 if n <= 256 else np.uint16
    return np.array(plain, kind), np.array(start, kind), product.astype(kind), np.array(maps, np.uint8)


_BEGINS = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])


def scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive products from the left: blocks are scanned side by side, their totals by the same scan, then joined."""
    n = len(elements)
    if n <= 64:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    width = 64
    rows = -(-n // width)
    padded = np.empty(rows * width, elements.dtype)
    padded[:n], padded[n:] = elements, elements[-1]
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, size = product.ravel(), product.shape[1]
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * size + grid[i]]
    carry = scan(grid[-1], product)
    grid[:, 1:] = flat[carry[None, :-1].astype(np.int32) * size + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = (p if p < 0xD800 else p + 0x800 for p in (m.start(), m.end() - 1))
            if a < 0xD800 <= b:
                out[a:0xD800] = kind
                a = 0xE000
            out[a : b + 1] = kind
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin, over all rows; none starts inside a codepoint or crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    kind = classes()[points]
    n = len(points)
    follow = np.full(n, BLANK, np.uint8)  # at the end of a text white space goes on, as far as its pieces are concerned
    follow[:-1] = kind[1:]
    follow[first[1:]] = BLANK
    white = (follow == BLANK) | (follow == SPACE)
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_INNER, S_OTHER], np.uint8)[kind]
    symbol[(kind == SPACE) & ~white] = S_JOIN
    symbol[(kind == BLANK) & ~white] = S_LAST
    quote = np.flatnonzero((kind == APOSTROPHE) & (follow == LETTER))
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        near = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quote[pair & near]] = S_QUOTE2
    plain, start, product, maps = monoid()
    after = maps[scan(np.where(first[:-1], start[symbol], plain[symbol]), product), NONE]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = NONE, after[:-1]
    before[first[:-1]] = NONE
    return at[_BEGINS[before, symbol]]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the adjacent pair of lowest rank, the first of equals, is joined until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 128:
        return _merge_short(piece, ranks)
    ends, back, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    dead = [False] * n
    while heap:
        r, i, end = heapq.heappop(heap)
        if dead[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        j = ends[i]
        dead[j] = True
        ends[i] = end
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if back[i] >= 0 and (r := ranks.get(piece[back[i] : end])) is not None:
            heapq.heappush(heap, (r, back[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    none = 1 << 60
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


class Codec:
    """Encodes and decodes columns of texts by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache, self.older = ranks, {}, {}
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for token, r in ranks.items():
            lengths[r] = len(token)
        self.token_ends = np.cumsum(lengths)
        self.token_bytes = np.zeros(int(lengths.sum()), np.uint8)
        for token, r in ranks.items():
            self.token_bytes[self.token_ends[r] - len(token) : self.token_ends[r]] = np.frombuffer(token, np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte position of each, row offsets in ids)."""
        starts = boundaries(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        h = K.slice_hash(K.prefix_hash(data), starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        same = self._same(data, starts, ends, first[inverse])
        raw = data.tobytes()
        known = [self._ids(raw[starts[i] : ends[i]]) for i in first]
        if not same.all():  # two pieces with one hash: the second gets an entry of its own
            odd = np.flatnonzero(~same)
            inverse[odd] = len(known) + np.arange(len(odd))
            known += [self._ids(raw[starts[i] : ends[i]]) for i in odd]
        sizes = np.array([len(x) for x in known], np.int64)
        table = np.fromiter((i for x in known for i in x), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        count = sizes[inverse]
        ids = table[K.ragged(begin[inverse], count)]
        rows = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]
        lengths = self.token_ends[ids] - np.where(ids > 0, self.token_ends[ids.astype(np.int64) - 1], 0)
        return ids, np.cumsum(lengths) - lengths, rows

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        ids = ids.astype(np.int64)
        begin = np.where(ids > 0, self.token_ends[ids - 1], 0)
        return self.token_bytes[K.ragged(begin, self.token_ends[ids] - begin)]

    def _ids(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece) or tuple(merge(piece, self.ranks))
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache, self.older = {}, self.cache
                self.cache[piece] = ids
        return ids

    @staticmethod
    def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether each slice has the bytes of the slice that stands for it; eight bytes are compared at a time."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.zeros(n + 1, np.uint64)
        for j in range(8):
            word[:n] |= padded[j : n + j].astype(np.uint64) << np.uint64(8 * j)
        length = ends - starts
        same = length == length[other]
        live, k = np.flatnonzero(same), 0
        while len(live):
            left = length[live] - k
            mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            equal = ((word[starts[live] + k] ^ word[starts[other[live]] + k]) & mask) == 0
            same[live[~equal]] = False
            k += 8
            live = live[equal & (left > 8)]
        return same


def _worker(shared, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            column = batch.column(0)
            column = column.fill_null("") if column.null_count else column
            for lo, hi, data, offsets in K.text_chunks(column, CHUNK):
                ids, at, rows = codec.encode(data, offsets)
                back = codec.decode(ids)
                ends = np.append(at, len(back))[rows]
                raw, decoded = ids.astype("<u4").tobytes(), back.tobytes()
                ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                text_sha = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out = [pa.array(np.diff(rows)), pa.array(ids_sha), pa.array(text_sha)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cut = pa.array(rows.astype(np.int32))
                    out += [pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array((at - np.repeat(offsets[:-1], np.diff(rows))).astype(np.int32)))]
                    names += ["ids", "byte_offsets"]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *out], names=[*batch.schema.names[1:], *names])

    return run


def encode(rows: DataFrame, ranks: dict[bytes, int], text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``rows`` without their text, with n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and byte_offsets; they replace columns of these names."""
    rows = rows.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "byte_offsets")
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    others = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>, byte_offsets array<int>"] * keep_ids])
    return rows.select(F.col(text).cast("string").alias(text), *(f.name for f in others)).mapInArrow(_worker(shared, keep_ids), schema)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``rows`` with their ids turned into decoded, the bytes of the tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    others = [f for f in rows.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary())], names=[*batch.schema.names[1:], "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "decoded binary"])
    return rows.select(ids, *(f.name for f in others)).mapInArrow(run, schema)
