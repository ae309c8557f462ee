"""Suffix-array dedup: removes every byte of a ``SPAN``-byte string that starts anywhere else too.

1. Equal texts become one text with its number of copies. Distinct texts go to a bucketed table,
   which later joins by text without moving it again.
2. Of the strings of ``GRAM`` bytes within each window of ``SPAN`` bytes the one with the least
   hash is the window's anchor. Equal windows have equal anchors at equal places, so a window whose
   anchor occurs once is unique; that rules out most of the corpus at one anchor in about a hundred
   bytes. Each anchor owns a run of consecutive windows, and each window has one owner. A stretch of
   period p, such as a run of blanks, is one run of windows that all repeat within it; only its first
   p windows travel, so it costs no more than any other text.
3. The windows of anchors that occur again, with their bytes (a context), go to the shard of their
   anchor; contexts of equal bytes travel and count once. A shard sorts the suffixes of its contexts by
   Larsson-Sadakane refinement, takes the common prefixes by Kasai's bound, and finds the windows
   that share ``SPAN`` bytes with a neighbour.
4. The contexts of an anchor that occurs more than ``HOT`` times are dealt over several shards. Such
   a shard also publishes the distinct windows of each of its parts (homes) by two independent 64-bit
   hashes; published lists are merged by binary search, which finds windows that no single home has twice.
5. With ``words``, runs of so many words that another document holds too are found as well, however
   few bytes they have. Words are runs of letters and digits, A-Z in small letters, so neither case
   nor what stands between them matters. Anchors are the least of the hashes of half as many words;
   of the windows of anchors that several documents hold, those that several documents hold are found
   by two independent 64-bit hashes, which move once, packed by bucket of their anchor. They are reported, and cut where ``cut_words`` says so.
6. Spans come back to their texts, and rows to the result of their text.

Defined cases: a null text is empty; texts shorter than ``SPAN`` bytes lose nothing but, where they
are cut, runs of ``words``; repeated rows are copies of each other; keys may repeat or be null, as rows are told apart
by their text only; a very long text, also one of a single character, takes a few dozen bytes of
memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import kernels as K
from arcavec.llm.decontaminate import WORD
from arcavec.llm.scratch import Table, partitions
from arcavec.llm.suffix import common_prefixes, suffix_array

SPAN = 400
GRAM = 200
HOT = 512
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 2 << 20
#: Bytes of contexts in one message from a task, about.
PIECE = 4 << 20
#: Starts of windows looked at at once; positions among them must fit 24 bits.
STARTS = 1 << 20
#: Windows of one context at most, and those from which a context is looked at for a period.
LONGEST, PERIODIC = 1 << 16, 2048
#: Windows of words that a task compares at once, about.
WINDOWS = 1 << 18
#: Shards for each shuffle partition: many small ones are even in bytes.
SHARDS = 8

U64, I64 = np.uint64, np.int64
#: Another numbering of bytes, for a second, independent hash.
_OTHER = np.random.default_rng(0x5EED).permutation(256).astype(np.uint8)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(key)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, first window it owns, number of windows, places of the anchor in them), for all windows of all rows. Neighbouring windows of equal anchors, wherever they stand, are one run."""
    out = []
    for lo in range(0, max(0, len(data) - span + 1), STARTS):
        part = data[lo : lo + STARTS + span - 1]
        h = K.window_hash(K.prefix_hash(part), gram)
        low = U64((1 << 24) - 1)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), span - gram + 1)
        start = np.arange(lo, lo + len(least))
        row = np.searchsorted(offsets, start, side="right") - 1
        inside = start + span <= offsets[row + 1]
        at = (least & low).astype(np.int64)
        own = h[at]
        together = inside[:-1] & (row[1:] == row[:-1])
        hop, new = inside.copy(), inside.copy()
        hop[1:] &= ~(together & (at[1:] == at[:-1]))
        new[1:] &= ~(together & (own[1:] == own[:-1]))
        first = np.flatnonzero(new)
        if len(first):
            size, places = (np.add.reduceat(x.astype(np.int64), first) for x in (inside, hop))
            out.append((own[first], row[first], start[first] - offsets[row[first]], size, places))
    if not out:
        return np.zeros(0, U64), *(np.zeros(0, I64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blob(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _deal(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, type]], name: str) -> Iterator[pa.RecordBatch]:
    """One row for each bucket with the arrays of its entries as bytes."""
    by = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket)
    which = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[which])
    arrays = [pa.array(which.astype(np.int32))]
    for values, kind in columns.values():
        raw = np.ascontiguousarray(values[by], dtype=kind)
        arrays.append(pa.array([raw[a:b].tobytes() for a, b in zip(ends - sizes[which], ends, strict=True)], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, names=[name, *columns])


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for c in table.column(column).chunks for x in c), kind)


def _find_anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for lo, _, data, offsets in K.text_chunks(batch.column("text")):
                h, row, start, n, places = anchors(data, offsets, span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(I64)), pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array(start), pa.array(n), pa.array(places)], names=["h", "k1", "k2", "lo", "n", "places"])

    return run


def _distinct(keys: list[np.ndarray], raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a member of each class of contexts of equal keys and bytes, in the order of the keys, and the class of each context."""
    variant = np.zeros(len(size), U64)
    for _ in range(2):
        _, first, which = np.unique(np.stack([*keys, variant], axis=1), axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        again = np.flatnonzero(first[which] != np.arange(len(which)))
        differ = []
        ends = np.cumsum(size[again])
        cut = np.append(np.flatnonzero(np.diff(ends // PIECE, prepend=-1)), len(again)) if len(again) else np.zeros(1, I64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            x, y = again[lo:hi], first[which[again[lo:hi]]]
            same = raw[K.ragged(begin[x], size[x])] == raw[K.ragged(begin[y], size[x])]
            differ.append(x[~np.logical_and.reduceat(same, np.cumsum(size[x]) - size[x])])
        if not sum(map(len, differ)):
            break
        # different bytes of equal hashes: each byte string has a number of its own
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(which, which[np.concatenate(differ)])):
            variant[i] = numbers.setdefault(raw[begin[i] : begin[i] + size[i]].tobytes(), len(numbers) + 1)
    return first, which


def _period(context: np.ndarray, gram: int) -> int:
    """The period of a context that is a string of at most 2 * gram bytes over and over, else 0."""
    head = context[: 4 * gram].tobytes()
    p = head.find(head[:gram], 1)
    return p if p > 0 and np.array_equal(context[p:], context[:-p]) else 0


def _owned(text: np.ndarray, h: np.ndarray, lo: np.ndarray, n: np.ndarray, m: np.ndarray, places: np.ndarray, span: int, gram: int) -> list[np.ndarray]:
    """(h, lo, n, m, places, cover) of the contexts of a text. Of a periodic stretch the windows of one period remain, with cover, the number of all its windows; other long ones are cut."""
    if not (n > PERIODIC).any():
        return [h, lo, n, m, places, np.zeros(len(n), I64)]
    out = []
    for hash_, first, count, often, hops in zip(h, lo, n, m, places, strict=True):
        p = _period(text[first : first + count + span - 1], gram) if count > PERIODIC else 0
        if p:
            out.append((hash_, first, p, often, hops, count))
        else:
            out += [(hash_, first + at, min(LONGEST, count - at), often, hops, 0) for at in range(0, count, LONGEST)]
    return [np.array(c, U64 if i == 0 else I64) for i, c in enumerate(zip(*out, strict=True))]


def _contexts(shards: int, span: int, gram: int, hot: int):
    """From texts with their repeated anchors to contexts by shard."""

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        h, size, m, places, k1, k2, lo, cover = (np.concatenate(x) for x in list(zip(*held, strict=True))[:-1])
        raw = np.concatenate([x[-1] for x in held])
        begin = np.cumsum(size) - size
        key = K.slice_hash(K.prefix_hash(raw), begin, begin + size)
        # an anchor's contexts stay together, unless it is hot: then texts decide between several shards
        salt = np.where(m > hot, K.mix(k1.astype(U64)) % (m // hot + 1).astype(U64), U64(0))
        home = K.mix(h + salt * U64(0x9E3779B97F4A7C15))
        first, which = _distinct([h, key, home, size.astype(U64)], raw, begin, size)
        bucket = (home[first] % U64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first, bucket = first[order], bucket[order]
        refs = np.argsort(place[which], kind="stable")
        ref_of = place[which][refs]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = []
        for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
            f = first[a:b]
            r0, r1 = np.searchsorted(ref_of, [a, b])
            r = refs[r0:r1]
            rows.append((int(bucket[a]), _blob(h[f], U64), _blob(key[f], U64), _blob(home[f], U64), _blob(m[f], I64), _blob(places[f], I64), _blob(size[f], I64), raw[K.ragged(begin[f], size[f])].tobytes(), _blob(ref_of[r0:r1] - a, I64), _blob(k1[r], I64), _blob(k2[r], I64), _blob(lo[r], I64), _blob(cover[r], I64)))
        yield pa.RecordBatch.from_pylist([dict(zip(_CONTEXT_NAMES, r, strict=True)) for r in rows], schema=_CONTEXT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            k1s, k2s, found = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("found")
            data, offsets = K.text_buffer(batch.column("text"))
            ends = found.offsets.to_numpy()
            every = [found.values.field(c).to_numpy() for c in ("h", "lo", "n", "m", "places")]
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                h, lo, n, m, places = (x[ends[i] : ends[i + 1]] for x in every)
                h, lo, n, m, places, cover = _owned(text, h.view(U64), lo, n, m, places, span, gram)
                size = n + (span - 1)
                upto = np.cumsum(size)
                a = 0
                while a < len(h):  # a long text fills several messages
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE - total, side="right")))
                    part = slice(a, b)
                    held.append((h[part], size[part], m[part], places[part], np.full(b - a, k1s[i]), np.full(b - a, k2s[i]), lo[part], cover[part], text[K.ragged(lo[part], size[part])]))
                    total += int(size[part].sum())
                    a = b
                    if total >= PIECE or a < len(h):
                        yield from deal(held)
                        held, total = [], 0
        if held:
            yield from deal(held)
        K.release()

    return run


_CONTEXT_NAMES = ["shard", "h", "key", "home", "m", "places", "size", "raw", "ref", "k1", "k2", "lo", "cover"]
_CONTEXT_SCHEMA = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in _CONTEXT_NAMES[1:])])
_SPANS = "kind int, k1 long, k2 long, a binary, b binary"


def shared_windows(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, span: int) -> np.ndarray:
    """Flags of the positions of ``raw`` at which a window begins that another window of these contexts equals."""
    order, _ = suffix_array(raw, span)
    common = common_prefixes(raw, order, span)
    owned = np.zeros(len(raw), bool)
    owned[K.ragged(begin, size - span + 1)] = True
    place = np.flatnonzero(owned[order])
    flags = np.zeros(len(raw), bool)
    if len(place) > 1:
        # the common prefix of two suffixes is the least between them
        same = np.minimum.reduceat(common[: place[-1] + 1], place[:-1] + 1) >= span
        at = order[place]
        flags[at[1:][same]] = flags[at[:-1][same]] = True
    return flags


def _shard(span: int, hot: int, buckets: int, shard_bytes: int = SHARD_BYTES):
    def run(table: pa.Table) -> pa.Table:
        rows = table.num_rows
        counts = [len(x.as_py()) // 8 for c in table.column("h").chunks for x in c]
        refs = [len(x.as_py()) // 8 for c in table.column("ref").chunks for x in c]
        h, key, home, m, places, size = (_joined(table, c, t) for c, t in (("h", U64), ("key", U64), ("home", U64), ("m", I64), ("places", I64), ("size", I64)))
        ref, k1, k2, lo, cover = (_joined(table, c, I64) for c in ("ref", "k1", "k2", "lo", "cover"))
        raw = _joined(table, "raw", np.uint8)
        ref = ref + np.repeat(np.cumsum([0, *counts[:-1]]), refs) if rows else ref
        begin = np.cumsum(size) - size
        first, which = _distinct([home, h, key, size.astype(U64)], raw, begin, size)
        of = which[ref]  # distinct context of each reference
        home, h, size, begin, m, places = home[first], h[first], size[first], begin[first], m[first], places[first]
        copies = np.bincount(of, weights=1 + (cover > 0), minlength=len(first))  # windows of a periodic stretch repeat within it
        # classes are in the order of home and anchor: contexts of a group are neighbours
        edge = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (h[1:] != h[:-1])))
        group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))
        several = (np.bincount(group)[group] > 1) | (places > 1)  # windows of one context can be equal where its anchor repeats
        windows = size - span + 1
        flag_at = np.cumsum(windows) - windows
        flags = np.repeat(copies > 1, windows)
        todo = np.flatnonzero(several)
        if len(todo):
            ends = np.cumsum(size[todo])
            last_of_group = np.append(group[todo][1:] != group[todo][:-1], True)
            stops, lo_i, base = np.flatnonzero(last_of_group) + 1, 0, 0
            while lo_i < len(todo):
                fit = stops[(stops > lo_i) & (ends[stops - 1] - base <= shard_bytes)]
                hi_i = int(fit[-1]) if len(fit) else int(stops[stops > lo_i][0])
                c = todo[lo_i:hi_i]
                text = raw[K.ragged(begin[c], size[c])]
                at = np.cumsum(size[c]) - size[c]
                found = shared_windows(text, at, size[c], span)
                flags[K.ragged(flag_at[c], windows[c])] |= found[K.ragged(at, windows[c])]
                base, lo_i = int(ends[hi_i - 1]), hi_i
        out = _runs_by_text(flags, flag_at[of], windows[of], k1, k2, lo)
        if len(whole := np.flatnonzero(cover)):
            out = pa.concat_tables([out, _by_text(k1[whole], k2[whole], lo[whole], lo[whole] + cover[whole])])
        published = np.flatnonzero(m > hot)
        if len(published):
            out = pa.concat_tables([out, _publish(published, flags, flag_at, windows, home, raw, begin, size, of, k1, k2, lo, span, buckets)])
        return out

    return run


def _runs_by_text(flags, at, windows, k1, k2, lo) -> pa.Table:
    """Runs of flagged windows of each reference, gathered by text: a is the first start, b the end of the starts."""
    f = flags[K.ragged(at, windows)]
    begin = np.cumsum(windows) - windows
    a, b = K.runs(f, K.row_starts(np.append(begin, len(f)), len(f)))
    r = np.searchsorted(begin, a, side="right") - 1
    a, b = a - begin[r] + lo[r], b - begin[r] + lo[r]
    return _by_text(k1[r], k2[r], a, b)


def _by_text(k1, k2, a, b, kind: int = -1) -> pa.Table:
    by = np.lexsort((a, k2, k1))
    k1, k2, a, b = k1[by], k2[by], a[by], b[by]
    edge = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, I64)
    cut = np.append(edge, len(k1))
    blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (a.astype(I64), b.astype(I64))]
    return pa.table([pa.array(np.full(len(edge), kind, np.int32)), pa.array(k1[edge]), pa.array(k2[edge]), *blobs], names=["kind", "k1", "k2", "a", "b"])


def _publish(chosen, flags, flag_at, windows, home, raw, begin, size, of, k1, k2, lo, span, buckets) -> pa.Table:
    """The distinct windows of each home's hot contexts, by bucket of their hash. Those not found twice here name their place, for an answer."""
    text = raw[K.ragged(begin[chosen], size[chosen])]
    at = np.cumsum(size[chosen]) - size[chosen]
    hashes, second = (K.window_hash(K.prefix_hash(t), span)[K.ragged(at, windows[chosen])] for t in (text, _OTHER[text]))
    known = flags[K.ragged(flag_at[chosen], windows[chosen])]
    context = np.repeat(np.arange(len(chosen)), windows[chosen])
    offset = K.ragged(np.zeros(len(chosen), np.int64), windows[chosen])
    owner = np.zeros(len(size), np.int64)
    owner[of] = np.arange(len(of))  # an unknown window's context has one reference
    r = owner[chosen][context]
    hashes, own = K.mix(hashes), home[chosen][context]
    # two homes of an anchor can be in one shard; each has its own entry, as if they were in two
    by = np.lexsort((own, second, hashes))
    first = by[np.append(True, (hashes[by][1:] != hashes[by][:-1]) | (second[by][1:] != second[by][:-1]) | (own[by][1:] != own[by][:-1]))]
    hashes, second, known, r, offset = hashes[first], second[first], known[first], r[first], offset[first]
    place = np.where(known, -1, lo[r] + offset)
    parts = list(_deal((hashes % U64(buckets)).astype(np.int64), {"a": (hashes, U64), "k1": (k1[r], I64), "k2": (k2[r], I64), "p": (place, I64), "s": (second, U64)}, "kind"))
    rows = []
    for x in parts[0].to_pylist():
        rows.append((x["kind"], 0, 0, x["a"], x["k1"] + x["k2"] + x["p"] + x["s"]))
    cols = list(zip(*rows, strict=True))
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["kind", "k1", "k2", "a", "b"])


def _merge_published(table: pa.Table) -> pa.Table:
    """Windows that several homes published, by binary search in the merged list; each home publishes a window once."""
    h = _joined(table, "a", U64)
    four = [np.frombuffer(x.as_py(), I64).reshape(4, -1) for c in table.column("b").chunks for x in c]
    k1, k2, place, second = np.concatenate(four, axis=1) if four else np.zeros((4, 0), I64)
    merged = np.sort(h)
    at = np.flatnonzero(np.searchsorted(merged, h, side="right") - np.searchsorted(merged, h, side="left") > 1)
    by = at[np.lexsort((second[at], h[at]))]
    same = (h[by][1:] == h[by][:-1]) & (second[by][1:] == second[by][:-1])
    several = np.zeros(len(h), bool)
    several[by[1:][same]] = several[by[:-1][same]] = True
    keep = several & (place >= 0)
    return _by_text(k1[keep], k2[keep], place[keep], place[keep] + 1)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, row offsets in words) of all words."""
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offsets, WORD)
    return K.slice_hash(K.prefix_hash(low), starts, ends), starts, ends, rows


def _find_word_anchors(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copies = (batch.column(c).to_numpy() for c in ("k1", "k2", "copies"))
            for lo, _, data, offsets in K.text_chunks(batch.column("text")):
                h, _, _, rows = _word_hashes(data, offsets)
                a, row, start, n, _ = anchors(h, rows, words, max(1, words // 2))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(I64)), pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array(copies[lo + row]), pa.array(start), pa.array(n)], names=["h", "k1", "k2", "copies", "lo", "n"])

    return run


def _word_windows(words: int, buckets: int):
    """The windows of each text that its anchors in ``found`` own, as ``_SPANS``: those that several documents hold as far as a task can tell, of kind -2, and what is to be compared with other tasks' by bucket of their anchor."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        bucket, w, w2, k1, k2, copies, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        _, edge, group = _groups(w, w2)
        known = _several(edge, group, k1, k2, copies > 1)
        yield from _joined_spans(k1[known], k2[known], a[known], b[known]).to_batches()
        # a window that is known to be shared goes once, for others to learn it; all others go with their places, for an answer
        once = np.zeros(len(w), bool)
        once[edge] = True
        go = np.flatnonzero(once | ~known)
        go = go[np.argsort(bucket[go], kind="stable")]
        place = np.where(known[go], -1, a[go])
        k1, k2, b = (np.where(known[go], 0, x[go]) for x in (k1, k2, b))
        cut = np.append(np.flatnonzero(np.diff(bucket[go], prepend=-1)), len(go))
        columns = (_blobs(cut, w[go]), _blobs(cut, w2[go].view(I64), k1, k2, place.astype(np.int32), b.astype(np.int32)))
        zero = pa.array(np.zeros(len(cut) - 1, I64))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[go][cut[:-1]].astype(np.int32)), zero, zero, *columns], names=["kind", "k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            k1, k2, copies = (batch.column(c).to_numpy() for c in ("k1", "k2", "copies"))
            found = batch.column("found")
            ends, anchor, first, count = found.offsets.to_numpy(), *(found.values.field(c).to_numpy() for c in ("h", "lo", "n"))
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                h, starts, stops, rows = _word_hashes(data, offsets)
                own = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                at, row = K.ragged(rows[row] + first[own], count[own]), np.repeat(row, count[own])
                if not len(at):
                    continue
                bucket = np.repeat((K.mix(anchor[own].view(U64)) % U64(buckets)).astype(I64), count[own])
                w, w2 = (K.window_hash(K.prefix_hash(x), words)[at] for x in (h, K.mix(h ^ U64(0x5EED))))
                held.append((bucket, w, w2, k1[lo + row], k2[lo + row], copies[lo + row], starts[at] - offsets[row], stops[at + words - 1] - offsets[row]))
                total += len(at)
                if total >= WINDOWS:
                    yield from send(held)
                    held, total = [], 0
        if held:
            yield from send(held)

    return run


def _groups(w: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, a member of each group, the group of each) of equal pairs of hashes."""
    by = np.lexsort((w2, w))
    new = np.append(True, (w[by][1:] != w[by][:-1]) | (w2[by][1:] != w2[by][:-1]))[: len(by)]
    group = np.empty(len(by), I64)
    group[by] = np.cumsum(new) - 1
    return by, by[new], group


def _several(edge: np.ndarray, group: np.ndarray, k1: np.ndarray, k2: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the group of each window has one that is known to be shared, or windows of different texts."""
    other = known | (k1 != k1[edge][group]) | (k2 != k2[edge][group])
    return np.bincount(group[other], minlength=len(edge))[group] > 0


def _blobs(cut: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """The bytes of the columns, one after the other, between each two cuts."""
    return pa.array([b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())


def _joined_spans(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Windows as ``_SPANS`` of kind -2, where a is a start, b an end; those of a text that overlap are one."""
    by = np.lexsort((a, k2, k1))
    k1, k2, a, b = k1[by], k2[by], a[by], b[by]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (a[1:] > b[:-1]))[: len(by)]  # of a text's windows the later start has the later end
    last = np.append(new[1:], True)[: len(by)]
    return _by_text(k1[new], k2[new], a[new], b[last], -2)


def _merge_words(table: pa.Table) -> pa.Table:
    """Windows that several texts published, or that one task knew to be shared."""
    parts = []
    for x, y in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        n = len(x) // 8
        parts.append((np.frombuffer(x, U64), *np.frombuffer(y, I64, 3 * n).reshape(3, n), *np.frombuffer(y, np.int32, 2 * n, 24 * n).reshape(2, n)))
    w, w2, k1, k2, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, edge, group = _groups(w, w2)
    keep = _several(edge, group, k1, k2, a < 0) & (a >= 0)
    return _joined_spans(k1[keep], k2[keep], a[keep], b[keep])


def _word_runs(t: DataFrame, words: int) -> tuple[DataFrame, list[Table]]:
    """The windows of ``words`` words that several documents hold, as ``_SPANS``, and the tables to drop after use."""

    long_enough = t.where(F.octet_length("text") >= 2 * words - 1)
    places = Table(long_enough.select("k1", "k2", "copies", "text").mapInArrow(_find_word_anchors(words), "h long, k1 long, k2 long, copies long, lo long, n long"), release=False)
    # counts are written for the same reason as those of byte anchors
    edges = [f(c).alias(f"{n}_{c}") for c in ("k1", "k2") for n, f in (("min", F.min), ("max", F.max))]
    again = Table(places.df.groupBy("h").agg(*edges, F.max("copies").alias("copies")).where("copies > 1 or min_k1 <> max_k1 or min_k2 <> max_k2").select("h"))
    found = places.df.join(again.df, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "lo", "n")).alias("found"))
    # windows move once, packed by bucket; a task sends what it knows to be shared once, so a window of very many texts is a row a task
    windows = Table(t.select("k1", "k2", "copies", "text").join(found.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_word_windows(words, partitions(t.sparkSession)), _SPANS))
    places.drop()
    again.drop()
    merged = windows.df.where("kind >= 0").groupBy("kind").applyInArrow(_merge_words, _SPANS)
    return windows.df.where("kind < 0").unionByName(merged), [windows]


def _ranges(parts: list[dict], kind: int, longer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans of a kind cover; their ends are ``longer`` on."""
    own = [p for p in parts if (p["kind"] == -2) == (kind == -2)]
    if not own:
        return np.zeros(0, I64), np.zeros(0, I64)
    a, b = (np.frombuffer(b"".join(p[c] for p in own), I64) for c in ("a", "b"))
    return K.runs(K.covered(a, b + longer, n), K.row_starts(np.array([0, n]), n))


def _finish(span: int, keep_text: bool, cut_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            copies, found = batch.column("copies").to_numpy(), batch.column("spans")
            n_bytes, removed, n_spans, sha, starts, ends, texts, passages, inside = [], [], [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                n = len(text)
                parts = found[i].as_py() or []
                p, q = _ranges(parts, -2, 0, n)
                if copies[i] > 1 and n >= span:
                    a, b = np.array([0]), np.array([n])
                else:
                    a, b = _ranges(parts, -1, span - 1, n)
                    if cut_words and len(p):
                        a, b = np.concatenate([a, p]), np.concatenate([b, q])
                        a, b = K.runs(K.covered(a, b, n), K.row_starts(np.array([0, n]), n))
                if len(a):
                    keep = np.ones(n, bool)
                    for x, y in zip(a, b, strict=True):
                        keep[x:y] = False
                    kept = text[keep].tobytes()
                else:
                    kept = text.tobytes()
                n_bytes.append(n)
                removed.append(int((b - a).sum()))
                n_spans.append(len(a))
                sha.append(hashlib.sha256(kept).hexdigest())
                starts.append(a)
                ends.append(b)
                texts.append(kept.decode(errors="ignore") if len(a) else None)
                passages.append(len(p))
                inside.append(int((q - p).sum()))
            out = [batch.column("k1"), batch.column("k2"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(sha, pa.string()), pa.array(passages, pa.int64()), pa.array(inside, pa.int64())]
            out += [pa.array(texts, pa.string())] if keep_text else [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", *(["kept"] if keep_text else ["starts", "ends"])])

    return run


def _keys(text: str):
    """Two independent 64-bit hashes of a text; null is the empty text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(0x5EED), t).alias("k2")


def find(docs: DataFrame, text: str = "text", span: int = SPAN, gram: int = GRAM, hot: int = HOT, keep_text: bool = False, shard_bytes: int = SHARD_BYTES, words: int = 0, cut_words: bool = True) -> DataFrame:
    """The distinct texts by (k1, k2) with n_bytes, n_removed, n_spans, kept_sha256, n_passages and passage_bytes (maximal runs of ``words`` words that other documents hold), and starts and ends of what goes or, with ``keep_text``, kept: the rest as text, null where nothing goes; a codepoint that a cut splits goes whole."""
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select(*_keys(text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    table = Table(texts, n, ("k1", "k2"))
    t = table.df
    places = Table(t.where(F.octet_length("text") >= span).select("k1", "k2", "text").mapInArrow(_find_anchors(span, gram), "h long, k1 long, k2 long, lo long, n long, places long"), release=False)
    # counts combine before the shuffle; they are written, so that both sides of the join are shuffles and Spark can split it where an anchor occurs very often
    again = Table(places.df.groupBy("h").agg(F.sum("places").alias("m")).where("m > 1"), release=False)
    found = places.df.join(again.df, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "lo", "n", "m", "places")).alias("found"))
    contexts = t.select("k1", "k2", "text").join(found.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_contexts(SHARDS * n, span, gram, hot), "shard int, " + ", ".join(f"{c} binary" for c in _CONTEXT_NAMES[1:]))
    shards = Table(contexts.groupBy("shard").applyInArrow(_shard(span, hot, n, shard_bytes), _SPANS))
    merged = shards.df.where("kind >= 0").groupBy("kind").applyInArrow(_merge_published, _SPANS)
    places.drop()
    again.drop()
    every, used = shards.df.where("kind < 0").unionByName(merged), []
    if words:
        runs, used = _word_runs(t, words)
        every = every.unionByName(runs)
    spans = every.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans"))
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, " + ("kept string" if keep_text else "starts array<long>, ends array<long>")
    done = Table(t.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").mapInArrow(_finish(span, keep_text, cut_words), schema))
    for x in (shards, *used, table):
        x.drop()
    return done.df


def dedup(docs: DataFrame, text: str = "text", span: int = SPAN, keep_text: bool = False, **options) -> DataFrame:
    """Every row of ``docs`` with the columns of ``find`` for its text; they replace columns of the same names."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "starts", "ends", "kept", "k1", "k2")
    found = find(docs, text, span, keep_text=keep_text, **options)
    k1, k2 = _keys(text)
    rows = docs.withColumns({"_k1": k1, "_k2": k2})
    return rows.join(found, (F.col("_k1") == found.k1) & (F.col("_k2") == found.k2), "left").drop("_k1", "_k2", "k1", "k2")


def strip_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated strings cut out of their text; a row whose text is cut to nothing goes."""
    kept = find(docs, text, keep_text=True, **options).where("n_removed > 0").select("k1", "k2", "kept")
    k1, k2 = _keys(text)
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), k1, k2).join(kept, ["k1", "k2"], "left")
    columns = [F.coalesce("kept", f"_row.{c}").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return both.where("kept is null or kept <> ''").select(*columns)
