"""N-gram Jaccard join by prefixes under several global orders of the shingles.

A document's set holds its distinct ``SHINGLE``-word shingles; two documents link when their sets
have a Jaccard similarity of ``THRESHOLD`` hundredths or more. If they do, then under *any* order
of all shingles the first ``n - ceil(t n) + 1`` of each set share one. Two orders are used; both put
shingles that are frequent, by a fixed-size count sketch of the corpus, last, and break ties by
different hashes. The sketch only decides how few candidates there are, never which links are found.

1. Equal texts become one node, the least of their keys; nodes' texts go to a bucketed table.
2. Sketch; then each node's size, prefixes under both orders and a parity bitmap of its set.
3. Of the shingles of the first order's prefixes those of one node only go.
4. Chains: within a shingle's nodes, dealt into parts of about ``BLOCK`` anew for each shingle,
   neighbours by first shingle of the second order and by size are candidates, as many as members;
   ``HEADS`` nodes of each part and size class are chained across the parts too. In groups of more than
   ``SMALL`` nodes every node is also a candidate with ``HEADS`` others of its size class and with the
   one whose shingles are the most shared, the middle of copies that are farther from each other. Those whose second prefixes share a
   shingle, and whose bitmaps don't rule them out, are verified on whole sets; their links give first
   components.
5. All other pairs: within each shingle's nodes, only pairs of *different* components can still
   change the result. Members of size classes in or beside which several components meet, which
   combine before the shuffle, are compared in blocks by size and bitmap; pairs whose second prefixes
   also share a shingle are verified. Of shingles of the same members one stays. Large groups are split into blocks, each pair of blocks a task.

So a group of m near copies costs m verified pairs, not m squared, and no link between components
is lost. A parity bitmap has a bit per hash bucket, set for an odd count: bits that differ are at
most the shingles that the sets do not share.

Defined cases: a text without words, or null, has an empty set and is its own component; with fewer
words than ``SHINGLE`` all its words are its one shingle; rows that share a key count as one
document, which links where any of its texts does; a null key links with nothing and has a null
component; repeated rows each give a row; a very long text is one set, held whole by the task that
reads it; columns other than the key and the text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcavec.llm import kernels as K
from arcavec.llm.components import connected_components
from arcavec.llm.scratch import Table, partitions

SHINGLE = 3
THRESHOLD = 90
SKETCH_BITS = 24
SLICES = 64
#: How many parts of a sketch are added up in one task.
FAN_IN = 32
BITS = 512
BLOCK = 512
HEADS = 3
#: In groups of at most so many nodes all pairs cost little.
SMALL = 64

U64 = np.uint64
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_SEEDS = (U64(0x1234567890ABCDEF), U64(0xFEDCBA0987654321))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the set of each row, ascending by hash."""
    low = K.LOWER[data]
    starts, ends, words = K.words(low, offsets, _WORD)
    h, rows = K.shingle_hash(K.slice_hash(K.prefix_hash(low), starts, ends), words, shingle)
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    by = _by_row(row, h, len(rows) - 1)
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(rows), dtype=np.uint64))


def _by_row(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """The order by row, then by key (by its leading bits where rows take the others)."""
    bits = U64(max(1, int(rows).bit_length()))
    return np.argsort((row << (U64(64) - bits)) | (key >> bits))


def needed(n: np.ndarray, threshold: int) -> np.ndarray:
    """The least number of shared shingles that a set of n needs with any partner."""
    return (threshold * n + 99) // 100


def prefixes(h: np.ndarray, rows: np.ndarray, level: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, row offsets) of each row's prefix under each order."""
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    rank = level[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(56)
    size = np.where(n > 0, n - needed(n, threshold) + 1, 0)
    out = []
    for seed in _SEEDS:
        by = _by_row(row, rank | (K.mix(h ^ seed) >> U64(8)), len(n))
        out.append((h[by][K.ragged(rows[:-1], size)], np.concatenate([[0], np.cumsum(size)])))
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts up to 255 tell frequent from rare as well as exact ones, and pack well; larger ones are rounded down to 16 steps a doubling."""
    return zlib.compress(np.where(counts < 16, counts, 16 * np.log2(np.maximum(counts, 16)) - 48).astype(np.uint16).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    code = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.float64)
    return np.where(code < 16, code, 2 ** ((code + 48) / 16))


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                h, _ = shingle_sets(data, offsets, shingle)
                np.add.at(counts, (h >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([_packed(p) for p in counts.reshape(SLICES, -1)], pa.binary())], names=["slice", "n"])

    return run


def _add_slices(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SLICES)
    for c in table.column("n").chunks:
        for x in c:
            total += _unpacked(x.as_py())
    return pa.table({"slice": table.column("slice").slice(0, 1), "n": pa.array([_packed(total)], pa.binary())})


def levels(texts: DataFrame, shingle: int, tasks: int) -> np.ndarray:
    """For each bucket of the sketch how frequent it is, on a scale of a byte: 2**SKETCH_BITS bytes for a corpus of any size. The sketches of ``tasks`` tasks are added up by a tree of ``FAN_IN``."""
    got = texts.select("text").mapInArrow(_sketch(shingle), "slice int, n binary").withColumn("part", F.spark_partition_id())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        got = got.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("slice", "part").applyInArrow(_keep_part(_add_slices), "slice int, n binary, part int")
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in got.collect():
        out[r.slice] = np.minimum(255, 8 * np.log2(1.0 + _unpacked(r.n))).astype(np.uint8)
    return out.ravel()


def _keep_part(add):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return add(table).append_column("part", pa.array([key[1].as_py()], pa.int32()))

    return run


def _short(h: np.ndarray) -> np.ndarray:
    return (K.mix(h) >> U64(32)).astype(np.uint32)


def _info(shared, shingle: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                h, rows = shingle_sets(data, offsets, shingle)
                _, (b, b_rows) = prefixes(h, rows, level, threshold)
                n = np.diff(rows)
                row = np.repeat(np.arange(hi - lo), n)
                odd = np.bincount(row * BITS + (h & U64(BITS - 1)).astype(np.int64), minlength=(hi - lo) * BITS) & 1
                bits = np.packbits(odd.reshape(hi - lo, BITS).astype(bool), axis=1)
                short = _short(b)
                blobs = pa.array([short[i:j].tobytes() for i, j in zip(b_rows[:-1], b_rows[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo), pa.array(n), blobs, pa.array([x.tobytes() for x in bits], pa.binary())], names=["rep", "n", "b", "bits"])

    return run


def _entries(shared, shingle: int, threshold: int):
    """A row for each shingle of the first order's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                h, rows = shingle_sets(data, offsets, shingle)
                (a, a_rows), (b, b_rows) = prefixes(h, rows, level, threshold)
                n, count = np.diff(rows), np.diff(a_rows)
                lead = np.where(n > 0, b[np.minimum(b_rows[:-1], max(len(b) - 1, 0))] if len(b) else 0, U64(0)).astype(U64).view(np.int64).astype(np.int32)
                columns = [np.repeat(x, count) for x in (batch.column("rep").slice(lo, hi - lo).to_numpy(), n, lead)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), *columns)], names=["tok", "rep", "n", "lead"])

    return run


def _near(bits_x: np.ndarray, bits_y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes and bitmaps allow a link: sets of sizes p and q that link differ in (100 - t) / (100 + t) of p + q at most."""
    differ = np.bitwise_count(bits_x ^ bits_y).sum(axis=-1).astype(np.int64)
    return (differ * (100 + threshold) <= (100 - threshold) * (n_x + n_y)) & (100 * np.minimum(n_x, n_y) >= threshold * np.maximum(n_x, n_y))


def _share(x: bytes, y: bytes) -> bool:
    return not set(memoryview(x).cast("I")).isdisjoint(memoryview(y).cast("I"))


def _filter(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bx, by = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(-1, BITS // 64) for c in ("bits_x", "bits_y"))
            ok = _near(bx, by, batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy(), threshold)
            at = np.flatnonzero(ok)
            px, py = batch.column("b_x"), batch.column("b_y")
            at = at[[_share(px[int(i)].as_py(), py[int(i)].as_py()) for i in at]] if len(at) else at
            yield pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(at)), batch.column("y").take(pa.array(at))], names=["x", "y"])

    return run


def _set_of(shingle: int):
    """Adds the set of the text of x to each pair and lets the text go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                h, rows = shingle_sets(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column("x").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())], names=["x", "y", "set"])

    return run


def _verify(shingle: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], batch.column("set")
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                h, rows = shingle_sets(data, offsets, shingle)
                for i in range(hi - lo):
                    x, y = np.frombuffer(sets[lo + i].as_py(), U64), h[rows[i] : rows[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(threshold: int):
    """Candidates of different components among the members of each (shingle, block, block)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tok, i, j, own, rep, n, comp = (table.column(c).to_numpy() for c in ("tok", "i", "j", "own", "rep", "n", "component"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), U64).reshape(-1, BITS // 64)
        toks = table.column("toks")
        toks = toks if isinstance(toks, pa.Array) else pa.concat_arrays(toks.chunks) if toks.num_chunks else pa.array([], toks.type)
        cut, every, some = toks.offsets.to_numpy(), toks.values.to_numpy(), toks.is_valid().to_numpy(zero_copy_only=False)

        def first_common(a: int, b: int, tok: int) -> bool:
            if not (some[a] and some[b]):
                return True
            x, y = every[cut[a] : cut[a + 1]], every[cut[b] : cut[b + 1]]
            return not np.isin(x[: np.searchsorted(x, tok)], y).any()

        by = np.lexsort((own, j, i, tok))
        edge = np.flatnonzero(np.append(True, (tok[by][1:] != tok[by][:-1]) | (i[by][1:] != i[by][:-1]) | (j[by][1:] != j[by][:-1]))) if len(by) else np.zeros(0, np.int64)
        found: set[tuple[int, int]] = set()
        for lo, hi in zip(edge, np.append(edge[1:], len(by)), strict=True):
            members = by[lo:hi]
            if (comp[members] == comp[members[0]]).all():
                continue
            first = members if i[members[0]] == j[members[0]] else members[own[members] == i[members[0]]]
            second = members if i[members[0]] == j[members[0]] else members[own[members] == j[members[0]]]
            for start in range(0, len(first), 128):
                f = first[start : start + 128]
                ok = (comp[f][:, None] != comp[second][None, :]) & (rep[f][:, None] != rep[second][None, :])
                p, q = np.nonzero(ok)
                for part in range(0, len(p), 1 << 17):
                    a, b = f[p[part : part + (1 << 17)]], second[q[part : part + (1 << 17)]]
                    ok = np.flatnonzero(_near(bits[a], bits[b], n[a], n[b], threshold))
                    ok = ok[[first_common(p, q, tok[members[0]]) for p, q in zip(a[ok].tolist(), b[ok].tolist(), strict=True)]] if len(ok) else ok
                    found.update(zip(np.minimum(rep[a[ok]], rep[b[ok]]).tolist(), np.maximum(rep[a[ok]], rep[b[ok]]).tolist(), strict=True))
        return pa.table({"x": pa.array([p[0] for p in found], pa.int64()), "y": pa.array([p[1] for p in found], pa.int64())})

    return run


def one_of_alike(members: DataFrame) -> DataFrame:
    """Of shingles that have the same members, by their number and 120 bits of sums of hashes, the least with its members; so a pair of nodes that share shingles still shares one."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "rep", "n"), 24)).alias(f"_{k}") for k in range(3)]
    alike = members.groupBy("tok").agg(F.count("*").alias("_n"), *sums)
    return members.join(alike.groupBy("_n", "_0", "_1", "_2").agg(F.min("tok").alias("tok")).select("tok"), "tok")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    parts = partitions(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(0x5EED), body).alias("k2"), body.alias("text"))
    keys = rows.select("doc", "k1", "k2")
    reps = Table(keys.groupBy("k1", "k2").agg(F.min("doc").alias("rep")))
    own = reps.df.select("rep", F.col("k1").alias("_1"), F.col("k2").alias("_2")).hint("shuffle_hash")
    # the key alone deals the rows, so that each task writes one bucket; bit operations keep the other conditions out of the join's keys
    same = (F.col("k1").bitwiseXOR(F.col("_1")) == 0) & (F.col("k2").bitwiseXOR(F.col("_2")) == 0)
    nodes = rows.join(own, (F.col("doc") == F.col("rep")) & same)
    texts = Table(nodes.select("rep", "text"), parts, ("rep",))
    level = spark.sparkContext.broadcast(levels(texts.df, shingle, parts))
    # first prefixes are by far the most bytes; they are read from the texts, so that they take space only until their groups are known
    entries = Table(texts.df.mapInArrow(_entries(level, shingle, threshold), "tok long, rep long, n long, lead int"))
    # counts combine before the shuffle; they are written, so that both sides of the join are shuffles and Spark can split it where a shingle is in very many prefixes
    often = Table(entries.df.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1"), release=False)
    groups = Table(entries.df.join(often.df, "tok"))
    entries.drop()
    often.drop()
    info = Table(texts.df.mapInArrow(_info(level, shingle, threshold), "rep long, n long, b binary, bits binary"), parts, ("rep",))
    used: list[Table] = []

    def filtered(pairs: DataFrame) -> DataFrame:
        # only nodes of pairs move; which they are is small, and the others stay in their buckets
        pairs = Table(pairs)
        used.append(pairs)
        nodes = pairs.df.select(F.col("x").alias("rep")).unionByName(pairs.df.select(F.col("y").alias("rep"))).distinct()
        one = info.df.join(nodes, "rep", "left_semi")
        x, y = (one.toDF(c, f"n_{c}", f"b_{c}", f"bits_{c}") for c in "xy")
        return pairs.df.join(x, "x").join(y, "y").mapInArrow(_filter(threshold), "x long, y long")

    def verified(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(texts.df.toDF("x", "text"), "x").mapInArrow(_set_of(shingle), "x long, y long, set binary")
        return with_x.join(texts.df.toDF("y", "text"), "y").select("x", "y", "set", "text").mapInArrow(_verify(shingle, threshold), "a long, b long")

    # sizes in classes such that sets that link are in one or in neighbouring ones
    members = groups.df.withColumns({"class": F.floor(F.ln(F.col("n").cast("double")) / float(np.log(100 / threshold)) + 1e-9), "part": F.pmod(F.xxhash64("rep", "tok"), F.ceil(F.col("m") / block)).cast("int")})

    def pairs_of(both: DataFrame) -> DataFrame:
        like = (F.col("rep") != F.col("before")) & (100 * F.least("n", "n_before") >= threshold * F.greatest("n", "n_before"))
        return both.where(like).select(F.least("rep", "before").alias("x"), F.greatest("rep", "before").alias("y"))

    def neighbours(rows: DataFrame, *by: str) -> DataFrame:
        chain = Window.partitionBy(*by).orderBy("lead", "n", "rep")
        return pairs_of(rows.select("rep", "n", F.lag("rep").over(chain).alias("before"), F.lag("n").over(chain).alias("n_before")))

    # each shingle deals its group anew, so copies that share several come together in one part or another; besides, of a large group a few of each part and size class are chained across its parts
    heads = members.where(F.col("m") > block).groupBy("tok", "class", "part").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "rep"), "lead", "n", "rep")).alias(f"_{k}") for k in range(HEADS)))
    heads = heads.select("tok", "class", F.explode(F.array(*(f"_{k}" for k in range(HEADS)))).alias("_h")).select("tok", "class", "_h.lead", "_h.n", "_h.rep")
    # copies of one text can be farther from each other than from it: in groups that aren't small every node also meets the node whose shingles are the most shared, and a few others
    many = members.where(F.col("m") > SMALL)
    central = groups.df.groupBy("rep").agg(F.avg("m").alias("central"))
    picks = [F.max(F.struct("central", "n", "rep")), *(F.min(F.struct(F.xxhash64(F.lit(-1 - k), "rep").cast("double").alias("central"), "n", "rep")) for k in range(HEADS))]
    hubs = many.join(central, "rep").groupBy("tok", "class").agg(*(p.alias(f"_{k}") for k, p in enumerate(picks)))
    hubs = hubs.select("tok", "class", F.explode(F.array(*(f"_{k}" for k in range(len(picks))))).alias("_hub"))
    hubs = hubs.select("tok", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("_hub.rep").alias("before"), F.col("_hub.n").alias("n_before"))
    spokes = pairs_of(many.join(hubs, ["tok", "class"]))
    chained = neighbours(members, "tok", "part").unionByName(neighbours(heads, "tok", "class")).unionByName(spokes).distinct()
    links = Table(verified(filtered(chained)))
    first = connected_components(links.df)

    members = members.drop("part").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    edges = (F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    classes = members.groupBy("tok", "class").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    near = classes.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))).groupBy("tok", "class").agg(*edges)
    # the classes are written, so that both sides of the join are shuffles and Spark can split it where a class is large
    mixed = Table(near.where("_lo <> _hi").select("tok", "class"), release=False)
    every = Table(members.join(mixed.df, ["tok", "class"]).drop("class", "lead"), release=False)
    open_ = Table(one_of_alike(every.df))
    every.drop()
    # the shingles at which a node is looked at: a pair counts at the first that both have. Of a key with several texts all count
    single = reps.df.groupBy("rep").agg((F.count("*") == 1).alias("_single"))
    lists = open_.df.groupBy("rep").agg(F.sort_array(F.collect_set("tok")).alias("toks")).join(single, "rep").select("rep", F.when(F.col("_single"), F.col("toks")).alias("toks"))
    open_with = open_.df.join(lists, "rep").join(info.df.select("rep", "bits"), "rep")
    n_blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), n_blocks).cast("int")
    spread = open_with.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select("tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "component", "bits", "toks")
    more = spread.groupBy(F.pmod(F.xxhash64("tok", "i", "j"), F.lit(4 * parts)).alias("task")).applyInArrow(_blocks(threshold), "x long, y long").distinct()
    rest = Table(verified(filtered(more)))
    final = connected_components(rest.df.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    sizes = info.df.select("rep", "n")
    # one row for each distinct text first; then rows meet it by text, in a join that Spark can split where a text has very many copies
    by_text = Table(reps.df.join(sizes.groupBy("rep").agg(F.max("n").alias("n")), "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left"))
    out = keys.join(by_text.df, ["k1", "k2"])
    out = Table(out.select(F.col("doc").alias(key), F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("doc").isNull(), None).when(F.coalesce("n", F.lit(0)) == 0, F.col("doc")).otherwise(F.coalesce("component", "rep")).alias("component_id")))
    for t in (reps, texts, info, groups, links, mixed, open_, *used, rest, by_text):
        t.drop()
    return out.df
