import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from brute import DATA, WORD, decontamination, repeats, similar
from pyspark.sql import functions as F

from arcavec.llm import bpe, decontaminate, kernels as K, license_scan, ngram_join, suffix_dedup
from arcavec.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(60)] + ["Ünü", "É", "x1"]
EMPTY = "doc_id long, text string"


def texts_of(seed, n=60, most=90):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), EMPTY)


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, block_words):
    rnd = random.Random(1)
    items = [(i, t) for i, t in enumerate(texts_of(2, 12, 40))] + [(50, "w1, W2!"), (51, None), (52, ""), (53, "..."), (50, "w3"), (None, "w4")]
    texts = [*texts_of(3), None, "", "...", "w1 w2", "W1-w2 w3"]
    for k in range(20):  # passages of the items, in part, in other letters, twice
        w = items[k % 12][1].split()
        a = rnd.randint(0, max(0, len(w) - 13))
        texts.append(f"{texts[k]} {' - '.join(w[a : a + rnd.randint(10, 20)]).upper()} {texts[k]} {' '.join(w)}")
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench, block_words=block_words).collect()}
    assert [got[i] for i in range(len(texts))] == decontamination(list(enumerate(texts)), [x for x in items if x[0] is not None])
    assert {r.n_items for r in decontaminate.report(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    from brute import without_hits

    cut = {r.doc_id: r.text for r in decontaminate.without_hits(docs.where("text is not null"), bench.where("item_id is not null"), block_words=block_words).collect()}
    assert cut == dict(without_hits([(i, t) for i, t in enumerate(texts) if t is not None], [x for x in items if x[0] is not None]))


@pytest.mark.parametrize("block_words", [1 << 20, 20])
def test_decontamination_of_repeated_keys_and_long_texts(spark, block_words):
    items = [(i, t) for i, t in enumerate(texts_of(5, 8, 40))]
    texts = [items[1][1], items[2][1] + " x " + items[5][1], "nothing", items[1][1], "pad " * 30_000 + items[3][1], None]
    docs = spark.createDataFrame([(k, t) for k, t in zip((7, 7, 7, 7, None, None), texts, strict=True)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench, block_words=block_words).collect())
    assert got == sorted(decontamination(list(enumerate(texts)), items))


@pytest.mark.parametrize("hot", [512, 6])
def test_repeats_equal_brute_force(spark, hot):
    rnd = random.Random(4)
    rand = lambda n, letters="ab ": "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    passage = rand(0) + "".join(rnd.choice("abcdefgh") for _ in range(90))
    texts = [rand(400) for _ in range(20)]
    texts += [None, "", "x" * 300, "é" * 100, *texts[:3], *(t[:90] + "#" + t[110:] for t in texts[:8]), *(rand(60, "klmn") + passage + rand(60, "klmn") for _ in range(40))]
    docs = docs_of(spark, texts).withColumn("n_bytes", F.lit("a name that clashes"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, span=40, gram=20, hot=hot).collect()}
    wanted = repeats(texts, 40)
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in wanted]
    cut = {r.doc_id: r.text for r in suffix_dedup.strip_repeats(docs, span=40, gram=20, hot=hot).collect()}
    assert cut == {i: w[4] if w[1] else texts[i] for i, w in enumerate(wanted) if w[4] or not w[1]}
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "3"])
def test_homes_of_a_hot_anchor_that_meet_in_one_shard(spark, parts):
    rnd = random.Random(8)
    rand = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    many = rand(200_000)
    least = int(np.argmin(K.window_hash(K.prefix_hash(np.frombuffer(many.encode(), np.uint8)), 20)))
    core = many[least : least + 20]  # the anchor of all windows that hold it
    pairs = [rand(15) + core + rand(15) for _ in range(30)]  # each stands in two texts
    texts = [rand(30) + p + rand(30) for p in pairs for _ in range(2)] + [rand(30) + core + rand(30) for _ in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # hot anchors are dealt to many homes, and no two homes share a suffix array
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs_of(spark, texts), span=40, gram=20, hot=6, shard_bytes=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = repeats(texts, 40)
    assert sum(w[1] > 0 for w in wanted) == 60
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in wanted]


@pytest.mark.parametrize("hot", [512, 6])
def test_periodic_stretches_equal_brute_force(spark, hot):
    rnd = random.Random(3)
    rand = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    texts = ["x" * 5000, "x" * 39, "x" * 41 + "y", "pq" * 3000, rand(70) + "pq" * 25 + rand(70), "abc " * 1500 + rand(90), rand(50) + "c ab" * 900 + "z" * 60, rand(2500), " " * 3000 + rand(300) + " " * 2600]
    texts += [rand(60) + "klmnopqrstuvwxyz0123" * 130 + rand(60), "mnopqrstuvwxyz0123klmnopqrstuvwxyz0123klmnop" + rand(9), (rand(45) * 60)[:2690]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs_of(spark, texts), span=40, gram=20, hot=hot).collect()}
    wanted = repeats(texts, 40)
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in wanted]


def test_contexts_of_equal_hashes_are_told_apart_by_their_bytes():
    raw = np.frombuffer(b"abcabdabcabdxyz", np.uint8)
    begin, size = np.arange(0, 15, 3), np.full(5, 3)
    same = np.zeros(5, np.uint64)
    first, which = suffix_dedup._distinct([same, same], raw, begin, size)
    assert len(first) == 3
    assert [[int(a == b) for b in which] for a in which] == [[1, 0, 1, 0, 0], [0, 1, 0, 1, 0], [1, 0, 1, 0, 0], [0, 1, 0, 1, 0], [0, 0, 0, 0, 1]]
    assert (which[first] == np.arange(3)).all()


def test_memory_of_a_long_run_of_one_character_is_bounded():
    code = """
import resource, numpy as np, pyarrow as pa
from arcavec.llm import suffix_dedup as S
text = pa.array([b"x" * 10_000_000 + b"".join(b"%d " % i for i in range(1000))]).cast(pa.string())
row = pa.record_batch({"k1": pa.array([1]), "k2": pa.array([2]), "text": text})
(found,) = S._find_anchors(400, 200)(iter([row]))
f = found.append_column("m", found.column("places"))
rows = pa.record_batch({"k1": pa.array([1]), "k2": pa.array([2]), "text": text, "found": pa.array([f.select(["h", "lo", "n", "m", "places"]).to_pylist()])})
sent = list(S._contexts(8, 400, 200, 512)(iter([rows])))
spans = [S._shard(400, 512, 8)(pa.Table.from_batches([b])) for b in sent]
every = [(x["a"], x["b"]) for t in spans for x in t.to_pylist() if x["kind"] < 0]
done = pa.record_batch({"k1": pa.array([1]), "k2": pa.array([2]), "text": text, "copies": pa.array([1]), "spans": pa.array([[dict(kind=-1, a=a, b=b) for a, b in every]])})
(out,) = S._finish(400, False, True)(iter([done]))
print(sum(b.nbytes for b in sent), out.column("n_removed")[0].as_py(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    sent, removed, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ).stdout.split())
    assert removed == 10_000_000
    assert sent < 200_000
    assert peak < 1000


def test_runs_of_words_that_several_documents_hold(spark):
    rnd = random.Random(11)
    vocab = ["a", "b", "é", "w1", "long" * 30]
    rand = lambda n: [rnd.choice(vocab) for _ in range(n)]
    common = rand(12)
    lists = [rand(rnd.randint(0, 30)) for _ in range(60)] + [rand(5) + common + rand(5) for _ in range(20)]
    texts = ["".join(w + rnd.choice((" ", "\n", "\t ")) for w in x) for x in lists]
    texts += [texts[3], texts[3], "", None, "a " * 40]
    holders, words = {}, [(t or "").split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 6):
            holders.setdefault(tuple(w[k : k + 7]), set()).add(i)
    wanted = {}
    for i, (t, w) in enumerate(zip(texts, words, strict=True)):
        at, places = 0, []
        for x in w:
            at = t.index(x, at)
            places.append((at, at := at + len(x)))
        cut = set()
        for k in range(len(w) - 6):
            if len(holders[tuple(w[k : k + 7])]) > 1:
                cut |= set(range(places[k][0], places[k + 6][1]))
        kept = "".join(c for j, c in enumerate(t or "") if j not in cut)
        if kept or not cut:
            wanted[i] = kept if cut else t
    docs = docs_of(spark, texts)
    assert sum(wanted.get(i) != t for i, t in enumerate(texts)) > 20
    plain = suffix_dedup.dedup(docs, span=40, gram=20)
    both = suffix_dedup.dedup(docs, span=40, gram=20, words=7, cut_words=False)  # reports words, cuts bytes
    contract = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(plain.select(*contract).collect()) == sorted(both.select(*contract).collect())
    assert {r.doc_id for r in both.where("n_passages > 0 and passage_bytes > 0").collect()} == {i for i, t in enumerate(texts) if wanted.get(i) != t}
    assert plain.where("n_passages > 0").count() == 0
    shout = docs_of(spark, ["x " + "one, two (three) four-five six seven. y", "ONE two three FOUR five\tsix; seven"])
    assert {r.doc_id: r.text for r in suffix_dedup.strip_repeats(shout, words=7).collect()} == {0: "x . y"}
    got = {r.doc_id: r.text for r in suffix_dedup.strip_repeats(docs, span=100_000, gram=200, words=7).collect()}
    assert got == wanted
    assert suffix_dedup.strip_repeats(docs.limit(0), words=7).count() == 0


def test_windows_of_words_move_once_and_packed():
    own = lambda i: " ".join(f"o{i}x{j}" for j in range(60))
    passage, rare, twice = (" ".join(f"{c}{j}" for j in range(100)) for c in "pqr")
    texts = [f"{own(i)} {passage} {own(i + 1000)}" for i in range(50)] + [f"{own(2000)} {rare}", f"{rare} {own(2001)}", f"{twice} {own(2002)} {twice}", twice.replace("r", "s")]
    copies = [1] * (len(texts) - 1) + [2]

    def task(rows):
        text = pa.array([texts[i] for i in rows])
        keys = {"k1": pa.array(rows), "k2": pa.array([-i for i in rows]), "copies": pa.array([copies[i] for i in rows])}
        (found,) = suffix_dedup._find_word_anchors(51)(iter([pa.record_batch({**keys, "text": text})]))
        found = [[{"h": x["h"], "lo": x["lo"], "n": x["n"]} for x in found.to_pylist() if x["k1"] == i] for i in rows]
        kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())]))
        batch = pa.record_batch({**keys, "text": text, "found": pa.array(found, kind)})
        return pa.Table.from_batches(list(suffix_dedup._word_windows(51, 4)(iter([batch]))))

    sent = pa.concat_tables([task([*range(50), 50, 52]), task([51, 53])])
    packed = sent.filter(pa.array([x >= 0 for x in sent.column("kind").to_pylist()]))
    # each text's own windows, and those of the passage once: 50 texts share 50 of them; a text with copies has different windows, each goes once
    every = sum(max(0, len(t.split()) - 50) for t in texts)
    assert sum(len(x) // 8 for x in packed.column("a").to_pylist()) == every - 49 * 50
    assert sum(map(len, packed.column("b").to_pylist())) == 4 * sum(map(len, packed.column("a").to_pylist()))
    spans = sent.filter(pa.array([x < 0 for x in sent.column("kind").to_pylist()])).to_pylist()
    for bucket in range(4):
        spans += suffix_dedup._merge_words(packed.filter(pa.array([x == bucket for x in packed.column("kind").to_pylist()]))).to_pylist()
    got = {}
    for x in spans:
        for a, b in zip(np.frombuffer(x["a"], np.int64), np.frombuffer(x["b"], np.int64), strict=True):
            got.setdefault(x["k1"], set()).update(range(a, b))
    wanted = [passage] * 50 + [rare, rare, "", texts[53]]
    assert got == {i: set(range(texts[i].find(w), texts[i].find(w) + len(w))) for i, w in enumerate(wanted) if w}


def test_spans_name_the_bytes_that_go(spark):
    a = "0123456789" * 5
    got = suffix_dedup.dedup(docs_of(spark, ["left " + a[:50] + " right", "other " + a[:50]]), span=50, gram=25).orderBy("doc_id").collect()
    assert [(r.starts, r.ends) for r in got] == [([4], [55]), ([5], [56])]  # the space before is common too


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join_equals_brute_force(spark, block):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    rows, n = [], 0
    for copies in [1, 2, 3, 25, 1, 2, 40, 1, 1, 2] * 2:
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n * 7 % 997, "  ".join(w)))
            n += 1
    rows += [(5001, None), (5002, ""), (5003, " \n"), (5004, "A b"), (5005, "a B"), (5006, "a")]
    docs = spark.createDataFrame(rows, EMPTY).withColumn("component_id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, block=block).collect()}
    assert got == similar(rows)


def test_shingles_of_the_same_members_count_once(spark, monkeypatch):
    sent = []

    class Counted(ngram_join.Table):
        def __init__(self, df, *args, **options):
            super().__init__(df, *args, **options)
            if set(df.columns) == {"tok", "rep", "n", "m", "component"}:
                sent.append(self.df.count())

    monkeypatch.setattr(ngram_join, "Table", Counted)
    one, two, three, four = ([f"{c}{i}" for i in range(200)] for c in "abcd")
    # the first three share half of their shingles with each other, so their prefixes share many and they don't link
    rows = [(i, " ".join(w)) for i, w in enumerate([one + two, one + three, two + three, four, [*four, "tail"]])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == similar(rows, 90, 3)
    assert sent[-1] <= 12 < 60 < sent[0]

    members = spark.createDataFrame([(5, 1, 9), (5, 2, 9), (6, 2, 9), (6, 1, 9), (7, 1, 9), (8, 1, 8), (8, 2, 9), (9, 1, 9), (9, 1, 9), (9, 2, 9)], "tok long, rep long, n long")
    assert sorted({r.tok for r in ngram_join.one_of_alike(members).collect()}) == [5, 7, 8, 9]


def test_jaccard_join_of_odd_tables(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.join(spark.createDataFrame(rows, EMPTY)).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert ngram_join.join(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.fixture(scope="module")
def reference_codec():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = vocabulary()
    return ranks, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(reference_codec):
    ranks, library = reference_codec
    rnd = random.Random(6)
    letters = list("'stmdrevl LR1  \n\té!?  x本") + ["'ll", "'re", " '"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += ["", "   ", "a\n\n b", " " * 700 + "x", "z" * 3000, "ab" * 900, " 　a", "'", "''s", "<|endoftext|>"]
    texts += ["a" + c + "1" + c + " " + c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 7)])][::3]
    codec = bpe.Codec(ranks)
    for lo, hi, data, offsets in K.text_chunks(pa.array(texts), 1 << 16):
        ids, at, rows = codec.encode(data, offsets)
        assert codec.decode(ids).tobytes() == data.tobytes()
        for r in range(hi - lo):
            own = ids[rows[r] : rows[r + 1]]
            assert own.tolist() == library.encode_ordinary(texts[lo + r])
            places = at[rows[r] : rows[r + 1]] - offsets[r]
            assert places.tolist() == np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in own)])[: len(own)].tolist()


def test_heap_and_list_merges_agree(reference_codec):
    ranks, library = reference_codec
    rnd = random.Random(7)
    for n in (129, 200, 1000):
        piece = "".join(rnd.choice("etaoin") for _ in range(n)).encode()
        assert bpe.merge(piece, ranks) == bpe._merge_short(piece, ranks) == library.encode_ordinary(piece.decode())


def test_scan_is_a_product_of_all_before():
    _, _, product, maps = bpe.monoid()
    elements = np.random.default_rng(0).integers(0, len(maps), 5000).astype(product.dtype)
    state, got = 0, bpe.scan(elements, product)
    for i, e in enumerate(elements):
        state = maps[e][state]
        assert maps[got[i]][0] == state


def test_encoding_of_columns_and_back(spark, reference_codec):
    import hashlib

    ranks, library = reference_codec
    texts = ["Hello, world's end", None, "", "naïve ☃"]
    docs = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    out = bpe.encode(docs, ranks).cache()
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(out.select("doc_id", "ids"), ranks).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), ranks).count() == 0


def kept_words(template, window):
    """The longest common subsequence."""
    row = [0] * (len(window) + 1)
    for a in template:
        before = 0
        for j, b in enumerate(window):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def test_jaccard_join_of_very_long_texts_and_many_near_copies(spark):
    rnd = random.Random(7)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    other = [w if i % 100 else "changed" for i, w in enumerate(long)]
    base = [f"b{i}" for i in range(120)]
    near = [[w if i not in (k, k + 40) else f"n{k}" for i, w in enumerate(base)] for k in range(80)]
    texts = [" ".join(x) for x in (long, other, long[:30_000], *near, *near[:3])]
    docs = docs_of(spark, texts)
    for block in (1024, 8):  # small blocks: hot shingles are chained in parts
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, shingle=5, threshold=80, block=block).collect()}
        wanted = similar(list(enumerate(texts)), 80, 5)
        assert got == wanted
    assert got[1][1] == 0 and got[2][1] == 2


def test_repeated_rows_are_encoded_each(spark, reference_codec):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (2, "é " * 100_000)], EMPTY).withColumn("n_tokens", F.lit("clash"))
    rows = bpe.encode(docs.drop("n_tokens"), vocabulary(), keep_ids=False).collect()
    assert len(rows) == 4 and len({r.ids_sha256 for r in rows}) == 2
    assert all(r.n_tokens == len(reference_codec[1].encode_ordinary("same text" if r.doc_id != 2 else "é " * 100_000)) for r in rows)


def test_licenses_are_found_with_their_spans(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    worn = mit.replace("free of charge, ", "").replace("without restriction", "with no restriction")
    texts = ["Intro. Released under the MIT License. End", "released UNDER the mit license", "Released by the MIT License", "nothing here", None, "", f"é {worn} tail", "Released under the MIT License.\nx\nReleased under the MIT License."]
    got = sorted((r.doc_id, r.license_id, r.words_kept, r.byte_start, r.byte_end) for r in license_scan.find_licenses(docs_of(spark, texts)).collect())
    assert got[0] == (0, "MIT", 5, 7, 37)
    assert [g[:3] for g in got if g[0] == 1] == [(1, "MIT", 5)]
    assert [(g[3], g[4]) for g in got if g[0] == 7] == [(0, 30), (34, 64)]
    (long,) = [g for g in got if g[0] == 6 and g[1] == "MIT-text"]
    words = lambda t: __import__("brute").WORD.findall(t.translate(__import__("brute").LOW))
    assert long[2] == kept_words(words(mit), words(worn))
    assert texts[6].encode()[long[3] : long[4]].decode().startswith("Permission") and texts[6].encode()[: long[4]].decode().endswith("IN THE SOFTWARE")
    assert {g[0] for g in got} == {0, 1, 2, 6, 7} and [g[2] for g in got if g[0] == 2] == [4]
    short = license_scan.find_licenses(docs_of(spark, ["say CC0 now", "CC1"]), {"tiny": "CC0", "none": "..."}).collect()
    assert [(r.doc_id, r.license_id, r.word_start, r.word_end) for r in short] == [(0, "tiny", 1, 2)]
    in_blocks = license_scan.find_licenses(docs_of(spark, texts), block_words=1)
    assert sorted((r.doc_id, r.license_id, r.words_kept, r.byte_start, r.byte_end) for r in in_blocks.collect()) == got
    twice = docs_of(spark, [texts[0], texts[0]]).withColumn("doc_id", F.lit(5)).withColumn("coverage", F.lit("clash")).withColumn("key", F.lit(1))
    assert [(r.doc_id, r.license_id) for r in license_scan.find_licenses(twice).collect()] == [(5, "MIT")] * 2
    assert license_scan.find_licenses(docs_of(spark, []), None).count() == 0


def test_edited_licenses_are_found_and_scrambled_ones_are_not(spark):
    rnd = random.Random(2)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: WORD.findall(t.translate(low))
    texts, wanted = [], []
    for name, template in sorted(license_scan.TEMPLATES.items()):
        w = words(template)
        if len(w) < 32:
            continue
        for share in (0.0, 0.1, 0.2):  # words replaced, dropped and put in, up to a fifth of them
            out = list(w)
            for at in sorted(rnd.sample(range(len(w)), int(share * len(w))), reverse=True):
                out[at : at + 1] = rnd.choice(([f"x{at}"], [], [f"x{at}", f"y{at}"], [out[at], f"z{at}"]))
            texts.append(" ".join(["intro"] * rnd.randint(0, 9) + out + ["end"] * rnd.randint(0, 9)))
            wanted.append((name, kept_words(w, out)))
    mit = words(license_scan.TEMPLATES["MIT-text"])
    for step in (5, 7, 9, 13):  # foreign words between, all of the text's own in order
        texts.append(" ".join(x for i, w in enumerate(mit) for x in ((w, f"x{i}") if i % (len(mit) // step) == 0 else (w,))))
        wanted.append(("MIT-text", len(mit)))
    scrambled = len(texts)
    texts += [" ".join(rnd.sample(w, len(w))) for w in (words(t) for t in license_scan.TEMPLATES.values())]
    texts.append((" ".join(mit) + " filler" * 40 + " ") * 50)  # a long text
    got = {}
    for r in license_scan.find_licenses(docs_of(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, r.words_kept))
    missed = [(i, w) for i, w in enumerate(wanted) if w not in got.get(i, [])]
    assert not missed
    assert not [i for i in range(scrambled, len(texts) - 1) if any(dict(license_scan.TEMPLATES)[n].count(" ") > 10 for n, _ in got.get(i, []))]
    assert got[len(texts) - 1].count(("MIT-text", len(mit))) == 50


def test_license_query_finds_all_planted_lines(spark):
    from arcavec.llm import queries

    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op2_license_scan(spark, sf).where("coverage = 1").select("doc_id", "license_id").distinct()
    wanted = docs.where(F.lower("text").contains("released under the mit license")).select("doc_id")
    assert wanted.exceptAll(found.where("license_id = 'MIT'").select("doc_id")).count() == 0
    assert found.where("license_id = 'MIT'").count() == wanted.count()
