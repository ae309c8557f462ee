import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcavec.llm import components, kernels as K
from arcavec.llm.fm_index import FMIndex
from arcavec.llm.suffix import common_prefixes, suffix_array


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.booleans())
def test_suffix_array_and_common_prefixes(seq, small):
    s = np.array(seq, np.uint8 if small else np.int64)
    order, rank = suffix_array(s)
    assert order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
    assert rank[order].tolist() == list(range(len(seq)))
    if small and seq:
        got = common_prefixes(s, order, 30)
        for k in range(1, len(seq)):
            a, b = seq[order[k] :], seq[order[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[k] == min(n, 30)


def test_common_prefixes_of_long_repeats_with_limited_depth():
    rng = np.random.default_rng(0)
    part = rng.integers(0, 200, 900).astype(np.uint8)
    s = np.concatenate([part, [7], part, [9], part[:500], np.zeros(700, np.uint8)]).astype(np.uint8)
    order, _ = suffix_array(s, 400)
    got = common_prefixes(s, order, 400)
    raw = s.tobytes()
    for k in range(1, len(s)):
        a, b = raw[order[k] : order[k] + 400], raw[order[k - 1] : order[k - 1] + 400]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(seq, patterns):
    index = FMIndex(np.array(seq), 5, sample=4)
    table = np.zeros((len(patterns), 4), np.int64)
    for i, p in enumerate(patterns):
        table[i, : len(p)] = p
    lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        got = sorted(index.locate(np.arange(a, b)).tolist())
        assert got == [i for i in range(len(seq)) if seq[i : i + len(p)] == p]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\n", max_size=12)), max_size=12))
def test_chunks_and_words(texts):
    table = np.ones(256, bool)
    table[[10, 32]] = False
    got = []
    for lo, hi, data, offsets in K.text_chunks(pa.array(texts, pa.string()), 16):
        starts, ends, rows = K.words(data, offsets, table)
        h = K.slice_hash(K.prefix_hash(data), starts, ends)
        for r in range(hi - lo):
            own = [data[a:b].tobytes() for a, b in zip(starts[rows[r] : rows[r + 1]], ends[rows[r] : rows[r + 1]])]
            got.append((own, h[rows[r] : rows[r + 1]].tolist()))
    assert [g[0] for g in got] == [[w.encode() for w in (t or "").replace("\n", " ").split(" ") if w] for t in texts]
    seen = {}
    for words, hashes in got:
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def naive(edges):
    comp = {}
    for a, b in edges:
        for x in (a, b):
            comp.setdefault(x, x)
    while True:
        before = dict(comp)
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            return comp


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(4)
    edges = {"path": [(i, i + 1) for i in rng.permutation(60).tolist()], "star": [(99, i) for i in range(40)] + [(200, 201)], "random": rng.integers(0, 80, (60, 2)).tolist(), "none": [(5, 5)]}[kind]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(None, 3)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    wanted = naive([(a, b) for a, b in edges if a != b])
    assert got == wanted
    if kind == "random":
        a, b = np.array([e for e in edges if e[0] != e[1]]).T
        assert dict(zip(*(x.tolist() for x in components.labels(a, b)))) == wanted
