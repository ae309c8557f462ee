import numpy as np
import pytest
from pyspark.sql import functions as F

from arcavec.operators import codes, controller, graph, ivf, quantize, search
from arcavec.plans import planner

DIM = 64


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, DIM))
    rows = centers[rng.integers(20, size=1500)] + rng.normal(size=(1500, DIM)) * 0.7
    df = spark.createDataFrame([(i, [float(x) for x in r], i) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, attr long").cache()
    queries = np.concatenate([rows[:10], centers[:10] + 0.1])
    return df, rows.astype(np.float32).astype(np.float64), queries


def exact(rows, q, k, ids=None):
    ids = np.arange(len(rows)) if ids is None else np.asarray(ids)
    s = np.round(quantize.unit(rows[ids]) @ quantize.unit(q[None])[0], 6)
    return ids[np.lexsort((ids, -s))][:k].tolist()


def hits(df):
    return [r.vec_id for r in df.collect()]


def recall(found, wanted):
    return np.mean([len(set(f) & set(w)) / max(1, len(w)) for f, w in zip(found, wanted, strict=True)])


def test_exact_search_and_limits(spark, corpus):
    df, rows, queries = corpus
    for q in queries[:3]:
        assert hits(search.search(df, q.tolist(), 10)) == exact(rows, q, 10)
    assert hits(search.search(df, queries[0].tolist(), 0)) == []
    assert len(hits(search.search(df.limit(3), queries[0].tolist(), 10))) == 3
    with pytest.raises(Exception, match="components"):
        search.search(df, [1.0], 3).collect()


def test_zero_vectors_score_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in search.search(df, [1.0, 0.0], 3).collect()] == [(2, 1.0), (1, 0.0), (3, -1.0)]


def test_knn_in_blocks_equals_brute_force(spark, corpus):
    df, rows, queries = corpus
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    for block in (7, 2048):
        got = {}
        for r in search.knn(df, q, 10, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert [got[i] for i in range(len(queries))] == [exact(rows, v, 10) for v in queries]


def test_score_ids_skips_unknown_and_repeats(spark, corpus):
    df, rows, queries = corpus
    ids = spark.createDataFrame([(5,), (5,), (9,), (10**9,)], "vec_id long")
    assert hits(search.score_ids(df, ids, queries[0].tolist(), 10)) == exact(rows, queries[0], 10, [5, 9])


def test_recall_of_quantised_searches(spark, corpus):
    df, rows, queries = corpus
    wanted = [exact(rows, q, 10) for q in queries[:6]]
    scale = quantize.int8_scale(df)
    assert recall([hits(search.two_stage(df, quantize.int8_proxy(q.tolist(), scale), q.tolist(), 10)) for q in queries[:6]], wanted) >= 0.95
    for bits, least in ((4, 0.95), (2, 0.9), (1, 0.85)):
        codes = quantize.turbo_codes(df, bits).cache()
        assert recall([hits(quantize.turbo_search(codes, df, q.tolist(), 10, bits)) for q in queries[:6]], wanted) >= least
    book = quantize.train_pq(df, 16, 64, rounds=6)
    codes = quantize.pq_codes(df, book).cache()
    found = []
    for q in queries[:6]:
        near = quantize.pq_distances(codes, book, q.tolist()).orderBy("distance", "vec_id").limit(80)
        found.append(hits(search.score_ids(df, near, q.tolist(), 10)))
    assert recall(found, wanted) >= 0.9


def test_rotations_keep_lengths():
    rows = np.random.default_rng(0).normal(size=(5, 96))
    turned = quantize.rotate(rows, 3, 7)
    assert np.allclose(turned @ turned.T, rows @ rows.T)


def test_router_recall_and_range_plans(spark, corpus):
    df, rows, queries = corpus
    router = planner.build_router(df, cells=32)
    even = df.where("vec_id % 2 = 0").select("vec_id")
    wanted = [exact(rows, q, 10, np.arange(0, 1500, 2)) for q in queries[:5]]
    found = [hits(search.score_ids(df, ivf.probe(router.assigned, even, router.centroids, q.tolist(), 250), q.tolist(), 10)) for q in queries[:5]]
    assert recall(found, wanted) >= 0.9
    assert all(v % 2 == 0 for f in found for v in f)
    for low, high in ((100, 260), (200, 1400)):
        wanted = [exact(rows, q, 10, np.arange(low, high + 1)) for q in queries[:3]]
        assert [hits(planner.ranged(df, q.tolist(), 10, low, high, router)) for q in queries[:3]] == wanted
    assert ivf.probe(router.assigned, even.limit(0), router.centroids, queries[0].tolist(), 10).count() == 0


def test_estimate_is_exact_inside_and_proportional_across(spark):
    zones = spark.createDataFrame([(0, 0, 9, 10), (1, 10, 19, 4), (2, 30, 39, 7)], "cell int, low long, high long, n long")
    assert [r.estimate for r in ivf.estimated_members(zones, 5, 25).orderBy("cell").collect()] == [5, 4, 0]


def test_graph_recall(spark, corpus):
    df, rows, queries = corpus
    found = {}
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    edges = graph.edges(df, 800)
    for r in graph.search(df, edges, q, 10, shard_rows=800, block=15).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert recall([found[i] for i in range(len(queries))], [exact(rows, q, 10) for q in queries]) >= 0.95


def test_a_patched_graph_finds_what_lives(spark, corpus):
    df, rows, queries = corpus
    edges = graph.edges(df, 800)
    live, dead = df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0")
    patched = graph.patch(live, edges, dead)
    assert not {v for r in patched.collect() for v in (r.src, r.dst) if v % 5 == 0}
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    found = {}
    for r in graph.search(live, patched, q, 10, shards=graph.shard_count(edges)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    ids = [i for i in range(1500) if i % 5]
    assert recall([found[i] for i in range(len(queries))], [exact(rows, v, 10, ids) for v in queries]) >= 0.9
    assert graph.patch(df, edges, dead.limit(0)).count() == edges.count()


def test_levels_of_a_graph(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (3, 4), (9, 0)], "src long, dst long")
    assert {(r.node, r.level) for r in graph.levels(edges, 0).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}


def test_every_node_of_a_graph_is_reached():
    rows = quantize.unit(np.random.default_rng(2).normal(size=(300, 16)))
    edges, start = graph.build(rows, degree=8, size=24)
    seen, front = {start}, [start]
    while front:
        front = [j for i in front for j in edges[i].tolist() if j not in seen and not seen.add(j)]
    assert len(seen) == 300


def plain_modes(samples, patience=3, warmup=20):
    mode, fast, full, waiting, out = "hybrid", None, None, 0, []
    for n, (x, y) in enumerate(samples, 1):
        fast, full = (x, y) if fast is None else (fast + 0.2 * (x - fast), full + 0.2 * (y - full))
        if n >= warmup:
            wanted = "hybrid" if fast >= full - 0.01 else "asymmetric"
            waiting = 0 if wanted == mode else waiting + 1
            if waiting >= patience:
                mode, waiting = wanted, 0
        out.append(mode)
    return out


def test_controller_waits_changes_and_resumes(spark):
    rng = np.random.default_rng(3)
    own = {}
    for k in range(6):
        level = np.repeat(rng.random(12), 60)[:600]
        own[f"k{k}"] = [(float(x), float(y)) for x, y in zip(level + rng.normal(size=600) * 0.05, 0.5 + rng.normal(size=600) * 0.02, strict=True)]
    rows = [(k, i, x, y) for k, s in own.items() for i, (x, y) in enumerate(s)]
    schema = "key string, seq long, fast double, full double"
    whole = controller.controller_modes(spark.createDataFrame(rows, schema))
    got = {}
    for r in whole.orderBy("key", "seq").collect():
        got.setdefault(r.key, []).append(r.mode)
    assert got == {k: plain_modes(s) for k, s in own.items()} and any(len(set(m)) == 2 for m in got.values())
    for cut in (5, 30, 317):
        first = controller.controller_modes(spark.createDataFrame([r for r in rows if r[1] < cut], schema))
        later = controller.controller_modes(spark.createDataFrame([r for r in rows if r[1] >= cut], schema), state=controller.controller_state(first))
        again = {}
        for r in later.orderBy("key", "seq").collect():
            again.setdefault(r.key, []).append(r.mode)
        assert again == {k: m[cut:] for k, m in got.items()}
    assert controller.controller_modes(spark.createDataFrame([], schema)).count() == 0


def test_seeds_of_a_large_table_are_evenly_spaced_and_the_same(spark):
    n = 400_000
    ids = spark.range(n).select((F.col("id") * 3 + F.when(F.col("id") > 300_000, 10**9).otherwise(0)).alias("vec_id"))
    df = ids.select("vec_id", F.array(F.col("vec_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).repartition(7, F.xxhash64("vec_id"))
    value = lambda i: float(np.float32(3 * i + (10**9 if i > 300_000 else 0)))
    wanted = [value(i) for i in range(0, n, n // 8)]
    for _ in range(2):
        assert ivf.seeds(df, 8)[:, 0].tolist() == wanted
    assert ivf.seeds(df.limit(0), 8).size == 0
    assert len(ivf.seeds(df.limit(3), 8)) == 3


def test_null_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert hits(search.search(df, [1.0, 0.0], 5)) == [1, 3]
    assert graph.medoid(df).count() == 1
    assert ivf.assign(df, np.eye(2)).count() == 2
    assert {r.src for r in graph.edges(df).collect()} <= {1, 3}
    for kind in ("f32", "int8", "binary"):
        assert codes.build(df, kind).table.count() == 2


def test_stored_codes_by_kind(spark, corpus, tmp_path):
    df, rows, queries = corpus
    wanted = [exact(rows, q, 10) for q in queries[:3]]
    for kind, least in (("f32", 1.0), ("int8", 0.95), ("tq4", 0.95), ("tq2", 0.9), ("tq1", 0.8), ("binary", 0.7), ("pq", 0.8)):
        codes.build(df, kind, parts=16).save(f"{tmp_path}/{kind}")
        stored = codes.open_codes(spark, f"{tmp_path}/{kind}")
        assert codes.memory_bytes(stored).first().bytes == quantize.code_bytes(kind, DIM, 16) * 1500
        assert recall([hits(codes.search_codes(stored, df, q.tolist(), 10, 200)) for q in queries[:3]], wanted) >= least, kind
    one = codes.open_codes(spark, f"{tmp_path}/tq1")
    for mode in codes.MODES:
        assert recall([hits(codes.search_codes(one, df, q.tolist(), 10, 200, mode)) for q in queries[:2]], wanted[:2]) >= 0.8, mode
    with pytest.raises(ValueError):
        codes.proxies(one, queries[0].tolist(), "none")
    bounded = codes.search_bounded(codes.open_codes(spark, f"{tmp_path}/tq4"), df, queries[0].tolist(), 10)
    assert recall([hits(bounded)], wanted[:1]) >= 0.9
    turn = codes.dense_rotation(9)
    assert np.allclose(turn @ turn.T, np.eye(9))


def test_bitplanes_estimate_the_inner_product(spark, corpus):
    df, rows, queries = corpus
    made = codes.build(df, "tq1")
    q = queries[0].tolist()
    both = codes.proxies(made, q, "bitplane").withColumnRenamed("proxy", "b").join(codes.proxies(made, q, "asymmetric"), "vec_id").select(F.corr("b", "proxy").alias("c"), (F.max(F.abs(F.col("b") - F.col("proxy"))) / F.max(F.abs("proxy"))).alias("m")).first()
    assert both.c > 0.98 and both.m < 0.1


def test_walks_stop_early_and_keep_to_a_filter():
    rng = np.random.default_rng(2)
    rows = quantize.unit(rng.normal(size=(10, 16))[rng.integers(10, size=600)] + 0.4 * rng.normal(size=(600, 16)))
    edges, start = graph.build(rows, degree=12, size=32)
    allowed = np.arange(600) % 3 == 0
    whole, fast, found = [], [], []
    for q in rows[:20]:
        for out, kw in ((whole, {}), (fast, {"k": 5, "stable": 8})):
            trace = []
            graph.walk(rows, edges, start, q, 48, trace=trace, **kw)
            assert len(set(trace)) == len(trace)
            out.append(len(trace))
        nodes, _ = graph.walk(rows, edges, start, q, 48, allowed=allowed)
        assert allowed[nodes].all()
        best = np.flatnonzero(allowed)[np.argsort(-(rows[allowed] @ q), kind="stable")[:5]]
        found.append(len(set(nodes.tolist()) & set(best.tolist())) / 5)
    assert sum(fast) < 0.8 * sum(whole) and np.mean(found) >= 0.9


def test_names_of_kinds():
    quantize.check_kind("tq2", 64)
    for kind, dim in (("tq2", 6), ("pq", 65), ("none", 8), ("int8", 0)):
        with pytest.raises(ValueError):
            quantize.check_kind(kind, dim, 4)


def test_hamming_beyond_one_word(spark):
    from arcavec.functions import vector as V

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=100), rng.normal(size=100)
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    got = df.select(V.hamming(V.sign_words(F.col("a"), 100), V.sign_words(F.col("b"), 100)).alias("h")).first().h
    assert got == int(((a > 0) != (b > 0)).sum())
