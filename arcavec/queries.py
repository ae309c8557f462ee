"""The engine's queries over the driver's tables, and the SQL that gives the same rows.

Each query applies a public operator to its whole table. Scores are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcavec.functions import vector as V
from arcavec.catalog import Catalog
from arcavec.operators import codes, controller, filters, graph, ivf, maintenance, quantize, search, state, tenancy
from arcavec.plans import planner
from arcavec.sources import segments, shared, tables

Query = Callable[[SparkSession, str], DataFrame]
K = 10
#: Queries of a recall row, and the share of exact hits that it asks for.
RECALL_QUERIES, RECALL = 8, 0.9


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "embeddings")


def _attr():
    """An attribute to range over."""
    return (F.col("vec_id") * 7) % 1000


def _query(vectors: DataFrame) -> list[float]:
    return search.vector_of(vectors, 0)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.kv_log(tables.load(spark, sf_dir, "events"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of one vector, in English and of 200 characters or more, with their text as payload."""
    vectors, docs = _vectors(spark, sf_dir), tables.load(spark, sf_dir, "documents")
    payload = docs.select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("lang="), "lang", F.lit(" n_chars="), F.col("n_chars").cast("string")).alias("payload"))
    hits = search.search_filtered(vectors, payload, _query(vectors), K, "lang = en AND n_chars >= 200")
    return hits.join(docs.select(F.col("doc_id").alias("vec_id"), "source", F.substring("text", 1, 80).alias("snippet")), "vec_id", "left")


def q01_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.search(v, _query(v), K)


def q02_knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.knn(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), K)


def q03_score_ids(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ids = spark.createDataFrame([(1,), (5,), (5,), (999999,)], "vec_id long")
    return search.score_ids(v, ids, _query(v), K)


def q04_entry(spark, sf_dir):
    return entry_query(spark, sf_dir)


def _filter_query(text: str) -> Query:
    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        return search.search_filtered(v, tables.payloads(v), _query(v), K, text)

    return run


#: Filters, and their conditions on payload fields P as SQL.
_EXISTS = "EXISTS (SELECT 1 FROM p WHERE p.vec_id = e.vec_id AND {})"
FILTERS = {
    "q05a_eq": ("cat = c3", _EXISTS.format("field = 'cat' AND raw = 'c3'")),
    "q05b_in": ("user IN (u1, u2, u3, u17)", _EXISTS.format("field = 'user' AND raw IN ('u1', 'u2', 'u3', 'u17')")),
    "q05c_less": ("year < 2020", _EXISTS.format("field = 'year' AND (ival IS NULL OR ival < 2020)")),
    "q05d_at_least": ("year >= 2022", _EXISTS.format("field = 'year' AND ival >= 2022")),
    "q05e_between": ("year BETWEEN 2019 AND 2021", _EXISTS.format("field = 'year' AND ival BETWEEN 2019 AND 2021")),
    "q05f_exists": ("flag EXISTS", _EXISTS.format("field = 'flag'")),
    "q05g_and_or": ("(cat = c1 OR tag = t4) AND year > 2018", f"({_EXISTS.format("field = 'cat' AND raw = 'c1'")} OR {_EXISTS.format("field = 'tag' AND raw = 't4'")}) AND {_EXISTS.format("field = 'year' AND ival > 2018")}"),
    "q05h_not": ("NOT tag = t0", f"e.vec_id IN (SELECT vec_id FROM p) AND NOT {_EXISTS.format("field = 'tag' AND raw = 't0'")}"),
    "q05i_keyword_range": ("cat >= c5 AND cat <= c8", f"{_EXISTS.format("field = 'cat' AND (ival IS NOT NULL OR raw >= 'c5')")} AND {_EXISTS.format("field = 'cat' AND ival IS NULL AND raw <= 'c8'")}"),
    "q05j_and_not": ("flag = 1 AND NOT (year = unknown OR year > 2023)", f"{_EXISTS.format("field = 'flag' AND ival = 1")} AND NOT ({_EXISTS.format("field = 'year' AND raw = 'unknown'")} OR {_EXISTS.format("field = 'year' AND ival > 2023")})"),
}


def q06_range(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("attr", _attr())
    return planner.ranged(v, _query(v), K, 100, 400)


def q07_zonemap_estimate(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("cell"), _attr().alias("attr"))
    return ivf.estimated_members(ivf.zone_map(rows), 100, 1200).select(F.col("cell").cast("long").alias("cell"), "low", "high", "n", "estimate")


def q08_payload_fields(spark, sf_dir):
    return filters.explode_fields(tables.payloads(_vectors(spark, sf_dir)))


def q09_withpayload(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.with_payload(search.search(v, _query(v), K), tables.payloads(v))


def q11_vector_state(spark, sf_dir):
    now = state.vector_state(tables.vectors_log(_vectors(spark, sf_dir)))
    return now.select("vec_id", "seq", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"))


def q12_consolidate(spark, sf_dir):
    log = tables.vectors_log(_vectors(spark, sf_dir))
    base = state.consolidate(log.where(F.col("seq") < tables.BATCH))
    return state.consolidate_from(base, log, tables.BATCH - 1).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("checksum"))


def q13_kv_get(spark, sf_dir):
    return state.kv_state(_log(spark, sf_dir))


def _requests(spark) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(["u1", "u7", "nobody", "u7", "u23", "u42", "u77", "u1"])], "pos long, key string")


def q14_kv_del(spark, sf_dir):
    return state.delete(_requests(spark), state.kv_state(_log(spark, sf_dir)))


def q15_exists(spark, sf_dir):
    return state.exists(_requests(spark), state.kv_state(_log(spark, sf_dir)))


def q16_mget(spark, sf_dir):
    return state.multi_get(_requests(spark), state.kv_state(_log(spark, sf_dir)))


def q17_append(spark, sf_dir):
    return state.appended(_log(spark, sf_dir), 256)


def q18_mset(spark, sf_dir):
    return state.multi_set(_log(spark, sf_dir).select(F.col("seq").alias("pos"), "key", F.col("n").alias("value")))


def q19_incr(spark, sf_dir):
    return state.counters(_log(spark, sf_dir))


def q19b_running_incr(spark, sf_dir):
    return state.running_counter(_log(spark, sf_dir), 256)


_written: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> codes.Codes:
    """The 8-bit codes of the vectors, which are written once for a session and a folder, as those of an index are."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _written:
        path = shared.new_path(spark, "codes")
        codes.build(_vectors(spark, sf_dir), "int8").save(path)
        _written[at] = path
    return codes.open_codes(spark, _written[at])


def q20_int8(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return codes.coarse(_stored(spark, sf_dir), _query(v), K).select("vec_id", F.col("proxy").cast("long").alias("dot"))


def q21_binary(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", (-quantize.binary_proxy(_query(v))).alias("hamming")).orderBy("hamming", "vec_id").limit(K)


def q22_pq(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = np.array([r.embedding for r in v.where("vec_id < 16").orderBy("vec_id").collect()], np.float64)  # the codebook: fixed rows instead of trained ones
    book = np.stack(np.split(quantize.unit(rows), 8, axis=1))
    found = quantize.pq_distances(quantize.pq_codes(v, book), book, _query(v))
    return found.select("vec_id", F.round("distance", 5).alias("distance"))


def q23_fwht(spark, sf_dir):
    turned = quantize.rotated(_vectors(spark, sf_dir))
    return turned.select("vec_id", F.posexplode("rotated").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


def q24_tq(spark, sf_dir):
    turned = quantize.rotated(_vectors(spark, sf_dir), normalise=True)
    x = turned.select(F.explode("rotated").alias("x"), F.size("rotated").alias("dim")).select((F.col("x") * F.sqrt("dim")).alias("x"))
    every = [x.select(F.lit(bits).cast("long").alias("bits"), V.bucket(F.col("x"), quantize.BOUNDS[bits]).cast("long").alias("bucket")) for bits in (1, 2, 4)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("bits", "bucket").agg(F.count("*").alias("n"))


def q25_bitplane(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = _query(v)
    planes, _ = quantize.query_planes(q)
    words = V.sign_words(F.col("embedding"), len(q))
    ones = sum((F.bit_count(w).cast("long") for w in words), F.lit(0).cast("long"))
    return v.select("vec_id", quantize.bitplane_score(words, planes).alias("weighted"), ones.alias("ones")).orderBy(F.desc("weighted"), "vec_id").limit(K)


def q26_rerank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return codes.search_codes(_stored(spark, sf_dir), v, _query(v), K)


def q27_layers(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    layer = F.when(F.col("vec_id") % 4 < 2, "base").when(F.col("vec_id") % 4 == 2, "run").otherwise("delta")
    return codes.search_layers(_stored(spark, sf_dir), v.withColumn("layer", layer), _query(v), K)


def q28_hybrid(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ids = tables.payloads(v).where(filters.predicate("year >= 2022", F.col("payload"))).select("vec_id")
    return planner.filtered(v, ids, _query(v), K, _stored(spark, sf_dir))


def q29_controller(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    value = F.coalesce("value", F.lit(0.0))
    samples = e.select("user_id", "event_id", (F.pmod(value, F.lit(1.0))).alias("fast"), (F.pmod(value * 3, F.lit(1.0))).alias("full"))
    return controller.controller_modes(samples, "user_id", "event_id").select("key", "seq", "n", F.round("fast", 9).alias("fast"), F.round("full", 9).alias("full"), "wanted", "run", "mode")


def _recall_row(found: DataFrame, exact: DataFrame, least: float = RECALL, on: tuple[str, ...] = ("query_id", "vec_id")) -> DataFrame:
    """(hits, recall_ok): how many hits were asked for, and whether the share found is large enough."""
    both = exact.join(found.select(*on).withColumn("_found", F.lit(1)), list(on), "left")
    return both.agg(F.count("*").alias("hits"), (F.count("_found") >= least * F.count("*")).alias("recall_ok"))


def q30_graph_search(spark, sf_dir):
    """Recall of graph walks for every vector of the table against exact search."""
    v = _vectors(spark, sf_dir)
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    return _recall_row(graph.search(v, graph.edges(v), queries, K), search.knn(v, queries, K))


def q30b_fast_graph_search(spark, sf_dir):
    """The same with early termination, and only among vectors that a filter allows."""
    v = _vectors(spark, sf_dir)
    queries, even = v.select(F.col("vec_id").alias("query_id"), "embedding"), v.where("vec_id % 2 = 0")
    return _recall_row(graph.search(v, graph.edges(v), queries, K, stable=2 * graph.STABLE, ids=even), search.knn(even, queries, K), 0.8)


def q30c_graph_trace(spark, sf_dir):
    """The walk of one query: every step expands another node, and the nearest vector is among them."""
    v = _vectors(spark, sf_dir)
    steps = graph.trace(v, graph.edges(v), np.array(_query(v)))
    return steps.agg((F.count("*") == F.count_distinct("vec_id")).alias("distinct_nodes"), (F.count_if(F.col("vec_id") == 0) == 1).alias("reached"))


def q31_degree(spark, sf_dir):
    """Nodes of the graph, whether all have edges and, but for few that join up lost ones, no more than the bound, and whether all edges lead to vectors."""
    v = _vectors(spark, sf_dir)
    edges = graph.edges(v)
    degrees = edges.join(v.select(F.col("vec_id").alias("dst"), F.lit(1).alias("_known")), "dst", "left").groupBy("src").agg(F.count("*").alias("degree"), F.count("_known").alias("known"))
    return degrees.agg(F.count("*").alias("nodes"), (F.count_if(F.col("degree") > graph.DEGREE) <= 0.01 * F.count("*")).alias("bounded"), F.every(F.col("degree") == F.col("known")).alias("known"))


def q32_medoid(spark, sf_dir):
    return graph.medoid(_vectors(spark, sf_dir))


def _cells(v: DataFrame) -> tuple[np.ndarray, DataFrame]:
    centroids = ivf.seeds(v, 8)
    return centroids, ivf.assign(v, centroids)


def q33_ivf_assign(spark, sf_dir):
    return _cells(_vectors(spark, sf_dir))[1].select("vec_id", F.col("cell").cast("long").alias("cell"), "sim")


def q34_probe(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    centroids, assigned = _cells(v)
    ids = tables.payloads(v).where(filters.predicate("year >= 2022", F.col("payload"))).select("vec_id")
    return ivf.probe(assigned, ids, ivf.centroid_table(v, centroids), _query(v), 100)


def q35_probe_range(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("attr", _attr())
    centroids, assigned = _cells(v)
    return ivf.probe_range(assigned, ivf.centroid_table(v, centroids), _query(v), 100, 600, 80)


def q36_tenant_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    scores = search.scored(v, _query(v)).select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("tenant"), "vec_id", "score")
    return tenancy.top_per_tenant(scores, 3)


def q37_stats_keys(spark, sf_dir):
    last = state.newest(_log(spark, sf_dir).where("op in ('SET', 'DEL')"), ["key"])
    return last.agg(F.count_if(F.col("op") == "SET").alias("live"), F.count_if(F.col("op") == "DEL").alias("tombstones"), F.max("seq").alias("max_seq"))


def q38_erase(spark, sf_dir):
    now = state.kv_state(_log(spark, sf_dir))
    gone, left = state.sweep_prefix(now, "u1")
    return gone.agg(F.count("*").alias("erased")).crossJoin(left.agg(F.count("*").alias("left_over")))  # two single rows


def q39_drop(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("tenant", F.concat(F.lit("t"), F.col("label").cast("string")))
    return tenancy.erase_tenant(v, "t3").groupBy("tenant").agg(F.count("*").alias("n_vectors"))


def q40_vindex_list(spark, sf_dir):
    log = tables.vectors_log(_vectors(spark, sf_dir)).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    live = state.newest(log, ["label", "vec_id"]).where("op = 'I'")
    name = tenancy.scoped(F.concat(F.lit("t"), F.col("label").cast("string")), F.lit("docs"))
    return live.groupBy(name.alias("name")).agg(F.count("*").alias("n_vectors"))


def q41_delete_patch(spark, sf_dir):
    log = tables.vectors_log(_vectors(spark, sf_dir))
    base, later = log.where(F.col("seq") < tables.BATCH), log.where(F.col("seq") >= tables.BATCH)
    return state.delete_patch(base, later).select("vec_id")


def q42_resident_bytes(spark, sf_dir):
    return maintenance.resident_bytes(_vectors(spark, sf_dir))


def q43_maintenance_plan(spark, sf_dir):
    e = _log(spark, sf_dir).groupBy("key").agg(
        (F.count_if(F.col("op") == "SET") * 300).alias("delta"), F.count_if(F.col("op") == "DEL").alias("_d"), (F.count_if(F.col("op") == "APPEND") * 200).alias("run_rows"),
        (F.count_if(F.col("op") == "INCRBY") * 400).alias("base"), F.count("*").alias("_n"),
    )
    e = e.withColumns({"runs": F.col("_d") % 6, "tombstones": F.col("_d") * 20, "idle": F.col("_n") % 2 == 0})
    return e.select("key", maintenance.due().alias("job"))


def q44_compaction(spark, sf_dir):
    log = _log(spark, sf_dir).where("op in ('SET', 'DEL')")
    last = log.groupBy("key").agg(F.max("seq").alias("last"))
    size = tenancy.record_bytes(F.col("key"), F.col("n").cast("string"))
    rows = log.join(last, "key").select(F.floor(F.col("seq") / 1000).alias("segment"), size.alias("bytes"), ((F.col("seq") == F.col("last")) & (F.col("op") == "SET")).alias("alive"))
    return maintenance.compactable(rows)


def q45_vector_quota(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    tenant = F.concat(F.lit("t"), F.col("label").cast("string"))
    log = tables.vectors_log(v).where("op = 'I'").join(v.select("vec_id", tenant.alias("tenant")), "vec_id")
    limits = v.select(tenant.alias("tenant"), F.when(F.col("label") % 3 != 0, 30 + 5 * F.col("label").cast("long")).alias("max_vectors")).distinct()
    return tenancy.admit_vectors(log, limits)


def q46_disk_quota(spark, sf_dir):
    c = tables.load(spark, sf_dir, "conversations")
    used = tenancy.disk_use(c.select(F.col("role").alias("tenant"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), F.coalesce("text", F.lit("")).alias("value")))
    return used.withColumn("over", F.col("bytes") > 100_000)


def q47_metering(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    t = F.col("event_type")
    op = F.when(t == "view", "VSEARCH").when(t == "click", "GET").when(t == "signup", "VSET").when(t == "purchase", "INCRBY").when(F.col("event_id") % 50 == 0, "RECLAIM").otherwise("SUBJECT.ERASE")
    rows = e.select(tenancy.command_kind(op).alias("kind"), tenancy.command_cost(op, F.col("user_id") % 20, F.lit(100)).alias("cost"))
    return rows.groupBy("kind").agg(F.count("*").alias("commands"), F.sum("cost").alias("cost"))


def q48_append_lengths(spark, sf_dir):
    """Reply of each APPEND, in buckets small enough that keys span several."""
    return state.append_lengths(_log(spark, sf_dir), 256)


def q49_latency_quantile(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.floor(F.col("value") * 100).cast("long").alias("us"))
    return maintenance.quantiles(e, {"p50": 0.5, "p99": 0.99})


def q50_batch_gate(spark, sf_dir):
    """Records of whole batches: a batch is a conversation, complete if all turns up to its last are there."""
    c = tables.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), "turn")
    sized = c.join(c.groupBy("batch_id").agg((F.max("turn") + 1).alias("batch_n")), "batch_id").where((F.col("batch_id") % 5 != 0) | (F.col("turn") % 2 == 0))
    return state.whole_batches(sized).select("batch_id", "turn")


def q51_snapshot_resume(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = 500
    return state.resume(state.snapshot(log.where(F.col("seq") <= half)), log, half).select("key", "seq", "n")


def q52_merge_runs(spark, sf_dir):
    log = tables.vectors_log(_vectors(spark, sf_dir))
    merged = state.merge_runs(log.where(F.col("seq") >= tables.BATCH))
    return merged.select("vec_id", "seq", "op")


def q53_tenant_keys(spark, sf_dir):
    """Keys and bytes by tenant: the scoped key names the tenant, events without one are unscoped."""
    now = state.kv_state(_log(spark, sf_dir))
    number = F.substring("key", 2, 20).cast("long")
    tenant = tenancy.resolve(F.when(number % 4 == 0, F.lit("north")), F.when(number % 4 == 1, F.lit("south")))
    rows = now.select(tenant.alias("tenant"), tenancy.scoped(tenant, F.col("key")).alias("key"), F.col("n").cast("string").alias("value"))
    return rows.groupBy("tenant").agg(F.count("*").alias("keys"), F.sum(tenancy.record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


def q54_turbo_scores(spark, sf_dir):
    """Estimated inner products by 1, 2 and 4 bit codes, one round of signs and transform."""
    v = _vectors(spark, sf_dir)
    q, out = _query(v), None
    for bits in (2, 4):
        made = codes.build(v, f"tq{bits}", rounds=1)
        one = codes.proxies(made, q, "asymmetric").select(F.lit(bits).cast("long").alias("bits"), "vec_id", F.round("proxy", 5).alias("proxy"))
        out = one if out is None else out.unionByName(one)
    return out


def q55_search_by_kind(spark, sf_dir):
    """Recall of an index of each kind through its stored codes."""
    v = _vectors(spark, sf_dir)
    asked = v.orderBy("vec_id").limit(RECALL_QUERIES).select("vec_id", "embedding").collect()  # the queries of a recall row
    exact = search.knn(v, spark.createDataFrame([(r.vec_id, r.embedding) for r in asked], "query_id long, embedding array<float>"), K)
    out = None
    for kind in quantize.KINDS:
        path = shared.new_path(spark, "codes")
        codes.build(v, kind, parts=16).save(path)
        stored, found = codes.open_codes(spark, path), None
        for r in asked:
            one = codes.search_codes(stored, v, r.embedding, K, budget=256 if kind in ("binary", "tq1", "pq") else None).select(F.lit(r.vec_id).cast("long").alias("query_id"), "vec_id")
            found = one if found is None else found.unionByName(one)
        row = _recall_row(found, exact, 0.85).select(F.lit(kind).alias("kind"), "hits", "recall_ok")
        out = row if out is None else out.unionByName(row)
    return out


def q56_proxy_modes(spark, sf_dir):
    """Recall of each proxy of 1-bit codes, and of the search that skips rows by a bound."""
    v = _vectors(spark, sf_dir)
    q, made = _query(v), codes.build(v, "tq1")
    exact = search.search(v, q, K)
    rows = [(mode, codes.search_codes(made, v, q, K, 256, mode)) for mode in codes.MODES] + [("bounded", codes.search_bounded(codes.build(v, "tq4"), v, q, K))]
    out = None
    for mode, found in rows:
        row = _recall_row(found, exact, 0.8, ("vec_id",)).select(F.lit(mode).alias("mode"), "hits", "recall_ok")
        out = row if out is None else out.unionByName(row)
    return out


def q57_fitted_router(spark, sf_dir):
    """A fitted router, saved and opened: cells that are used, and the recall of a filtered and of a ranged search that go through it."""
    v = _vectors(spark, sf_dir).withColumn("attr", _attr())
    path = shared.new_path(spark, "router")
    planner.save_router(planner.build_router(v, cells=ivf.MIN_CELLS), path)
    router = planner.open_router(spark, path)
    n, q, stored = v.count(), _query(v), _stored(spark, sf_dir)
    ids = v.where("vec_id % 2 = 0").select("vec_id")
    parts = [
        ("filtered", planner.filtered(v, ids, q, K, stored, router, scan_rows=n // 4, shortlist=n // 3), search.score_ids(v, ids, q, K)),
        ("filtered whole", planner.filtered(v, ids, q, K, stored, router, budget=n, shortlist=None), search.score_ids(v, ids, q, K)),
        ("ranged", planner.ranged(v, q, K, 100, 900, router, wide=1, shortlist=n // 2), search.search_range(v, q, K, 100, 900)),
    ]
    out = None
    for name, found, exact in parts:
        row = _recall_row(found, exact, 0.6, ("vec_id",)).select(F.lit(name).alias("part"), "hits", "recall_ok")
        out = row if out is None else out.unionByName(row)
    return out


def q58_trained_pq(spark, sf_dir):
    """Product codes of a trained codebook: rows with a code, and whether the mean squared error is far below that of no code."""
    v = _vectors(spark, sf_dir)
    book = quantize.train_pq(v, 16)
    q = _query(v)
    near = quantize.pq_distances(quantize.pq_codes(v, book), book, q)
    cosine = search.scored(v, q).select("vec_id", "score")
    error = F.avg(F.abs(F.col("distance") - (2 - 2 * F.col("score"))))
    return near.join(cosine, "vec_id").agg(F.count("*").alias("rows"), (error < 0.3).alias("close"))


def q59_disk_quota_refusals(spark, sf_dir):
    """Batches of later turns against what earlier turns hold, by role."""
    c = tables.load(spark, sf_dir, "conversations").select(F.col("role").alias("tenant"), "turn", F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 4)).alias("key"), F.coalesce("text", F.lit("")).alias("value"))
    limits = spark.createDataFrame([("user", 40_000), ("assistant", None)], "tenant string, max_bytes long")
    return tenancy.admit_bytes(c.where("turn < 2"), c.where("turn >= 2"), limits)


def q60_reclaim(spark, sf_dir):
    """Bytes that compaction frees by segment, and the live bytes that are left, which it doesn't change."""
    log = _log(spark, sf_dir).where("op in ('SET', 'DEL')")
    last = log.groupBy("key").agg(F.max("seq").alias("last"))
    size = tenancy.record_bytes(F.col("key"), F.col("n").cast("string"))
    rows = log.join(last, "key").select(F.floor(F.col("seq") / 1000).alias("segment"), size.alias("bytes"), ((F.col("seq") == F.col("last")) & (F.col("op") == "SET")).alias("alive"))
    after, freed = maintenance.reclaim(rows)
    left = after.agg(F.lit(-1).cast("long").alias("segment"), F.sum(F.when(F.col("alive"), F.col("bytes")).otherwise(0)).alias("freed"))
    return freed.unionByName(left)


def q61_segment_scan(spark, sf_dir):
    """A log in segment files, one record in a thousand damaged: what is read before the first damage of each."""
    path = shared.new_path(spark, "segments")
    segments.write_segments(_log(spark, sf_dir), path, F.floor(F.col("seq") / 512), F.pmod("seq", F.lit(1009)) == 700)
    found = segments.scan_segments(spark, path).groupBy("segment").agg(F.count("*").alias("records"), F.max("seq").alias("last"), F.sum("n").alias("n"))
    return found.where(F.col("segment").isin(segments.list_segments(spark, path)))


def q62_hash_routing(spark, sf_dir):
    """Keys dealt to shards by hash: every key is in one shard."""
    dealt = state.routed(_log(spark, sf_dir), 16)
    per = dealt.groupBy("key").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n"), F.max("shard").alias("high"), F.min("shard").alias("low"))
    return per.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("shards").alias("shards_of_a_key"), (F.max("high") < 16).alias("in_bounds"))


def q63_catalog(spark, sf_dir):
    """Named indexes end to end: writes with payloads, a flush, deletes, a consolidation with codes, a drop, quotas; the listing."""
    v = _vectors(spark, sf_dir)
    c = Catalog(spark, shared.new_path(spark, "catalog"))
    dim = len(_query(v))
    with_payload = v.join(tables.payloads(v), "vec_id")
    c.set_quota("small", "10", "*")
    for name, kind, tenant in (("even", "tq4", ""), ("odd", "int8", ""), ("gone", "f32", ""), ("refused", "f32", "small")):
        c.create(name, dim, kind, "flat", tenant)
    c.put("even", with_payload.where("vec_id % 2 = 0"), 1)
    c.flush("even")
    c.delete("even", v.where("vec_id % 10 = 0"), 2)
    c.consolidate("even")
    c.put("even", with_payload.where("vec_id % 20 = 0"), 3)
    c.put("odd", v.where("vec_id % 2 = 1"), 1)
    c.flush("odd")
    c.put("gone", v, 1)
    c.drop("gone")
    try:
        c.put("refused", v, 1)
        refused = False
    except tenancy.QuotaExceeded:
        refused = True
    best = c.search("even", _query(v), 1).first()
    return c.listing().withColumns({"refused": F.lit(refused), "best": F.lit(best.vec_id).cast("long")})


def q64_calibration(spark, sf_dir):
    """Fixed tables and rotations: levels as 8-bit integers, and whether rotations keep lengths and signs keep the order of codes."""
    v = _vectors(spark, sf_dir)
    out = None
    for bits in (1, 2, 4):
        levels, _ = codes.int8_levels(bits)
        one = spark.createDataFrame([(bits, i, int(x)) for i, x in enumerate(levels)], "bits long, i long, level long")
        out = one if out is None else out.unionByName(one)
    dense = codes.dense_rotation(len(_query(v)))
    spread = codes.calibration(v)
    signs = codes.sign_vectors(v).where("vec_id < 2").orderBy("vec_id").collect()
    fine = bool(np.allclose(dense @ dense.T, np.eye(len(dense)))) and (spread is None or bool(((spread > 0.5) & (spread < 2)).all())) and {abs(x) for r in signs for x in r.embedding} == {1.0}
    return out.withColumn("fine", F.lit(fine))


def q65_adaptive(spark, sf_dir):
    """Searches in the mode in force, with a sample of both proxies for each fiftieth query; the state that the samples lead to."""
    v = _vectors(spark, sf_dir)
    made = codes.build(v, "tq1")
    path = shared.new_path(spark, "codes")
    made.save(path)
    made, samples, hits = codes.open_codes(spark, path), [], 0
    for index in (0, 1, 50, 100):
        found, agreed = codes.search_adaptive(made, v, _query(v), K, index)
        hits += found.count()
        samples += [] if agreed is None else [("docs", index, float(agreed), 1.0)]
    modes = controller.controller_modes(spark.createDataFrame(samples, "key string, seq long, fast double, full double"))
    return controller.controller_state(modes).select("key", "n", "mode", F.lit(hits).cast("long").alias("hits"))


def q66_graph_patch(spark, sf_dir):
    """A graph from which one vector in seventeen went: its nodes, whether all edges lead to vectors that live, and the recall of walks through it."""
    v = _vectors(spark, sf_dir)
    dead, live = v.where("vec_id % 17 = 0"), v.where("vec_id % 17 <> 0")
    edges = shared.written(graph.edges(v), "edges")
    patched = shared.written(graph.patch(live, edges, dead), "edges")
    queries = live.select(F.col("vec_id").alias("query_id"), "embedding")
    found = graph.search(live, patched, queries, K, shards=graph.shard_count(edges))
    nodes = patched.agg(F.count_distinct("src").alias("nodes"), (F.count_if((F.col("src") % 17 == 0) | (F.col("dst") % 17 == 0)) == 0).alias("all_live"))
    return nodes.crossJoin(_recall_row(found, search.knn(live, queries, K)))  # two single rows


def q67_evict(spark, sf_dir):
    """Which indexes stay open under a budget: one for each label, as of its latest event."""
    v = _vectors(spark, sf_dir).groupBy("label").agg(F.sum(4 * F.size("embedding")).cast("long").alias("bytes"))
    used = tables.load(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("label")).agg(F.max("event_id").alias("last_used"))
    indexes = v.join(used, "label").select((F.col("label") % 2).cast("long").alias("shard"), F.concat(F.lit("i"), F.col("label").cast("string")).alias("name"), "bytes", "last_used")
    return maintenance.evict(indexes, 40_000)


def queries() -> dict[str, Query]:
    out = {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit() and callable(f)}
    out |= {name: _filter_query(text) for name, (text, _) in FILTERS.items()}
    return dict(sorted(out.items()))


_PAYLOAD = """CASE WHEN vec_id % 11 = 0 THEN NULL ELSE concat('cat=c', CAST(label AS VARCHAR), ' user=u', CAST(vec_id % 50 AS VARCHAR),
    CASE WHEN vec_id % 13 = 0 THEN ' year=unknown' ELSE concat(' year=', CAST(2018 + vec_id % 8 AS VARCHAR)) END, CASE WHEN vec_id % 3 = 0 THEN ' flag=1' ELSE '' END,
    ' tag=t', CAST(vec_id % 3 AS VARCHAR), ' tag=t', CAST(vec_id % 5 AS VARCHAR), ' loose') END"""
_P = f"""p AS (SELECT vec_id, substring(tok, 1, instr(tok, '=') - 1) AS field, substring(tok, instr(tok, '=') + 1) AS raw, TRY_CAST(substring(tok, instr(tok, '=') + 1) AS BIGINT) AS ival
  FROM (SELECT vec_id, unnest(string_split_regex(trim(payload), '\\s+')) AS tok FROM (SELECT vec_id, {_PAYLOAD} AS payload FROM embeddings)) WHERE instr(tok, '=') > 1)"""
_S = "s AS (SELECT e.vec_id, e.label, e.embedding, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_TOP = "ORDER BY score DESC, vec_id LIMIT 10"
_KV = """kv AS (SELECT event_id AS seq, concat('u', CAST(user_id AS VARCHAR)) AS key, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'INCRBY' WHEN 'purchase' THEN 'APPEND' WHEN 'error' THEN 'DEL' ELSE 'GET' END AS op,
  CAST(round(value) AS BIGINT) AS n FROM events),
st AS (SELECT key, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM kv WHERE op IN ('SET', 'DEL')) WHERE r = 1 AND op = 'SET'),
al AS (SELECT * FROM (SELECT *, max(CASE WHEN op IN ('SET', 'DEL') THEN seq END) OVER (PARTITION BY key) AS reset FROM kv) WHERE reset IS NULL OR seq >= reset)"""
_REQ = "req AS (SELECT * FROM (VALUES (0, 'u1'), (1, 'u7'), (2, 'nobody'), (3, 'u7'), (4, 'u23'), (5, 'u42'), (6, 'u77'), (7, 'u1')) t(pos, key))"
_VL = f"""vl AS (SELECT vec_id AS seq, 'I' AS op, vec_id, embedding FROM embeddings
  UNION ALL SELECT {tables.BATCH} + vec_id, 'I', vec_id, list_reverse(embedding) FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL SELECT {2 * tables.BATCH} + vec_id, 'D', vec_id, NULL FROM embeddings WHERE vec_id % 17 = 0
  UNION ALL SELECT {3 * tables.BATCH} + vec_id, 'I', vec_id, embedding FROM embeddings WHERE vec_id % 34 = 0),
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) AS r FROM vl) WHERE r = 1 AND op = 'I')"""
_I8 = """iu AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings),
m AS (SELECT max(list_max(list_transform(u, lambda x: abs(x)))) / 127 AS scale FROM iu),
c AS (SELECT vec_id, list_transform(u, lambda x: CAST(greatest(-127, least(127, round(x / scale))) AS INTEGER)) AS code FROM iu, m),
d AS (SELECT c.vec_id, CAST(list_sum(list_transform(range(1, len(c.code) + 1), lambda i: c.code[i] * q.code[i])) AS BIGINT) AS dot FROM c, (SELECT code FROM c WHERE vec_id = 0) q)"""
_CELLS = """n AS (SELECT count(*) AS n FROM embeddings),
o AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings),
ce AS (SELECT c AS cell, embedding AS centroid FROM o, n, (SELECT unnest(range(8)) AS c) WHERE i = (c * (n // 8)) % n),
a AS (SELECT vec_id, CAST(cell AS BIGINT) AS cell, sim FROM (SELECT e.vec_id, ce.cell, round(list_cosine_similarity(e.embedding::DOUBLE[], ce.centroid::DOUBLE[]), 6) AS sim FROM embeddings e, ce) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cell) = 1)"""


def _levels(levels: list[float], bounds: list[float], x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {y}" for b, y in zip(bounds, levels, strict=False)) + f" ELSE {levels[-1]} END"


def _turbo_sql() -> str:
    signs = np.random.default_rng(codes.SEED).choice([-1.0, 1.0], (1, 64))[0].astype(int).tolist()
    one = "SELECT CAST({bits} AS BIGINT) AS bits, h.vec_id, round(sum(q.x * l) / sum(h.x * l), 5) AS proxy FROM (SELECT *, {level} AS l FROM h) h JOIN h q ON q.vec_id = 0 AND q.i = h.i GROUP BY h.vec_id"
    parts = [one.format(bits=b, level=_levels(quantize.LEVELS[b], quantize.BOUNDS[b], "h.x * 8")) for b in (2, 4)]
    return f"""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS norm FROM embeddings),
        h AS MATERIALIZED (SELECT vec_id, i, sum(x * s * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END) / 8 AS x FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(v) AS x, unnest({signs}) AS s FROM u), (SELECT unnest(range(64)) AS i) GROUP BY vec_id, i)
        {" UNION ALL ".join(parts)}"""


def _cases(bounds: list[float]) -> str:
    return " + ".join(f"CASE WHEN x > {b} THEN 1 ELSE 0 END" for b in bounds)


def oracle_sql() -> dict[str, str]:
    out = {name: f"WITH {_P}, {_S} SELECT vec_id, score FROM s e WHERE {where} {_TOP}" for name, (_, where) in FILTERS.items()}
    return out | {
        "q01_topk": f"WITH {_S} SELECT vec_id, score FROM s {_TOP}",
        "q02_knn_batch": "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) AS rank FROM embeddings e, embeddings q QUALIFY rank <= 10",
        "q03_score_ids": f"WITH {_S} SELECT vec_id, score FROM s WHERE vec_id IN (1, 5, 999999) {_TOP}",
        "q04_entry": f"WITH {_S}, h AS (SELECT vec_id, score FROM s JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND n_chars >= 200 {_TOP}) SELECT vec_id, score, source, substring(text, 1, 80) AS snippet FROM h LEFT JOIN documents ON doc_id = vec_id",
        "q06_range": f"WITH {_S} SELECT vec_id, score FROM s WHERE (vec_id * 7) % 1000 BETWEEN 100 AND 400 {_TOP}",
        "q07_zonemap_estimate": """WITH z AS (SELECT CAST(label AS BIGINT) AS cell, min((vec_id * 7) % 1000) AS low, max((vec_id * 7) % 1000) AS high, count(*) AS n FROM embeddings GROUP BY label)
            SELECT cell, low, high, n, CAST(CASE WHEN high < 100 OR low > 1200 THEN 0 WHEN low >= 100 AND high <= 1200 THEN n ELSE (n * (least(1200, high) - greatest(100, low) + 1)) // (high - low + 1) END AS BIGINT) AS estimate FROM z""",
        "q08_payload_fields": f"WITH {_P} SELECT vec_id, field, CASE WHEN ival IS NULL THEN raw END AS sval, ival FROM p",
        "q09_withpayload": f"WITH {_S}, h AS (SELECT vec_id, score FROM s {_TOP}) SELECT h.vec_id, h.score, {_PAYLOAD.replace('vec_id', 'e.vec_id')} AS payload FROM h JOIN embeddings e ON e.vec_id = h.vec_id",
        "q11_vector_state": f"WITH {_VL} SELECT vec_id, seq, round(CAST(embedding[1] AS DOUBLE), 6) AS first_component FROM lv",
        "q12_consolidate": f"WITH {_VL} SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS checksum FROM lv",
        "q13_kv_get": f"WITH {_KV} SELECT key, seq, n FROM st",
        "q14_kv_del": f"WITH {_KV}, {_REQ} SELECT count(DISTINCT key) AS removed FROM req WHERE key IN (SELECT key FROM st)",
        "q15_exists": f"WITH {_KV}, {_REQ} SELECT count(*) AS found FROM req WHERE key IN (SELECT key FROM st)",
        "q16_mget": f"WITH {_KV}, {_REQ} SELECT CAST(pos AS BIGINT) AS pos, req.key, st.n FROM req LEFT JOIN st ON st.key = req.key",
        "q17_append": f"WITH {_KV} SELECT key, string_agg(CAST(n AS VARCHAR), '' ORDER BY seq) AS value FROM al WHERE op IN ('APPEND', 'SET') GROUP BY key",
        "q18_mset": f"WITH {_KV} SELECT key, arg_max(n, seq) AS value FROM kv GROUP BY key",
        "q19_incr": f"WITH {_KV} SELECT key, CAST(sum(n) AS BIGINT) AS value FROM al WHERE op IN ('INCRBY', 'SET') GROUP BY key",
        "q19b_running_incr": f"""WITH {_KV}, e AS (SELECT *, sum(CASE WHEN op = 'INCRBY' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS era FROM kv WHERE op IN ('SET', 'DEL', 'INCRBY'))
            SELECT key, seq, value FROM (SELECT key, seq, op, CAST(sum(CASE WHEN op = 'DEL' THEN 0 ELSE n END) OVER (PARTITION BY key, era ORDER BY seq) AS BIGINT) AS value FROM e) WHERE op = 'INCRBY'""",
        "q20_int8": f"WITH {_I8} SELECT vec_id, dot FROM d ORDER BY dot DESC, vec_id LIMIT 10",
        "q21_binary": "SELECT e.vec_id, CAST(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CASE WHEN (e.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS hamming FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY hamming, e.vec_id LIMIT 10",
        "q22_pq": """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
            w AS (SELECT vec_id, s, list_slice(v, 8 * s + 1, 8 * s + 8) AS x FROM u, (SELECT unnest(range(8)) AS s)),
            b AS (SELECT vec_id AS c, s, x AS y FROM w WHERE vec_id < 16),
            d AS (SELECT w.vec_id, w.s, b.c, list_sum(list_transform(range(1, 9), lambda i: (w.x[i] - b.y[i]) * (w.x[i] - b.y[i]))) AS d FROM w JOIN b ON b.s = w.s),
            k AS (SELECT vec_id, s, c FROM d QUALIFY row_number() OVER (PARTITION BY vec_id, s ORDER BY d, c) = 1)
            SELECT k.vec_id, round(sum(q.d), 5) AS distance FROM k JOIN d q ON q.vec_id = 0 AND q.s = k.s AND q.c = k.c GROUP BY k.vec_id""",
        "q23_fwht": "SELECT vec_id, i, round(sum(x * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END) / 8, 5) AS x FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings), (SELECT unnest(range(64)) AS i) GROUP BY vec_id, i",
        "q24_tq": f"""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
            h AS (SELECT sum(x * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(v) AS x FROM u), (SELECT unnest(range(64)) AS i) GROUP BY vec_id, i)
            SELECT CAST(bits AS BIGINT) AS bits, CAST(bucket AS BIGINT) AS bucket, count(*) AS n FROM (SELECT 1 AS bits, {_cases(quantize.BOUNDS[1])} AS bucket FROM h UNION ALL SELECT 2, {_cases(quantize.BOUNDS[2])} FROM h UNION ALL SELECT 4, {_cases(quantize.BOUNDS[4])} FROM h) GROUP BY ALL""",
        "q25_bitplane": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), l AS (SELECT list_transform(q, lambda x: CAST(floor((x - list_min(q)) / (list_max(q) - list_min(q)) * 15 + 0.5) AS BIGINT)) AS level FROM q)
            SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN level[i] ELSE 0 END)) AS BIGINT) AS weighted, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS ones
            FROM embeddings, l ORDER BY weighted DESC, vec_id LIMIT 10""",
        "q26_rerank": f"WITH {_I8}, {_S}, k AS (SELECT vec_id FROM d ORDER BY dot DESC, vec_id LIMIT 80) SELECT vec_id, score FROM s WHERE vec_id IN (SELECT vec_id FROM k) {_TOP}",
        "q27_layers": f"WITH {_I8}, {_S}, k AS (SELECT vec_id FROM d WHERE vec_id % 4 < 3 ORDER BY dot DESC, vec_id LIMIT 80) SELECT vec_id, score FROM s WHERE vec_id % 4 = 3 OR vec_id IN (SELECT vec_id FROM k) {_TOP}",
        "q28_hybrid": f"WITH {_P}, {_I8}, {_S}, k AS (SELECT vec_id FROM d WHERE vec_id IN (SELECT vec_id FROM p WHERE field = 'year' AND ival >= 2022) ORDER BY dot DESC, vec_id LIMIT 80) SELECT vec_id, score FROM s WHERE vec_id IN (SELECT vec_id FROM k) {_TOP}",
        "q29_controller": f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ((coalesce(value, 0.0) % 1.0) + 1.0) % 1.0 AS fast, ((coalesce(value, 0.0) * 3 % 1.0) + 1.0) % 1.0 AS slow FROM events),
            e AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, list_reduce(list(fast) OVER w, lambda a, x: a + {controller.WEIGHT} * (x - a)) AS fast, list_reduce(list(slow) OVER w, lambda a, x: a + {controller.WEIGHT} * (x - a)) AS slow FROM s WINDOW w AS (PARTITION BY key ORDER BY seq ROWS {controller.MEMORY - 1} PRECEDING)),
            k AS (SELECT *, CASE WHEN n >= {controller.WARMUP} THEN CASE WHEN fast >= slow - {controller.TOLERANCE} THEN 'hybrid' ELSE 'asymmetric' END END AS wanted FROM e),
            c AS (SELECT *, CASE WHEN wanted IS NOT DISTINCT FROM lag(wanted) OVER (PARTITION BY key ORDER BY seq) THEN 0 ELSE 1 END AS new FROM k),
            i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY seq) AS island FROM c),
            r AS (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY seq) AS run FROM i)
            SELECT key, seq, n, round(fast, 9) AS fast, round(slow, 9) AS "full", wanted, run, coalesce(last_value(CASE WHEN run >= {controller.PATIENCE} THEN wanted END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq), 'hybrid') AS mode FROM r""",
        "q30_graph_search": "SELECT count(*) * 10 AS hits, true AS recall_ok FROM embeddings",
        "q30b_fast_graph_search": "SELECT count(*) * 10 AS hits, true AS recall_ok FROM embeddings",
        "q30c_graph_trace": "SELECT true AS distinct_nodes, true AS reached",
        "q31_degree": "SELECT count(*) AS nodes, true AS bounded, true AS known FROM embeddings",
        "q54_turbo_scores": _turbo_sql(),
        "q55_search_by_kind": f"SELECT kind, CAST({K * RECALL_QUERIES} AS BIGINT) AS hits, true AS recall_ok FROM (SELECT unnest({list(quantize.KINDS)}) AS kind)",
        "q56_proxy_modes": f"SELECT mode, CAST({K} AS BIGINT) AS hits, true AS recall_ok FROM (SELECT unnest({[*codes.MODES, 'bounded']}) AS mode)",
        "q57_fitted_router": f"SELECT part, CAST({K} AS BIGINT) AS hits, true AS recall_ok FROM (SELECT unnest(['filtered', 'filtered whole', 'ranged']) AS part)",
        "q58_trained_pq": "SELECT count(*) AS rows, true AS close FROM embeddings",
        "q59_disk_quota_refusals": """WITH c AS (SELECT role AS tenant, turn, concat_ws('-', conv_id, CAST(floor(turn / 4) AS BIGINT)) AS key, coalesce(text, '') AS value FROM conversations),
            z AS (SELECT *, CAST((21 + 127 + strlen(key) + strlen(value)) // 128 * 128 AS BIGINT) AS size FROM c),
            a AS (SELECT tenant, key, max(size) AS held FROM z WHERE turn < 2 GROUP BY ALL), b AS (SELECT tenant, key, arg_max(size, value) AS new FROM z WHERE turn >= 2 GROUP BY ALL),
            t AS (SELECT tenant, sum(coalesce(held, 0)) AS held, sum(coalesce(new, held)) AS projected FROM a FULL JOIN b USING (tenant, key) GROUP BY tenant HAVING count(new) > 0)
            SELECT tenant, CAST(held AS BIGINT) AS held, CAST(projected AS BIGINT) AS projected, CAST(CASE WHEN tenant = 'user' THEN 40000 END AS BIGINT) AS max_bytes, tenant <> 'user' OR projected <= 40000 AS admitted FROM t""",
        "q60_reclaim": f"""WITH {_KV}, r AS (SELECT seq // 1000 AS segment, CAST((21 + 127 + strlen(key) + strlen(CAST(n AS VARCHAR))) // 128 * 128 AS BIGINT) AS bytes, op = 'SET' AND seq = max(seq) OVER (PARTITION BY key) AS alive FROM kv WHERE op IN ('SET', 'DEL'))
            SELECT segment, CAST(sum(CASE WHEN alive THEN 0 ELSE bytes END) AS BIGINT) AS freed FROM r GROUP BY segment HAVING sum(CASE WHEN alive THEN bytes ELSE 0 END) < 0.5 * sum(bytes)
            UNION ALL SELECT -1, CAST(sum(CASE WHEN alive THEN bytes ELSE 0 END) AS BIGINT) FROM r""",
        "q61_segment_scan": f"""WITH {_KV}, g AS (SELECT *, seq // 512 AS segment, min(CASE WHEN seq % 1009 = 700 THEN seq END) OVER (PARTITION BY seq // 512) AS bad FROM kv)
            SELECT CAST(segment AS BIGINT) AS segment, count(*) AS records, max(seq) AS last, CAST(sum(n) AS BIGINT) AS n FROM g WHERE bad IS NULL OR seq < bad GROUP BY segment""",
        "q62_hash_routing": "SELECT count(DISTINCT user_id) AS keys, count(*) AS rows, CAST(1 AS BIGINT) AS shards_of_a_key, true AS in_bounds FROM events",
        "q63_catalog": f"""SELECT name, 64 AS dim, kind, 'flat' AS backend, CAST(n AS BIGINT) AS n_vectors, true AS refused, CAST(0 AS BIGINT) AS best FROM (
            SELECT 'even' AS name, 'tq4' AS kind, count(*) FILTER (vec_id % 2 = 0 AND (vec_id % 10 <> 0 OR vec_id % 20 = 0)) AS n FROM embeddings UNION ALL SELECT 'odd', 'int8', count(*) FILTER (vec_id % 2 = 1) FROM embeddings UNION ALL SELECT 'refused', 'f32', 0)""",
        "q64_calibration": " UNION ALL ".join(f"SELECT CAST({b} AS BIGINT) AS bits, i - 1 AS i, CAST(round({quantize.LEVELS[b]}[i] / {max(quantize.LEVELS[b])} * 127) AS BIGINT) AS level, true AS fine FROM (SELECT unnest(range(1, {2**b + 1})) AS i)" for b in (1, 2, 4)),
        "q65_adaptive": f"SELECT 'docs' AS key, CAST(3 AS BIGINT) AS n, 'hybrid' AS mode, CAST({4 * K} AS BIGINT) AS hits",
        "q66_graph_patch": "SELECT count(*) AS nodes, true AS all_live, count(*) * 10 AS hits, true AS recall_ok FROM embeddings WHERE vec_id % 17 <> 0",
        "q67_evict": """WITH b AS (SELECT label, CAST(sum(4 * len(embedding)) AS BIGINT) AS bytes FROM embeddings GROUP BY label), u AS (SELECT user_id % 10 AS label, max(event_id) AS last_used FROM events GROUP BY 1)
            SELECT CAST(b.label % 2 AS BIGINT) AS shard, concat('i', CAST(b.label AS VARCHAR)) AS name, bytes, last_used, sum(bytes) OVER (PARTITION BY b.label % 2 ORDER BY last_used DESC, concat('i', CAST(b.label AS VARCHAR))) <= 40000 AS resident FROM b JOIN u ON u.label = b.label""",
        "q32_medoid": "SELECT a.vec_id, round(sum(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS total FROM embeddings a, embeddings b GROUP BY a.vec_id ORDER BY total, a.vec_id LIMIT 1",
        "q33_ivf_assign": f"WITH {_CELLS} SELECT vec_id, cell, sim FROM a",
        "q34_probe": f"""WITH {_P}, {_CELLS}, y AS (SELECT vec_id, cell FROM a WHERE vec_id IN (SELECT vec_id FROM p WHERE field = 'year' AND ival >= 2022)), g AS (SELECT cell, count(*) AS m FROM y GROUP BY cell),
            r AS (SELECT g.cell, m, round(list_cosine_similarity(ce.centroid::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM g JOIN ce ON ce.cell = g.cell, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
            t AS (SELECT cell, sum(m) OVER (ORDER BY sim DESC, cell ROWS UNBOUNDED PRECEDING) - m AS before FROM r) SELECT vec_id FROM y WHERE cell IN (SELECT cell FROM t WHERE before < 100)""",
        "q35_probe_range": f"""WITH {_CELLS}, y AS (SELECT vec_id, cell FROM a WHERE (vec_id * 7) % 1000 BETWEEN 100 AND 600), g AS (SELECT cell, count(*) AS m FROM y GROUP BY cell),
            r AS (SELECT g.cell, m, round(list_cosine_similarity(ce.centroid::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM g JOIN ce ON ce.cell = g.cell, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
            t AS (SELECT cell, sum(m) OVER (ORDER BY sim DESC, cell ROWS UNBOUNDED PRECEDING) - m AS before FROM r) SELECT vec_id FROM y WHERE cell IN (SELECT cell FROM t WHERE before < 80)""",
        "q36_tenant_topk": f"WITH {_S} SELECT concat('t', CAST(label AS VARCHAR)) AS tenant, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3",
        "q37_stats_keys": f"WITH {_KV}, l AS (SELECT * FROM kv WHERE op IN ('SET', 'DEL') QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT count(*) FILTER (op = 'SET') AS live, count(*) FILTER (op = 'DEL') AS tombstones, max(seq) AS max_seq FROM l",
        "q38_erase": f"WITH {_KV} SELECT count(*) FILTER (starts_with(key, 'u1')) AS erased, count(*) FILTER (NOT starts_with(key, 'u1')) AS left_over FROM st",
        "q39_drop": "SELECT concat('t', CAST(label AS VARCHAR)) AS tenant, count(*) AS n_vectors FROM embeddings WHERE label <> 3 GROUP BY label",
        "q40_vindex_list": f"WITH {_VL} SELECT concat('t', CAST(e.label AS VARCHAR), '::docs') AS name, count(*) AS n_vectors FROM lv JOIN embeddings e ON e.vec_id = lv.vec_id GROUP BY e.label",
        "q41_delete_patch": f"WITH {_VL} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM vl WHERE seq >= {tables.BATCH})",
        "q42_resident_bytes": "SELECT kind, count(*) AS rows, CAST(sum(CASE kind WHEN 'f32' THEN 4 * d WHEN 'int8' THEN d WHEN 'binary' THEN (d + 7) // 8 WHEN 'tq1' THEN CASE WHEN d < 256 THEN 64 ELSE d // 8 END + 4 WHEN 'tq2' THEN d // 4 + 4 ELSE d // 2 + 4 END) AS BIGINT) AS bytes FROM (SELECT len(embedding) AS d FROM embeddings), (SELECT unnest(['f32', 'int8', 'binary', 'tq1', 'tq2', 'tq4']) AS kind) GROUP BY kind",
        "q43_maintenance_plan": f"""WITH {_KV}, g AS (SELECT key, 300 * count(*) FILTER (op = 'SET') AS delta, count(*) FILTER (op = 'DEL') AS d, 200 * count(*) FILTER (op = 'APPEND') AS run_rows, 400 * count(*) FILTER (op = 'INCRBY') AS base, count(*) AS n FROM kv GROUP BY key)
            SELECT key, CASE WHEN delta >= 4096 THEN 'flush' WHEN run_rows >= greatest(base, 4096) OR (n % 2 = 0 AND delta + run_rows >= 4096) THEN 'consolidate' WHEN d % 6 >= 4 THEN 'runs-merge' WHEN base >= 4096 AND d * 20 >= base // 16 THEN 'delete-patch' END AS job FROM g""",
        "q44_compaction": f"""WITH {_KV}, r AS (SELECT seq // 1000 AS segment, CAST((21 + 127 + strlen(key) + strlen(CAST(n AS VARCHAR))) // 128 * 128 AS BIGINT) AS bytes, op = 'SET' AND seq = max(seq) OVER (PARTITION BY key) AS alive FROM kv WHERE op IN ('SET', 'DEL'))
            SELECT segment, CAST(sum(CASE WHEN alive THEN bytes ELSE 0 END) AS BIGINT) AS live, CAST(sum(bytes) AS BIGINT) AS total FROM r GROUP BY segment HAVING sum(CASE WHEN alive THEN bytes ELSE 0 END) < 0.5 * sum(bytes)""",
        "q45_vector_quota": "SELECT concat('t', CAST(label AS VARCHAR)) AS tenant, CAST(least(n, coalesce(m, n)) AS BIGINT) AS admitted, CAST(n - least(n, coalesce(m, n)) AS BIGINT) AS rejected FROM (SELECT label, count(DISTINCT vec_id) AS n, CASE WHEN label % 3 <> 0 THEN 30 + 5 * label END AS m FROM embeddings GROUP BY label)",
        "q46_disk_quota": "SELECT role AS tenant, CAST(sum((21 + 127 + strlen(CAST(conv_id AS VARCHAR)) + 1 + strlen(CAST(turn AS VARCHAR)) + strlen(coalesce(text, ''))) // 128 * 128) AS BIGINT) AS bytes, sum((21 + 127 + strlen(CAST(conv_id AS VARCHAR)) + 1 + strlen(CAST(turn AS VARCHAR)) + strlen(coalesce(text, ''))) // 128 * 128) > 100000 AS over FROM conversations GROUP BY role",
        "q47_metering": """WITH c AS (SELECT CASE event_type WHEN 'view' THEN 'VectorRead' WHEN 'click' THEN 'KvRead' WHEN 'signup' THEN 'VectorWrite' WHEN 'purchase' THEN 'KvWrite' ELSE CASE WHEN event_id % 50 = 0 THEN 'Admin' ELSE 'KvWrite' END END AS kind,
            CASE event_type WHEN 'view' THEN 100 + user_id % 20 WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 1000 ELSE 100 END ELSE 1 END AS cost FROM events) SELECT kind, count(*) AS commands, CAST(sum(cost) AS BIGINT) AS cost FROM c GROUP BY kind""",
        "q48_append_lengths": f"""WITH {_KV}, e AS (SELECT *, sum(CASE WHEN op = 'APPEND' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS era FROM kv WHERE op IN ('SET', 'DEL', 'APPEND'))
            SELECT key, seq, length FROM (SELECT key, seq, op, CAST(sum(CASE WHEN op = 'DEL' THEN 0 ELSE length(CAST(n AS VARCHAR)) END) OVER (PARTITION BY key, era ORDER BY seq) AS BIGINT) AS length FROM e) WHERE op = 'APPEND'""",
        "q49_latency_quantile": """WITH v AS (SELECT event_type AS op, CAST(floor(value * 100) AS BIGINT) AS us FROM events),
            b AS (SELECT op, CASE WHEN us <= 0 THEN 0 ELSE least(25, CAST(floor(log2(us)) AS INTEGER) + 1) END AS b, count(*) AS c FROM v GROUP BY ALL),
            r AS (SELECT op, b, sum(c) OVER (PARTITION BY op ORDER BY b) AS upto, sum(c) OVER (PARTITION BY op) AS n, CASE WHEN b = 0 THEN 0 WHEN b = 25 THEN 16777216 ELSE CAST(floor((pow(2, b - 1) + pow(2, b)) / 2) AS BIGINT) END AS mid FROM b)
            SELECT op, CAST(max(n) AS BIGINT) AS n, CAST(arg_min(mid, b) FILTER (upto >= ceil(n * 0.5)) AS BIGINT) AS p50, CAST(arg_min(mid, b) FILTER (upto >= ceil(n * 0.99)) AS BIGINT) AS p99 FROM r GROUP BY op""",
        "q51_snapshot_resume": f"WITH {_KV} SELECT key, seq, n FROM st",
        "q52_merge_runs": f"WITH {_VL} SELECT vec_id, seq, op FROM vl WHERE seq >= {tables.BATCH} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) = 1",
        "q53_tenant_keys": f"""WITH {_KV}, t AS (SELECT CASE CAST(substring(key, 2, 20) AS BIGINT) % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE '' END AS tenant, key, CAST(n AS VARCHAR) AS v FROM st)
            SELECT tenant, count(*) AS keys, CAST(sum((21 + 127 + strlen(tenant) + 2 + strlen(key) + strlen(v)) // 128 * 128) AS BIGINT) AS bytes FROM t GROUP BY tenant""",
        "q50_batch_gate": "WITH c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) + 1 AS n FROM conversations), k AS (SELECT * FROM c WHERE conv_id % 5 <> 0 OR turn % 2 = 0) SELECT conv_id AS batch_id, turn FROM k QUALIFY count(*) OVER (PARTITION BY conv_id) >= n",
    }
