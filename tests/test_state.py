import random

import pytest
from pyspark.sql import functions as F

from arcavec.catalog import Catalog
from arcavec.operators import maintenance, state, tenancy


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_of_a_log(spark, seed):
    rnd = random.Random(seed)
    log = [(i, f"k{rnd.randrange(6)}", rnd.choice(["SET", "DEL", "INCRBY", "APPEND", "GET"]), rnd.randrange(-20, 20)) for i in range(300)]
    counter, text, value, replies = {}, {}, {}, []
    for seq, key, op, n in log:
        if op == "SET":
            counter[key], text[key], value[key] = n, str(n), n
        elif op == "DEL":
            for d in (counter, text, value):
                d.pop(key, None)
        elif op == "INCRBY":
            counter[key] = counter.get(key, 0) + n
            replies.append((key, seq, counter[key]))
        elif op == "APPEND":
            text[key] = text.get(key, "") + str(n)
    df = spark.createDataFrame(rnd.sample(log, len(log)), "seq long, key string, op string, n long")
    assert {r.key: r.n for r in state.kv_state(df).collect()} == value
    assert {r.key: r.value for r in state.counters(df).collect()} == counter
    assert {r.key: r.value for r in state.appended(df).collect()} == text
    assert sorted((r.key, r.seq, r.value) for r in state.running_counter(df).collect()) == sorted(replies)


def test_requests(spark):
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "key string, seq long, n long")
    asked = spark.createDataFrame([(0, "a"), (1, "x"), (2, "a")], "pos long, key string")
    assert state.exists(asked, now).first().found == 2
    assert state.delete(asked, now).first().removed == 1
    assert [(r.pos, r.key, r.n) for r in state.multi_get(asked, now).orderBy("pos").collect()] == [(0, "a", 5), (1, "x", None), (2, "a", 5)]
    assert state.get(now, "b").first().n == 6


def test_counter_overflow_is_an_error(spark):
    df = spark.createDataFrame([(1, "k", "INCRBY", 2**62), (2, "k", "INCRBY", 2**62)], "seq long, key string, op string, n long")
    with pytest.raises(Exception, match="OVERFLOW"):
        state.counters(df).collect()


def test_vectors_are_overwritten_deleted_and_come_back(spark):
    log = spark.createDataFrame([(1, "I", 1, [1.0]), (2, "I", 1, [2.0]), (3, "I", 2, [3.0]), (4, "D", 2, None), (5, "I", 3, [4.0]), (6, "D", 3, None), (7, "I", 3, [5.0])], "seq long, op string, vec_id long, embedding array<float>")
    now = {r.vec_id: r.embedding for r in state.vector_state(log).collect()}
    assert now == {1: [2.0], 3: [5.0]}
    base = state.consolidate(log.where("seq <= 4"))
    assert {r.vec_id: r.embedding for r in state.consolidate_from(base, log, 4).collect()} == now
    assert [r.vec_id for r in state.delete_patch(base, log.where("seq > 4")).collect()] == [1]
    payloads = spark.createDataFrame([(1, "P", 1, "a=1"), (2, "D", 1, None), (3, "P", 2, "b=1"), (4, "P", 2, "b=2")], "seq long, op string, vec_id long, payload string")
    assert [(r.vec_id, r.payload) for r in state.payload_state(payloads).collect()] == [(2, "b=2")]


def test_torn_batches_are_dropped(spark):
    log = spark.createDataFrame([(1, None, None), (2, "x", 2), (3, "x", 2), (4, "y", 2)], "seq long, batch_id string, batch_n long")
    assert sorted(r.seq for r in state.whole_batches(log).collect()) == [1, 2, 3]


def test_catalog_round_trip(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create("docs", 2, "f32")
    with pytest.raises(ValueError):
        c.create("docs", 2, "f32")
    for bad in ("", "a/b", "a..b", "x" * 256):
        with pytest.raises(ValueError):
            c.create(bad, 2)
    with pytest.raises(ValueError):
        c.create("odd", 4, "tq1")
    c.create("other", 4, "int8", "disk")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    c.put("docs", rows, 1)
    c.delete("docs", rows.where("vec_id = 2"), 2)
    with pytest.raises(Exception, match="components"):
        c.put("docs", spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>"), 3)
    assert [(r.name, r.dim, r.kind, r.backend, r.n_vectors) for r in c.listing().collect()] == [("docs", 2, "f32", "flat", 1), ("other", 4, "int8", "disk", 0)]
    c.drop("docs")
    assert [r.name for r in c.listing().collect()] == ["other"]
    with pytest.raises(KeyError):
        c.log("docs")


def test_catalog_payloads_layers_codes_and_quotas(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create("docs", 8, "int8", tenant="t")
    rows = [(i, [float(i + 1), *[1.0] * 7], f"n={i}") for i in range(20)]
    schema = "vec_id long, embedding array<float>, payload string"
    df = spark.createDataFrame(rows, schema)
    c.put("docs", df, 1)
    payloads = lambda: {r.vec_id: r.payload for r in c.vectors("docs").collect()}
    assert payloads() == {i: f"n={i}" for i in range(20)}
    assert c.flush("docs") and not c.flush("docs")
    c.put("docs", spark.createDataFrame([(3, [9.0] * 8)], "vec_id long, embedding array<float>"), 2)  # keeps its payload
    c.delete("docs", spark.createDataFrame([(4,), (5,)], "vec_id long"), 3)
    c.put("docs", spark.createDataFrame([(5, [1.0] * 8, None)], schema), 4)  # came back without one
    wanted = {i: f"n={i}" for i in range(20) if i != 4} | {5: None}
    assert payloads() == wanted
    assert {r.layer for r in c.layers("docs").collect()} == {"run1", "delta"}
    c.consolidate("docs")
    assert payloads() == wanted and {r.layer for r in c.layers("docs").collect()} == {"base4"}
    assert c.codes("docs").kind == "int8" and c.codes("docs").table.count() == 19
    c.put("docs", spark.createDataFrame([(50, [50.0, *[0.0] * 7])], "vec_id long, embedding array<float>"), 5)
    assert [r.vec_id for r in c.search("docs", [1.0, *[0.0] * 7], 3).collect()] == [50, 19, 18]
    with pytest.raises(ValueError):
        c.search("docs", [1.0], 3)
    assert c.quota("t") == ("*", "*") and c.rates("t") == ("*", "*", "*")
    c.set_quota("t", "21", "*")
    c.set_rates("t", "10", "*", "3")
    assert c.quota("t") == ("21", "*") and c.rates("t") == ("10", "*", "3")
    one = lambda i: spark.createDataFrame([(i, [1.0] * 8, "x")], schema)
    c.put("docs", one(60), 6)
    c.put("docs", one(60), 7)  # an overwrite is free
    with pytest.raises(tenancy.QuotaExceeded):
        c.put("docs", one(61), 8)
    c.set_quota("t", "*", "2816")  # 21 or so records of 128 bytes
    with pytest.raises(tenancy.QuotaExceeded):
        c.put("docs", spark.createDataFrame([(i, [1.0] * 8, None) for i in range(100, 130)], schema), 8)
    assert c.vectors("docs").count() == 21
    for bad in ("-1", "x", ""):
        with pytest.raises(ValueError):
            c.set_quota("t", bad, "*")


def test_segments_are_read_up_to_the_first_damage(spark, tmp_path):
    from arcavec.sources import segments

    log = spark.range(100).select(F.col("id").alias("seq"), F.lit("a b").alias("key"), F.lit("SET").alias("op"), (F.col("id") * 2).alias("n"))
    segments.write_segments(log, str(tmp_path / "s"), F.floor(F.col("seq") / 10), F.col("seq").isin(0, 25, 27, 39))
    assert segments.list_segments(spark, str(tmp_path / "s")) == list(range(10))
    got = sorted((r.segment, r.pos, r.seq, r.key, r.op, r.n) for r in segments.scan_segments(spark, str(tmp_path / "s")).collect())
    whole = [i for i in range(100) if not (i < 10 or 25 <= i < 30 or i == 39)]
    assert got == [(i // 10, i % 10, i, "a b", "SET", 2 * i) for i in whole]


def test_running_values_over_buckets_equal_a_plain_fold(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.choice(["SET", "DEL", "INCRBY", "INCRBY", "INCRBY", "APPEND", "APPEND", "GET"]) if i > 60 else "INCRBY", rnd.randrange(200)) for i in range(400)]
    log = spark.createDataFrame(rows, "seq long, key string, op string, n long")
    counter, text, counts, lengths = {}, {}, {}, {}
    for seq, key, op, n in rows:
        if op == "SET":
            counter[key], text[key] = n, str(n)
        elif op == "DEL":
            counter[key], text[key] = 0, ""
        elif op == "INCRBY":
            counts[key, seq] = counter[key] = counter.get(key, 0) + n
        elif op == "APPEND":
            text[key] = text.get(key, "") + str(n)
            lengths[key, seq] = len(text[key])
    for bucket in (7, 50, 1 << 16):
        assert {(r.key, r.seq): r.value for r in state.running_counter(log, bucket).collect()} == counts
        assert {(r.key, r.seq): r.length for r in state.append_lengths(log, bucket).collect()} == lengths
        assert {r.key: r.value for r in state.appended(log, bucket).collect()} == text


def test_reclaim_moves_live_records_of_sparse_segments(spark):
    rows = [(0, 100, True), (0, 300, False), (1, 100, True), (1, 50, False), (2, 10, False)]
    after, freed = maintenance.reclaim(spark.createDataFrame(rows, "segment long, bytes long, alive boolean"))
    assert sorted((r.segment, r.bytes, r.alive) for r in after.collect()) == [(1, 50, False), (1, 100, True), (3, 100, True)]
    assert sorted((r.segment, r.freed) for r in freed.collect()) == [(0, 300), (2, 10)]


def test_log_numbers_of_large_ids_stay_apart(spark):
    from arcavec.sources import tables

    v = spark.createDataFrame([(i, [1.0]) for i in (0, 10, 999_999, 1_000_000, 1_000_010, 2_000_000, 3_400_000)], "vec_id long, embedding array<float>")
    log = tables.vectors_log(v)
    assert log.select("seq").distinct().count() == log.count()
    assert log.where(F.col("seq") < tables.BATCH).count() == 7


def test_quotas_and_costs(spark):
    writes = spark.createDataFrame([("a", i % 5, i) for i in range(10)] + [("b", i, i) for i in range(3)], "tenant string, vec_id long, seq long")
    limits = spark.createDataFrame([("a", 3)], "tenant string, max_vectors long")
    assert {(r.tenant, r.admitted, r.rejected) for r in tenancy.admit_vectors(writes, limits).collect()} == {("a", 3, 2), ("b", 3, 0)}
    row = spark.createDataFrame([("k", "v" * 107)], "key string, value string")
    assert row.select(tenancy.record_bytes(F.col("key"), F.col("value")).alias("n")).first().n == 256
    ops = spark.createDataFrame([("VSEARCH", 10, 100), ("RECLAIM", None, None), ("TENANT.ERASE", None, None), ("PING", None, None), ("GET", None, None)], "op string, k int, l int")
    got = {r.op: (r.kind, r.cost) for r in ops.select("op", tenancy.command_kind(F.col("op")).alias("kind"), tenancy.command_cost(F.col("op"), F.col("k"), F.col("l")).alias("cost")).collect()}
    assert got == {"VSEARCH": ("VectorRead", 110), "RECLAIM": ("Admin", 1000), "TENANT.ERASE": ("Admin", 100), "PING": ("Meta", 1), "GET": ("KvRead", 1)}
    assert spark.range(1).select(tenancy.unscoped(tenancy.scoped(F.lit("t"), F.lit("a::b"))).alias("n")).first().n == "a::b"
    with pytest.raises(ValueError):
        tenancy.erase_tenant(writes, "")


def test_upkeep(spark):
    rows = [("flush", 5000, 9, 9000, 10, 0, True), ("consolidate", 0, 1, 5000, 4000, 0, False), ("consolidate", 3000, 1, 1200, 9000, 0, True), ("runs-merge", 0, 4, 100, 9000, 9000, False), ("delete-patch", 0, 0, 0, 4096, 256, False), (None, 0, 0, 0, 4000, 4000, False)]
    df = spark.createDataFrame(rows, "want string, delta long, runs long, run_rows long, base long, tombstones long, idle boolean")
    assert all(r.want == r.job for r in df.withColumn("job", maintenance.due()).collect())
    us = spark.createDataFrame([("g", v) for v in (0, 1, 2, 3, 4, 10_000_000, 1 << 30)], "op string, us long")
    assert [r.b for r in us.select(maintenance.bucket_of(F.col("us")).alias("b")).collect()] == [0, 1, 2, 2, 3, 24, 25]
    assert maintenance.quantiles(us, {"p50": 0.5, "p100": 1.0}).first().asDict() == {"op": "g", "n": 7, "p50": 3, "p100": 16777216}


def test_streaming_ingest(spark, tmp_path):
    from arcavec.streaming import upsert

    schema = "seq long, op string, vec_id long, embedding array<float>"
    for i, rows in enumerate([[(1, "I", 1, [1.0]), (9, "D", 2, None)], [(3, "I", 2, [2.0]), (4, "I", 1, [3.0])]]):  # the delete arrives before what it deletes
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        upsert.append_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
        assert {r.vec_id: r.embedding for r in upsert.current(spark, str(tmp_path / "log")).collect()} == [{1: [1.0]}, {1: [3.0]}][i]
    upsert.compact(spark, str(tmp_path / "log"), str(tmp_path / "base"), 9)
    assert spark.read.parquet(str(tmp_path / "base")).count() == 1
