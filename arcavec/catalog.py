"""Named vector indexes over one folder of Parquet tables.

Every index is a log of vectors and payloads in layers: writes go to ``delta``, a flush folds the
delta into a run, a consolidation folds everything into the base and stores codes of the index's
kind. All logs are one table with the index name as a partition, so a listing is one scan and one
aggregation. Registry, quotas and rates are small logs of their own in which the newest row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcavec.operators import codes as C, search, state, tenancy
from arcavec.operators.quantize import check_kind
from arcavec.operators.tenancy import QuotaExceeded, valid_name
from arcavec.sources import shared

BACKENDS = ("flat", "disk")
LOG = "seq long, op string, vec_id long, embedding array<float>, payload string, name string, layer string"
REGISTRY = "name string, dim int, kind string, backend string, tenant string, live boolean, seq long"
QUOTAS = "tenant string, max_vectors long, max_bytes long, seq long"
RATES = "tenant string, qps long, burst long, max_concurrent long, seq long"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, schema: str, *values) -> None:
        path = f"{self.root}/{table}"
        seq = (self._read(path, schema).agg(F.max("seq").alias("m")).first().m or 0) + 1
        self.spark.createDataFrame([(*values, seq)], schema).write.mode("append").parquet(path)

    def indexes(self) -> DataFrame:
        return state.newest(self._read(f"{self.root}/registry", REGISTRY), ["name"]).where("live")

    def create(self, name: str, dim: int, kind: str = "tq2", backend: str = "flat", tenant: str = "") -> None:
        if not valid_name(name):
            raise ValueError(f"not a name: {name!r}")
        if backend not in BACKENDS:
            raise ValueError(f"no such backend: {backend}")
        check_kind(kind, dim)
        if self.indexes().where(F.col("name") == name).count():
            raise ValueError(f"index {name} exists")
        self._append("registry", REGISTRY, name, dim, kind, backend, tenant, True)

    def drop(self, name: str) -> None:
        row = self._need(name)
        self._append("registry", REGISTRY, name, row.dim, row.kind, row.backend, row.tenant, False)
        for part in ("vectors", "codes"):
            shared.delete(self.spark, f"{self.root}/{part}/name={name}")

    def _need(self, name: str):
        row = self.indexes().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return row

    def _logs(self) -> DataFrame:
        return self._read(f"{self.root}/vectors", LOG)

    def log(self, name: str) -> DataFrame:
        self._need(name)
        return self._logs().where(F.col("name") == name)

    def _write(self, rows: DataFrame, name: str, layer: str, mode: str = "append") -> None:
        rows.select("seq", "op", "vec_id", "embedding", "payload").write.mode(mode).parquet(f"{self.root}/vectors/name={name}/layer={layer}")

    def set_quota(self, tenant: str, max_vectors: str, max_bytes: str) -> None:
        """QUOTA SET: each limit is a number or *."""
        self._append("quotas", QUOTAS, tenant, tenancy.limit(max_vectors), tenancy.limit(max_bytes))

    def quota(self, tenant: str) -> tuple[str, str]:
        """QUOTA GET."""
        r = state.newest(self._read(f"{self.root}/quotas", QUOTAS), ["tenant"]).where(F.col("tenant") == tenant).first()
        return ("*", "*") if r is None else (tenancy.shown(r.max_vectors), tenancy.shown(r.max_bytes))

    def set_rates(self, tenant: str, qps: str, burst: str, max_concurrent: str) -> None:
        """QOS SET: each limit is a number or *."""
        self._append("rates", RATES, tenant, *(tenancy.limit(x) for x in (qps, burst, max_concurrent)))

    def rates(self, tenant: str) -> tuple[str, str, str]:
        """QOS GET."""
        r = state.newest(self._read(f"{self.root}/rates", RATES), ["tenant"]).where(F.col("tenant") == tenant).first()
        return ("*", "*", "*") if r is None else tuple(tenancy.shown(x) for x in (r.qps, r.burst, r.max_concurrent))

    def _live_of(self, tenant: str) -> DataFrame:
        """(name, vec_id, embedding, payload) of all indexes of a tenant."""
        own = self.indexes().where(F.col("tenant") == tenant).select("name")
        return self._live(self._logs().join(F.broadcast(own), "name", "left_semi"))  # names of one tenant's indexes

    @staticmethod
    def _live(log: DataFrame) -> DataFrame:
        """Live vectors with their payload: the newest since the vector's last delete."""
        vectors = F.max_by(F.struct("op", "seq", "embedding"), F.when(F.col("op").isin("I", "D"), F.col("seq")))
        payload = F.max_by(F.struct("op", "payload"), F.when(F.col("op").isin("P", "D"), F.col("seq")))
        both = log.groupBy("name", "vec_id").agg(vectors.alias("v"), payload.alias("p")).where("v.op = 'I'")
        return both.select("name", "vec_id", "v.seq", "v.embedding", F.when(F.col("p.op") == "P", F.col("p.payload")).alias("payload"))

    @staticmethod
    def _bytes():
        value = F.length("name") + 8 + 4 * F.size("embedding") + F.coalesce(F.octet_length("payload"), F.lit(0))
        return F.floor((F.lit(tenancy.HEADER + tenancy.BLOCK - 1) + value) / tenancy.BLOCK) * tenancy.BLOCK

    def _admit(self, row, rows: DataFrame) -> None:
        """Raises where the tenant's vectors or bytes would be beyond its quota after the write."""
        most, size = (tenancy.limit(x) for x in self.quota(row.tenant))
        if most is None and size is None:
            return
        now = self._live_of(row.tenant).select("name", "vec_id", self._bytes().alias("held"))
        new = rows.withColumn("name", F.lit(row.name)).groupBy("name", "vec_id").agg(F.max(self._bytes()).alias("new"))
        r = now.join(new, ["name", "vec_id"], "full").agg(F.count("*").alias("n"), F.sum(F.coalesce("new", "held")).alias("bytes")).first()
        if most is not None and r.n > most:
            raise QuotaExceeded(f"tenant {row.tenant!r}: {r.n} vectors, the quota is {most}")
        if size is not None and (r.bytes or 0) > size:
            raise QuotaExceeded(f"tenant {row.tenant!r}: {r.bytes} bytes, the quota is {size}")

    def put(self, name: str, rows: DataFrame, seq: int) -> None:
        """Sets vectors (vec_id, embedding and, if there is such a column, payload) as one batch. A vector of another length or a tenant beyond its quota fails the batch before anything is written. Without a payload a vector keeps the one it has."""
        row = self._need(name)
        e = F.col("embedding").cast("array<float>")
        e = F.when(F.size(e) == row.dim, e).otherwise(F.raise_error(F.lit("wrong number of components")))
        payload = F.col("payload").cast("string") if "payload" in rows.columns else F.lit(None).cast("string")
        batch = shared.written(rows.select(F.lit(seq).cast("long").alias("seq"), F.lit("I").alias("op"), F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), payload.alias("payload")), "batch")
        self._admit(row, batch)
        texts = batch.where("payload is not null").withColumns({"op": F.lit("P"), "embedding": F.lit(None).cast("array<float>")})
        self._write(batch.withColumn("payload", F.lit(None).cast("string")).unionByName(texts), name, "delta")

    def delete(self, name: str, ids: DataFrame, seq: int) -> None:
        self._need(name)
        gone = ids.select(F.lit(seq).cast("long").alias("seq"), F.lit("D").alias("op"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("payload"))
        self._write(gone, name, "delta")

    def vectors(self, name: str) -> DataFrame:
        """(vec_id, seq, embedding, payload) of live vectors."""
        return self._live(self.log(name)).drop("name")

    def layers(self, name: str) -> DataFrame:
        """(layer, rows) of an index's log."""
        return self.log(name).groupBy("layer").agg(F.count("*").alias("rows"))

    def _folded(self, log: DataFrame) -> DataFrame:
        """The newest vector row and the newest payload row of each id, tombstones with them."""
        kind = F.when(F.col("op") == "P", "P").otherwise("V")
        return state.newest(log.select("seq", "op", "vec_id", "embedding", "payload", kind.alias("_kind")), ["vec_id", "_kind"]).drop("_kind")

    def flush(self, name: str) -> bool:
        """Folds the delta into a run; False if there is nothing in it. The run is written before the delta goes, and reading both gives the same state."""
        delta = self.log(name).where("layer = 'delta'")
        last = delta.agg(F.max("seq").alias("m")).first().m
        if last is None:
            return False
        self._write(self._folded(delta), name, f"run{last}", "overwrite")
        shared.delete(self.spark, f"{self.root}/vectors/name={name}/layer=delta")
        return True

    def consolidate(self, name: str) -> None:
        """Folds all layers into a new base without tombstones and stores codes of its vectors."""
        row, log = self._need(name), self.log(name)
        old = [r.layer for r in log.select("layer").distinct().collect()]
        live = shared.written(self._live(log), "live")
        upto = log.agg(F.max("seq").alias("m")).first().m or 0
        texts = live.where("payload is not null").select("seq", F.lit("P").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), "payload")
        base = live.select("seq", F.lit("I").alias("op"), "vec_id", "embedding", F.lit(None).cast("string").alias("payload")).unionByName(texts)
        self._write(base.orderBy("vec_id"), name, f"base{upto}", "overwrite")
        for layer in old:
            if layer != f"base{upto}":
                shared.delete(self.spark, f"{self.root}/vectors/name={name}/layer={layer}")
        shared.delete(self.spark, f"{self.root}/codes/name={name}")
        if row.kind != "f32" and live.limit(1).count():
            C.build(live, row.kind, parts=8 if row.dim % 8 == 0 else 1).save(f"{self.root}/codes/name={name}")

    def codes(self, name: str) -> C.Codes | None:
        """The stored codes of the last consolidation, if there are any."""
        try:
            return C.open_codes(self.spark, f"{self.root}/codes/name={self._need(name).name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def search(self, name: str, query: Sequence[float], k: int, budget: int | None = None, mode: str = "bitplane") -> DataFrame:
        """(vec_id, score) of the k nearest by the index's kind: base rows by their codes, rows of later layers whole, all scored exactly at the end."""
        row, now = self._need(name), self.vectors(name)
        if len(query) != row.dim:
            raise ValueError(f"a query for {name} has {row.dim} components")
        stored = self.codes(name)
        if stored is None:
            return search.search(now, query, k)
        fresh = self.log(name).where("not startswith(layer, 'base')").select("vec_id").distinct()
        old = stored.table.join(fresh, "vec_id", "left_anti")
        width = max(k, search.rerank_width(k) if budget is None else budget)
        best = C.proxies(stored, query, "asymmetric" if mode == "hybrid" else mode, old).orderBy(F.desc("proxy"), "vec_id").limit(width).select("vec_id")
        return search.score_ids(now, best.unionByName(fresh), query, k)

    def listing(self) -> DataFrame:
        """(name, dim, kind, backend, n_vectors) in order of names, in one plan."""
        counts = self._live(self._logs()).groupBy("name").agg(F.count("*").alias("n_vectors"))
        names = self.indexes().select("name", "dim", "kind", "backend")
        return names.join(counts, "name", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0))).orderBy("name")
