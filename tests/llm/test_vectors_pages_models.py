import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import DATA
from pyspark.sql import functions as F

from arcavec.llm import language_id, ordinal, pivot_dedup, quality, queries, toxicity, warc
from arcavec.llm.components import labels as label_components

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
    n = {r[0]: sum(r[0] in e for e in links) for r in rows}
    comp = {r[0]: r[0] for r in rows}
    if links:
        comp.update(zip(*(x.tolist() for x in label_components(*np.array(links).T))))
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_vectors_and_recall(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for size in [1] * 40 + [2, 3, 30, 60]:
        center = rng.normal(size=24)
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in center + rng.normal(size=24) * 0.09], len(rows) % 2))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, [2 * x for x in rows[0][1]], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), block=block).collect()}
    wanted = brute_links(rows)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in wanted.values())
    assert all(got[i][0] <= wanted[i][0] for i in wanted)
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.95 * len(wanted)


def test_recall_of_vectors_in_a_cone(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(0.33 * unit(rng.normal(size=(1500, 64))) + unit(rng.normal(size=64)))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    both = np.concatenate([x, 0.982 * x + np.sqrt(1 - 0.982**2) * side])
    rows = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(both)], VECTORS)
    exact = (unit(np.float32(both).astype(float)) @ unit(np.float32(both).astype(float)).T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivot_dedup.near_duplicates(rows).collect()}
    assert exact.sum() > 2000
    assert sum(got.values()) >= 0.9 * exact.sum() and all(got[i] <= n for i, n in enumerate(exact))
    assert len(pivot_dedup.spread_out(unit(x), 128)) == 128


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, 0.0], None), (7, [1.0, nan], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], 2), (10, [-1.0, 0.0], 1), (11, [], 1), (12, [1.0], 1), (13, [1.0, float("inf")], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit("clash")).withColumn("id", F.lit(0))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(df).collect()} == brute_links(rows)
    repeated = spark.createDataFrame([(1, [1.0, 0.0], 1)] * 3 + [(None, [1.0, 0.0], 1)], VECTORS)
    assert sorted((r.vec_id or 0, r.n_links) for r in pivot_dedup.near_duplicates(repeated).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0)]
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0


RECORDS = "record_id long, record_type string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload_digest string"


def test_spellings_of_a_url(spark):
    urls = {"http://www.Example.com:80/a/": "example.com/a", "HTTPS://example.com/a?b=2&utm_source=x&a=1#f": "example.com/a?a=1&b=2", "https://example.com": "example.com", "no url": None, None: None, "http:///x": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.c for r in df.select(warc.canonical_url(F.col("u")).alias("c")).collect()] == list(urls.values())


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_revisits_equal_brute_force(spark, slices):
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        kind = rnd.choice(["response", "revisit"])
        url = rnd.choice(["http://a.org/x", "https://www.a.org/x/", "http://b.org", None]) if i % 3 else "http://a.org/x#" + str(i)
        rows.append((i, kind, url, rnd.choice([None, *range(40)]) if i % 10 == 0 else rnd.randrange(40), rnd.choice([None, '"1"', '"2"']), rnd.choice([None, "m1", "m2"]), rnd.choice([None, {"A": "1", "Content-Length": str(i), "Server": f"s{i}"}, {"a": f"{i}", "ETag": "e"}]), f"d{i}" if kind == "response" else None))
    key = lambda u: None if u is None else u.split("#")[0].split("://")[1].removeprefix("www.").rstrip("/")
    wanted = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        past = [p for p in rows if p[1] == "response" and key(p[2]) == key(r[2]) and p[3] is not None and r[3] is not None and (p[3], p[0]) < (r[3], r[0])]
        best = max(past, key=lambda p: (p[3], p[0]), default=None)
        if r[2] is None:
            wanted[r[0]] = (None, "no url", None, None)
        elif best is None:
            wanted[r[0]] = (None, "no earlier response", None, None)
        elif r[4] is not None and r[4] != best[4] or r[4] is None and r[5] is not None and r[5] != best[5]:
            wanted[r[0]] = (None, "validator differs", None, None)
        else:
            merged = {k.lower(): v for k, v in (best[6] or {}).items()} | {k.lower(): v for k, v in (r[6] or {}).items() if k.lower() not in warc.KEPT_FIELDS}
            wanted[r[0]] = (best[0], "resolved", sorted(f"{k}: {v}" for k, v in merged.items()), best[7])
    df = spark.createDataFrame(rows, RECORDS).withColumn("slice", F.lit("clash"))
    got = {r.record_id: (r.response_id, r.outcome, r.headers, r.payload_digest) for r in warc.resolve_revisits(df, slices).collect()}
    assert got == wanted
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_with_outlier_times_and_repeated_rows(spark):
    rows = [(i, "response" if i % 2 else "revisit", "http://a.org/x", 1000 + i, None, None, {"A": "v" * 200_000} if i == 5 else None, f"d{i}") for i in range(400)]
    rows += [(1000, "response", "http://a.org/x", -(10**15), None, None, None, "early"), (1001, "revisit", "http://a.org/x", 10**15, None, None, None, None), (1001, "revisit", "http://a.org/x", 10**15, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORDS)
    got = sorted((r.record_id, r.payload_digest) for r in warc.resolve_revisits(df).collect())
    assert got == sorted([(i, "early" if i == 0 else f"d{i - 1}") for i in range(0, 400, 2)] + [(1001, "d399")] * 2)
    bounds = df.agg(F.percentile_approx(F.col("ts").cast("double"), [k / 256 for k in range(1, 256)]).alias("b")).first().b
    assert len(set(bounds)) > 200  # times far from all others don't take the slices of the rest


def test_header_names_in_several_cases_stay_one(spark):
    df = spark.createDataFrame([({"A": "1", "a": "2"}, {"B": "3", "Content-Length": "9"})], "s map<string,string>, u map<string,string>")
    assert df.select(warc.merged_headers(F.col("s"), F.col("u")).alias("h")).first().h == ["a: 2", "b: 3"]


def split(docs):
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return docs.where(~test), docs.where(test)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(str(DATA / "sf0.1/documents.parquet")), spark.read.parquet(str(DATA / "sf0.1/labels.parquet"))


def test_toxicity_on_documents_held_out(spark, tables):
    docs, labels = tables
    train, test = split(docs)
    r = toxicity.predict(test, toxicity.fit(train, labels)).withColumnRenamed("toxic", "guess").join(labels, "doc_id").agg(F.avg((F.col("guess") == (F.col("toxic") == 1)).cast("int")).alias("acc"), F.count_if(F.col("guess") & (F.col("toxic") == 0)).alias("false"), F.count_if(F.col("guess")).alias("all")).first()
    assert r.acc >= 0.93 and r.false <= 0.1 * r.all


def test_quality_on_documents_held_out(spark, tables):
    docs, labels = tables
    train, test = split(docs)
    r = quality.predict(test, quality.fit(train, labels)).join(labels, "doc_id").agg(F.avg((F.col("selected") == (F.col("quality") == 1)).cast("int")).alias("acc")).first()
    assert r.acc >= 0.95


def test_language_on_documents_held_out(spark, tables):
    found = queries.op8_language_id(spark, str(DATA / "sf0.1")).join(tables[0].select("doc_id", "lang"), "doc_id").where("held_out")
    r = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.acc >= 0.97 and 0 <= r.low <= r.high <= 1


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "12 + 3!", "de"), (6, "the dog", None), (None, "die Katze", "de"), (6, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", language_id.held_out())
    assert df.where("doc_id is null and not held_out").count() == 1
    model = language_id.fit(df.where("doc_id is not null"))
    assert sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify(df.drop("lang"), model).collect()) == [(0, "de"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    none = language_id.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.identify(df.drop("lang"), none).collect()} == {("und", 0.0)}
    assert language_id.identify(df.limit(0), model).count() == 0


def plain_bayes(train, texts, bits=16):
    """Multinomial naive Bayes over hashed character bigrams and trigrams, one character at a time."""

    def grams(text):
        low = [ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 0x250 else ord(c) for c in text]
        for n in (2, 3):
            for k in range(len(low) - n + 1):
                h = n
                for c in low[k : k + n]:
                    h = (h ^ c) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                yield (h * 0x85EBCA6B % 2**32) >> (32 - bits)

    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter(g for t, x in train if x == lang for g in grams(t)) for lang in langs}
    out = []
    for text in texts:
        score = []
        for lang in langs:
            total = sum(counts[lang].values()) + 0.5 * 2**bits
            score.append(math.log(sum(x == lang for _, x in train) / len(train)) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(text)))
        best = max(range(len(langs)), key=lambda k: score[k])
        out.append((langs[best], 1 / sum(math.exp(s - score[best]) for s in score)))
    return out


def test_language_equals_a_plain_version(spark):
    rnd = random.Random(6)
    letters = {"aa": "abcdeé", "bb": "bcdefß", "cc": "xyzÄöü", "dd": "abcxyz"}
    text = lambda lang, n: "".join(rnd.choice(letters[lang] + " AB") for _ in range(n))
    train = [(text(lang, rnd.randint(0, 60)), lang) for lang in ("aa", "aa", "aa", "bb", "cc", "dd") for _ in range(20)]
    texts = [text(lang, n) for lang in letters for n in (1, 2, 3, 5, 8, 40)] + ["Q", text("bb", 200_000)]
    model = language_id.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score) in enumerate(plain_bayes(train, texts)):
        if any(c.isalpha() for c in texts[i]):
            assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, i
    assert got[len(texts) - 2][0] == "aa"  # no bigram: the prior decides
    assert language_id.bucket_bits(4) == 16 and language_id.bucket_bits(512) == 16
    for n in (513, 20_000, 1 << 30):
        assert n << language_id.bucket_bits(n) <= language_id.CELLS or n == 1 << 30


def test_many_languages_share_a_bounded_matrix(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 12)
    rows = [(i, f"{chr(97 + i % 20)}{chr(97 + i // 20)}" * 5, f"l{i}") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.weights.shape == (60, 64) and len(model.langs) == 60


def plain_ordinal(x, grade, k, l2=1e-6):
    """A dense cumulative-link fit by gradient descent with a halved step where the loss grows."""

    def loss(p):
        cuts = np.concatenate([[-50.0], p[-k] + np.concatenate([[0], np.cumsum(np.exp(p[len(p) - k + 1 :]))]), [50.0]])
        eta = x @ p[:-k]
        s = lambda z: 1 / (1 + np.exp(-z))
        return -np.log(np.maximum(s(cuts[grade + 1] - eta) - s(cuts[grade] - eta), 1e-12)).mean() + l2 / 2 * (p[:-k] ** 2).sum()

    p, step, best = np.zeros(x.shape[1] + k), 1.0, None
    for _ in range(3000):
        now = loss(p)
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in 1e-5 * np.eye(len(p))])
        while loss(p - step * g) > now and step > 1e-9:
            step /= 2
        p, step, best = p - step * g, step * 1.3, now
        if np.abs(g).max() < 1e-5:
            break
    return p, loss, best


def test_ordinal_fit_equals_a_plain_one():
    rng = np.random.default_rng(3)
    n = 600
    x = (rng.random((n, 4)) < [0.4, 0.3, 0.5, 0.2]).astype(float)
    score = x @ [2.0, 1.0, -1.5, 2.5] + rng.logistic(size=n)
    grade = np.digitize(score, [0.5, 2.0])
    row, feature = np.nonzero(x)
    model = ordinal.fit_rows(feature * 10, row, grade, 3, False)
    assert {0, 30} <= set(model.feature) <= {0, 10, 20, 30}
    x = x[:, model.feature // 10]  # the lasso has chosen; the plain fit has the same features
    p, loss, best = plain_ordinal(x, grade, 2)
    mine = np.concatenate([model.weight, [model.thresholds[0], np.log(np.diff(model.thresholds))[0]]])
    assert loss(mine) <= best + 1e-4
    tails = model.tails(x @ model.weight)
    plain = 1 / (1 + np.exp(-((x @ p[:-2])[:, None] - np.array([p[-2], p[-2] + np.exp(p[-1])]))))
    assert np.abs(tails - plain).max() < 0.02


@pytest.mark.parametrize("m", [toxicity, quality])
def test_predictions_equal_a_plain_sum_of_weights(spark, m):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(("fine", "good", "word", "plain", *(("awful", "nasty") if i % 4 == 0 else ()))) for _ in range(30))) for i in range(400)]
    labels = [(i, 0 if i % 8 == 0 else 1, int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame([*docs, (900, "fine nasty awful " * 40_000), (901, "awful"), (901, "awful"), (902, None)], "doc_id long, text string")
    model = m.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    table = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    rows = [(r.doc_id, r.text, r.expected_severity if m is toxicity else r.expected_quality) for r in m.predict(df, model).collect()]
    assert len(rows) == 404 and table
    for _, text, expected in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        feature, _ = ordinal.features(data, np.array([0, len(data)]), model.shapes)
        score = sum(table.get(f, 0.0) for f in set(feature.tolist()))
        assert abs(expected - sum(1 / (1 + math.exp(t - score)) for t in model.thresholds)) < 1e-4


def test_models_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "fine words"), (2, None), (3, ""), (4, "x" * 50_000), (4, "x" * 50_000), (None, "fine")], "doc_id long, text string").withColumn("tails", F.lit("clash")).withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for m, extra in ((toxicity, "toxic"), (quality, "selected")):
        for known in (labels, labels.limit(0)):
            out = m.predict(docs, m.fit(docs, known))
            assert out.count() == 6 and extra in out.columns
        assert m.predict(docs.limit(0), m.fit(docs.limit(0), labels.limit(0))).count() == 0
    model = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.predict(docs, model).collect())
    assert toxicity.keep_clean(docs, model).schema == docs.schema and toxicity.keep_clean(docs, model).count() == 6


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    n = 3000
    bad, worse = rng.random(n) < 0.3, rng.random(n) < 0.2
    grade = np.where(bad & worse, 2, np.where(bad | worse, 1, 0))
    row, feature = np.concatenate([np.flatnonzero(bad), np.flatnonzero(worse), np.arange(n)]), np.concatenate([np.full(bad.sum(), 11), np.full(worse.sum(), 22), 1000 + rng.integers(0, 50, n)])
    by = np.argsort(row, kind="stable")
    m = ordinal.fit_rows(feature[by], row[by], grade, 3, False)
    assert m.thresholds[0] < m.thresholds[1] and set(m.feature) == {11, 22}
    score = np.bincount(row[by], m.table()[feature[by]], minlength=n)
    expected = m.tails(score).sum(axis=1)
    assert np.abs(np.round(expected) - grade).mean() < 0.02
