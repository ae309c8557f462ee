import hashlib
import random

import numpy as np
import pytest
from brute import DATA, similar, stripped, without_hits

import corpus_pipeline as P
from arcavec.llm import bpe, queries, toxicity
from arcavec.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: toxic documents, near copies, long repeated passages, benchmark text, nulls."""
    rnd = random.Random(9)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ta", "ré", "su") for b in ("na", "ke", "po", "di", "ra", "bu", "xi", "vo")]
    prose = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(n))
    bench = [(i, prose(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        text = prose(rnd.randint(20, 90))
        if i % 6 == 0:
            text += " awfulword " + prose(5)
        docs.append(text)
        labels.append((i, 1, int(i % 6 == 0)))
    passage, short = prose(90), " ".join(f"{a}{b}" for a in "abcdefg" for b in "hijklmno")[: 3 * 52 - 1]
    docs += [prose(30) + f" {x} " + prose(30) for x in (short, short.upper(), prose(55), passage)]
    docs += [docs[1] + " tail", docs[1], docs[1], docs[2] + " " + passage, passage + " " + docs[3], bench[0][1], docs[4] + " " + bench[1][1].upper() + " " + docs[5], "", None]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_equals_its_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.predict(docs, model).where("toxic").collect()}
    assert toxic == {i for i in range(260) if i % 6 == 0}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    groups = similar(rows, 80, 5)
    rows = [x for x in rows if groups[x[0]][1] == x[0]]
    cut = stripped([t for _, t in rows], 400, 51)
    assert sum(c != t for (_, t), c in zip(rows, cut, strict=True)) >= 5
    rows = [(i, c) for (i, t), c in zip(rows, cut, strict=True) if c is not None or t is None]
    rows = without_hits(rows, bench)
    codec = bpe.Codec(vocabulary())
    wanted = {}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        ids, _, _ = codec.encode(data, np.array([0, len(data)]))
        wanted[i] = (ids.tolist(), hashlib.sha256(data.tobytes()).hexdigest())
    out = P.run(spark, folder)
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in out.collect()} == wanted
    assert 269 not in wanted  # nothing but benchmark text


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    names = ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "byte_bpe"]
    assert [n for n, _ in P.STAGES] == names
    full = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None), (7, "some other words", "en", "s", 3), (7, "some other words", "en", "s", 3), (8, "y" * 100_000, "en", "s", 1)], COLUMNS)
    for docs in (odd, full.limit(0)):
        docs = docs.withColumnsRenamed({}).selectExpr("*", "'x' as k1", "1 as tails", "'y' as _row", "2 as spans")
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.count() == (0 if docs.isEmpty() else 5 - (name == "ngram_join") if name != "suffix_dedup" else 4), name
        assert P.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, folder):
    words = [f"w{i}" for i in range(100)]
    two = ["x" if i == 30 else "y" if i == 60 else w for i, w in enumerate(words)]  # 86 of 106 shingles of five words, 92 of 104 of three
    three = ["z" if i == 80 else w for i, w in enumerate(two)]  # too far from the first, near the second
    far = [f"q{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, two, three, far))], COLUMNS)
    assert sorted(r.doc_id for r in P.keep_one_of_near_copies(spark, docs, folder).collect()) == [0, 3]
    assert sorted(r.doc_id for r in P.keep_one_of_near_copies(spark, docs.where("doc_id <> 1"), folder).collect()) == [0, 2, 3]


def test_different_texts_of_one_doc_id_stay(spark, folder):
    rows = [(7, "some words", "en", "s", 1), (7, "other text here", "en", "s", 1), (7, "some words", "en", "s", 1), (8, "some words", "en", "s", 1)]
    kept = P.keep_one_of_near_copies(spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, "other text here"), (7, "some words")]


def test_passages_of_over_50_words_are_cut_from_both_documents(spark, folder):
    short = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    over, fifty, own = short[:51], short[10:60][::-1], short[5:60][::2] * 2
    texts = ["one " + " ".join(over) + " two", "three\t" + "\n".join(over) + "\tfour", "five " + " ".join(fifty) + " six", "seven " + " ".join(fifty) + " eight", " ".join(own) + " nine " + " ".join(own), None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in P.cut_repeats(spark, docs, folder).collect()}
    wanted = ["one  two", "three\t\tfour", *texts[2:]]
    assert {i: t for i, (t, _) in got.items()} == dict(enumerate(wanted))
    assert (got[0][1], got[1][1]) == (8, 11)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, same_rows, name):
    same_rows(queries.queries()[name](spark, str(DATA / "sf0.001")), queries.ORACLE[name])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
