"""Queries that SQL can't express, on the whole smallest tables, against plain versions."""

import hashlib

import numpy as np
import pytest
from brute import DATA, LOW, WORD, repeats
from pyspark.sql import functions as F

from arcavec.llm import license_scan, queries

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_suffix_dedup(spark, docs):
    ids = sorted(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    wanted = repeats([docs[i] for i in ids], 400)
    assert [got[i] for i in ids] == [w[:4] for w in wanted]


def test_tokens(spark, docs):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=queries.vocabulary(), special_tokens={})
    out = queries.op5_byte_bpe(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_licenses(spark, docs):
    """Whole notices: each place where all words of a template stand in a row is reported whole."""
    got = {(r.doc_id, r.license_id, r.word_start) for r in queries.op2_license_scan(spark, SF).where("coverage = 1").collect()}
    for name, text in license_scan.TEMPLATES.items():
        template = WORD.findall(text.translate(LOW))
        for i, t in docs.items():
            words = WORD.findall(t.translate(LOW))
            for k in range(len(words) - len(template) + 1):
                if words[k : k + len(template)] == template:
                    assert (i, name, k) in got


def test_models_answer_for_every_document(spark, docs):
    for query, columns in ((queries.op7_quality, ["p_good", "expected_quality"]), (queries.op8_language_id, ["score"]), (queries.op10_toxicity, ["p_toxic", "expected_severity"])):
        out = query(spark, SF)
        assert {r.doc_id for r in out.collect()} == set(docs)
        for c in columns:
            low, high = out.agg(F.min(c), F.max(c)).first()
            assert 0 <= low <= high <= 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string")
    assert license_scan.find_licenses(empty).count() == 0
