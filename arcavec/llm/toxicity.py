"""Toxicity: cumulative-link ordinal regression predicts a severity grade from the words of a text.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The weights are
shared by the two thresholds (see ``ordinal``). A document is rejected when P(grade > 0) is at
least ``REJECT``.

Defined cases: a null or empty text has only the thresholds' prior and stays; a label whose toxic is
null, or whose document is missing, isn't learned from; a document with several label rows is
learned with its most severe; without labels nothing is rejected; repeated rows each give a row; of
equally probable grades the least is the severity; a very long text has each feature once, however
often it holds it; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import ordinal

GRADES = 3
REJECT = 0.5


def severity(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row per labelled document."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.coalesce("quality", F.lit(1)) == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = ordinal.SAMPLE_ROWS) -> ordinal.Model:
    chosen = ordinal.hash_sample(severity(labels), "doc_id", sample_rows)
    return ordinal.fit(docs.select("doc_id", "text").join(chosen, "doc_id"), GRADES, 0, sample_rows=2 * sample_rows)


def predict(docs: DataFrame, model: ordinal.Model, text: str = "text") -> DataFrame:
    """``docs`` with expected_severity, p_toxic, severity (the most probable grade) and toxic."""
    tails = ordinal.grade_rows(docs, model, text)
    p = F.col("tails")
    return tails.withColumns({
        "expected_severity": F.aggregate(p, F.lit(0.0), lambda a, x: a + x),
        "p_toxic": p[0],
        "severity": F.when(1 - p[0] >= F.greatest(p[0] - p[1], p[1]), 0).when(p[0] - p[1] >= p[1], 1).otherwise(2).cast("long"),
        "toxic": p[0] >= REJECT,
    }).drop("tails")


def keep_clean(docs: DataFrame, model: ordinal.Model, text: str = "text") -> DataFrame:
    """The documents that aren't rejected."""
    return ordinal.keep_below(docs, model, REJECT, text)
