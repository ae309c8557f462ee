"""Quality: cumulative-link ordinal regression on graded ratings of a text's words and word shapes.

Ratings come from the labels: 0 low quality, 1 good but toxic, 2 good. The weights of the hashed
text are shared by both ordered thresholds (see ``ordinal``); they give an expected rating and the
tail probability P(rating > 0) by which documents are selected.

Defined cases: a null or empty text has only the thresholds' prior; a label whose quality is null, or
whose document is missing, isn't learned from; a document with several label rows is learned with its
lowest rating; without labels everything is selected; repeated rows each give a row; a very long text
has each feature once, however often it holds it; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcavec.llm import ordinal

GRADES = 3
SELECT = 0.5


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row per rated document."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = ordinal.SAMPLE_ROWS) -> ordinal.Model:
    chosen = ordinal.hash_sample(ratings(labels), "doc_id", sample_rows)
    return ordinal.fit(docs.select("doc_id", "text").join(chosen, "doc_id"), GRADES, GRADES - 1, shapes=True, sample_rows=2 * sample_rows)


def predict(docs: DataFrame, model: ordinal.Model, text: str = "text") -> DataFrame:
    """``docs`` with expected_quality, p_good and selected."""
    tails = ordinal.grade_rows(docs, model, text)
    p = F.col("tails")
    return tails.withColumns({"expected_quality": F.aggregate(p, F.lit(0.0), lambda a, x: a + x), "p_good": p[0], "selected": p[0] >= SELECT}).drop("tails")
