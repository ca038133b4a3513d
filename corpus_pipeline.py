"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes all that the stage before it kept; between stages the documents are a written
table. Filtering stages drop rows by id and leave the rest untouched. Defined results, stage by
stage: a row without an id is never dropped; a null or empty text is a text without words (in
quality it has a score like any other, in near_duplicates all such texts are copies, in
decontamination and pii they are clean, in packing they have length 1); of ties the document of
least id stays; repeated rows (one id) share the verdict on that id, so all of them stay or all
go; extra columns pass through, whatever their names. No stage has an equivalent in SQL (a fitted classifier, component labelling over
SimHash candidates and a random field are among them), so ``ORACLE_SQL`` is None and the stages
are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segquery.llm import decontaminate, packing, pii, quality, simhash
from segquery.llm.common import few, passing, stored, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids``, columns and order of columns unchanged."""
    gone = stored(ids.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier does not reject."""
    return _without(docs, quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("not keep"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near-duplicates (five words, similarity 0.8)."""
    classes = simhash.similar_components(docs)
    return _without(docs, classes.where("doc_id <> component_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every document."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        with passing(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            made.pop()  # the stage's result stays, what it needed on the way goes
    return docs
