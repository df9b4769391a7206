"""Corpus pipeline: five stages over documents, each an operator of ``tallyforge.llm``.

A stage takes (spark, docs, sf_dir) and returns the next documents; the last returns packed
pieces. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD, fresh, saved, table
from tallyforge.llm.jaccard import drop_near_duplicates
from tallyforge.llm.linededup import dedup_lines
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.toxicity import THRESHOLD, held_out, toxicity_score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. Held-out labels are not learnt.

    Null and empty texts are scored as texts without words; repeated rows have one score; a very
    long text is scored whole; a score equal to the threshold is rejected; without documents
    nothing is left. All columns, whatever their names, stay as they are.
    """
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return docs.where(toxicity_score(F.col("text"), model) < THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs, n_chars counted anew; documents that consisted of such copies alone go.

    Null and empty texts stay; repeated rows (of one id and text) are one document and all stay;
    a very long text is judged whole; the smallest id, then the smallest hash of the text, then
    the first line is the original. All columns but text and n_chars stay as they are.
    """
    names = fresh(docs, "_lines", "_removed", "_cut")
    out = dedup_lines(docs, names=tuple(names))
    changed = F.col(names[1]) > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~changed | F.col("text").rlike(WORD)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, then the smallest hash of the text; a null id comes last.

    Of repeated rows one stays; rows without words all stay; a very long text is compared whole.
    All columns, whatever their names, stay as they are.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document.

    Documents without words are never taken; a null source is a source; repeated rows are drawn
    one by one; a very long text counts with all its words. All columns stay as they are.
    """
    names = fresh(docs, "_size", "_source_size", "_target", "_repeats", "_taken", "_copy")
    out = mix_sources(docs, names=names[:5]).where(F.col(names[3]) > 0)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), names[3])).alias(names[5])).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences, a row for each piece of each row.

    A null or empty text is one piece of one token; repeated rows are packed each; a very long
    text has as many pieces as it needs. Other columns, whatever their names, are left out.
    """
    return pack_documents(docs).drop("certified")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: None: SQL can express neither the learnt scores nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is computed once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
