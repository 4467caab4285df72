"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.

Defined cases, for every stage: a null or empty text is a document like any other (it is not toxic, has
no line to lose, no copies and no benchmark passage, and packs to the end token); a row with a null
id, and each of repeated rows, is judged for itself; texts of any length are read whole; extra columns
stay as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from lodestrand.llm.common import fresh, named, read, shared_checkpoints, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; learned from all labels (no fold is held out here).

    Without usable labels the grammar's own words and weights decide.  Ties at the threshold go.
    """
    terms, weights = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, "text", terms, weights)
    return scored.where(named(scored.columns)[-1] < toxicity.THRESHOLD).select(*named(docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in 10 documents or more stay in the first of them only; documents that had text and lose all of it go.

    The first is the one with the smallest id, a null id last; rows that share the smallest id each keep the
    line.  A null text stays null, and n_chars follows the text.
    """
    out = line_dedup.dedup_lines(docs, keep_first=True)
    left = named(out.columns)[-1]
    emptied = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) & ~left.rlike(r"\S")
    text = F.when(F.col("text").isNotNull(), left)
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return out.where(~emptied).select(*[new.get(name, column) for name, column in zip(docs.columns, named(docs.columns), strict=True)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays (similarity 0.8 on five words): the one with the smallest id, a null id last.

    Rows are judged by numbers of their own, so rows that share an id, or have none, are told apart; ties go
    to the smaller number.  The numbers depend on how a scan is split, so the numbered table is
    written once and all uses read that.  Texts without words have no copies.
    """
    row = fresh(docs.columns, "__row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_dedup.near_duplicates(numbered, doc_id=row, percent=80).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)
    first = groups.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("first"))
    return numbered.join(first.select(F.col("first")[row].alias(row)), row, "left_semi").select(*named(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of 10 words of a benchmark item go, or with a whole item of fewer; without items none goes."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size(named(found.columns)[-2]) == 0).select(*named(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences of 2048 tokens; one row per piece, equal rows each for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and hashed placements have no SQL form; stages and run() are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A stage's folder goes when the next one is complete; the last one stays, for the result is read from it.
    """
    folder = f"{shared_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
