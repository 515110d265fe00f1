"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last
return the columns of documents. Each is written to the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm import line_templates, minhash, mixing, packing, perplexity
from equipoise.llm.shared import WORD, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's band of perplexity.

    A null or empty text goes, as it has too few words; a null lang is a language of its own; rows without a
    doc_id and repeated rows are judged like others. Columns other than those of documents are left out,
    whatever their names. An empty table gives no rows.
    """
    return perplexity.judge(docs.select(*COLUMNS), carry=True).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which nothing else is left goes.

    Passages that just two documents share stay here: most are in near copies, which the next stage takes whole, where
    this one would leave the lines in which they differ. A document that loses no line stays as it is, null and empty texts too; n_chars is counted anew where lines
    went. Repeated rows are treated alike. Columns other than those of documents are left out. An empty table gives no rows.
    """
    out = line_templates.dedup(docs.select(*COLUMNS), passage_docs=3)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(WORD)
    return out.where(left).select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, once if the row repeats.

    Rows that share a doc_id are told apart by their texts. Documents without a shingle (null, empty) are groups of their
    own; rows without a doc_id stay, all of them. Columns other than those of documents are left out. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs, with_text_key=True).where("kept and doc_id is not null").select("doc_id", F.col("text_key").alias("__text")).distinct()
    # rows that repeat are one before they are dealt out, however many
    one = docs.where("doc_id is not null").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return one.join(kept, ["doc_id", "__text"], "left_semi").select(*COLUMNS).union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows that are equal in all columns share what the mix takes of them in all, so that no source passes its target.
    Null sources are one source; a text without words adds nothing and goes with its source's full epochs alone. Columns other than those of documents are left out. An empty
    table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS])
    taken = mixing.mix(docs, keep=[row.alias("row_key")]).groupBy("doc_id", "row_key").agg(F.sum("epochs").alias("epochs"), F.count(F.lit(1)).alias("rows")).where("epochs > 0")
    taken = store(taken.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), "epochs", "rows"))
    keyed = docs.withColumn("__key", row)
    met = keyed.join(taken, (keyed["doc_id"].eqNullSafe(taken["__id"])) & (keyed["__key"] == taken["__row"]))
    # equal rows: one of them stands for all, so each of the few that repeat is met once
    once = met.where("rows = 1").select(*COLUMNS, "epochs").union(met.where("rows > 1").dropDuplicates(["doc_id", "__key"]).select(*COLUMNS, "epochs"))
    return once.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as can be.

    A null or empty text is the end id alone; repeated rows are documents of their own. Other columns are not read. An
    empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: The quality model, the templates, MinHash and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
