"""A training-data pipeline over documents: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next
one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelyn.llm import mixing, packing, quality, secret_scan, similar
from parcelyn.llm.common import documents, fresh_name, n_written, quoted, release, written
from parcelyn.llm.queries import tokenizer_path


#: Most documents in one training sequence.
MOST_DOCUMENTS = 32


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote model keeps.

    Null, empty and short texts fail the base rules and go; a row with a null doc_id and repeated rows are judged each;
    an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the group's least doc_id.

    Documents are near-duplicates at a five-word Jaccard similarity of 0.8 or more, and those that such pairs chain:
    candidates by fingerprints with Golay keys and by minimum hashes, verified on their shingles.
    Rows that share a doc_id are one document, of which the first by text remains; rows with a null one all remain.
    Only doc_ids are grouped, and texts meet the ids that go, which are fewer than those that stay.
    """
    key, rank = fresh_name(docs, "component"), fresh_name(docs, "rank")
    doc_id, text = (next(c for c in docs.columns if c.lower() == k) for k in ("doc_id", "text"))
    ids = similar.similar_documents(docs).groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows"))
    apart = written(ids.where("doc_id <> least OR rows > 1").select(F.col("doc_id").alias(key), (F.col("doc_id") == F.col("least")).alias("stays")), "ids-apart")
    meet = quoted(doc_id) == F.col(key)
    kept = docs.join(apart.select(key), meet, "left_anti")
    repeated = apart.where("stays")
    if not repeated.isEmpty():
        first = Window.partitionBy(quoted(doc_id)).orderBy(quoted(text))
        more = docs.join(repeated.select(key), meet, "left_semi").withColumn(rank, F.row_number().over(first))
        kept = kept.union(more.where(F.col(rank) == 1).select(*map(quoted, docs.columns)))
    return kept


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark.

    Null, empty and clean texts stay as they are, and so do all other columns; repeated rows are scanned each.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn mix: a row for each copy of a document that it takes.

    Texts without words are taken like others where their place is drawn; a null source is one source; rows that repeat
    a doc_id are drawn each; the row at which a source's words run out keeps only those that are due.
    """
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their ids and places in training sequences of at most MOST_DOCUMENTS pieces.

    Null and empty texts give the end id alone; a text longer than a sequence is cut; repeated rows are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), max_documents=MOST_DOCUMENTS)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; then what it read can go."""
    docs, first = documents(spark, sf_dir), n_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, first, keep_last=True)
    return docs


#: The model's fit, the links' closure and the packing aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None
