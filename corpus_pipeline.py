"""A training-data pipeline over documents: five stages, each deciding over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between
stages the rows are written as Parquet to the shared folder and read again.

Defined results, in every stage: an empty table gives an empty result; columns besides those of documents are
dropped, whatever their names; nulls in lang, source and n_chars are kept or filled as said below; very long
texts are taken whole. Each stage says what becomes of null ids, null texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomix.llm import decontaminate, jaccard, language, line_dedup, pieces
from loomix.llm._store import save
from loomix.llm.registry import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, or no letter in it) go; lang becomes the prediction.

    Rows are predicted each, repeated ones alike; rows with a null id are predicted but not learned from. If no row
    has a lang to learn, all go.
    """
    model = language.train(docs.where(~language.held_out()))
    found = language.predict(docs, model, ["doc_id", "text", "source", "n_chars"])
    return found.where(F.col("lang_pred") != language.UND).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that five or more documents hold stay only in that of the largest id.

    No document goes, and n_chars becomes the new text's. Rows with a null id neither count nor lose lines; a null
    text becomes the empty one; rows that repeat an id are one document: they count once and all keep its lines.
    """
    kept = line_dedup.dedup_lines(docs, keep=["doc_id", "lang", "source"])
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 of their 5-word shingles the first one stays.

    Rows with a null id and texts without words are linked with nothing and stay. The first is the row of the
    smallest id. Rows that repeat an id are decided each by its own text: in such a table rows are known by a
    64-bit hash of id and text, which also breaks ties of the id, and of equal ones the smallest of the other columns stays.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = jaccard.similar_groups(known, threshold="0.8", shingle=5).where("doc_id = component_id").select("doc_id")
        kept = known.join(save(first, "first"), "doc_id", "left_semi").select(*COLUMNS)
    else:
        known = known.withColumn("key", F.xxhash64("doc_id", F.col("text").isNull(), "text"))
        groups = save(jaccard.similar_groups(known, threshold="0.8", shingle=5, id_col="key"), "row_groups").distinct()
        wordy = groups.where("n_shingles > 0").join(known.select("key", "doc_id").distinct(), "key")
        first = save(wordy.groupBy("component_id").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")).select("key"), "first")
        once = known.join(first, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
        kept = once.unionByName(known.join(groups.where("n_shingles = 0"), "key", "left_semi").select(*COLUMNS))
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one, go.

    Rows are judged each by their text, also those with a null id; null and empty texts hold nothing and stay, as
    does everything if the benchmark is empty.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("items") == 0).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids under merge-dropout, as digests, and whether they decode to the text.

    A row for each row; a null text has no ids and decodes to the empty one; null ids count as one id, and equal
    rows are encoded alike.
    """
    return pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), dropout=0.1, seed=20)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("jaccard", jaccard_stage),
    ("decontaminate", benchmark_stage),
    ("pieces", piece_stage),
]

#: Language models and piece segmentations have no SQL form; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
