"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
n_chars the length of the text as it has become. The driver, and run(), write each as Parquet for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import language_id, line_dedup, near_copies, packing, substring_dedup
from pagemill.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if its best language holds less than this share of its words' probability.
LEAST_SHARE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; those without letters, or in no language clearly, go. A missing
    label is filled in.

    Nulls: a null or empty text has no letter and goes; a null doc_id is carried, in no fold, and its text is not learned
    from. Long texts are judged whole. Of equal shares the first label by name wins. Repeated rows are judged alike. An
    empty table, or one without a label, leaves nothing. Columns besides those of documents are dropped.
    """
    model = language_id.fit(language_id.sampled(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "text", "lang", "doc_id"))
    judged = language_id.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return _documents(judged.withColumn("lang", F.coalesce("lang", "lang_pred")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more hold, except where the largest doc_id keeps them.

    Nulls: a null text becomes the empty one; a row without doc_id counts as no document and keeps no such line. A text
    that loses every line stays, empty. Rows that share a doc_id count as one document. An empty table stays empty. Other
    columns are dropped.
    """
    return _documents(line_dedup.dedup_lines(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) one row: the smallest doc_id's,
    one without an id only where none has one.

    Links come from the covering tables of SimHash fingerprints, checked on the texts; what these miss is found exactly.
    Nulls: null, empty and wordless texts are one group. Rows equal in all columns count as one; rows that share a
    doc_id but not the text are judged each; of rows with the smallest doc_id the smallest row hash stays. An empty table
    stays empty. Other columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    groups = near_copies.near_groups(docs)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    best = groups.groupBy("root").agg(F.min(order)["row"].alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = groups.join(best, "root").groupBy("row", "best").agg(F.count(F.lit(1)).alias("n"))
    # equal rows share a key: those that stay are taken out too, and one of them is put back
    going = stored(judged.where("row <> best or n > 1").select(F.col("row").alias("gone"), (F.col("row") == F.col("best")).alias("back")), "going")
    rows = near_copies.keyed(docs)
    kept = rows.join(going, F.col("row") == F.col("gone"), "left_anti").drop("row")
    if not going.where("back").isEmpty():
        kept = kept.union(rows.join(going.where("back"), F.col("row") == F.col("gone"), "left_semi").drop("row").distinct())
    return _documents(kept)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 13 or more words that stand in a smaller doc_id; the others keep their
    white space.

    Nulls: a null text stays null; a row without doc_id loses and takes nothing. Texts shorter than a passage stay. Rows
    that share a doc_id take nothing from each other. A text that loses every word stays, empty. An empty table stays
    empty. Other columns are dropped.
    """
    return _documents(substring_dedup.dedup_substrings(docs, whole_if_untouched=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048, with doc_id, lang and source.

    Nulls: a null text counts as empty and is its closing token alone; null ids are carried. Long texts are cut, each
    token lies in one piece. Repeated rows are packed each. An empty table gives no piece.
    """
    return packing.pack(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]
#: Conditional random fields, XXH64 and BPE are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
