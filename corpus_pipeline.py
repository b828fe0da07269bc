"""From raw documents to token ids in five stages, each on all that the one before kept.

1. language ID: documents that the nearest-centroid model rejects go;
2. line dedup: lines that repeat across documents go, but for the last document that holds them;
3. n-gram Jaccard join: of each group of near or exact copies the document with the smallest doc_id stays;
4. mixing: documents are dropped or repeated so that sources come to their target weights;
5. SentencePiece: the ids of each document, and digests of the ids and of the text that they decode to.

A stage takes and returns the columns of documents (the last returns its results), whatever other columns there are. Each
output is written to the shared folder and read again, so a lost executor costs one stage at most. An empty table passes
through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_runs, mixing, ngram_join, sp_codec
from tidemark.llm.common import settle, sha256_utf8, ship, table

MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all documents with a lang; drops those without a letter (null and empty texts too) or far from every
    language. Of languages equally near the first by name is taken; repeated rows stay or go together. No shuffle of texts."""
    ship(spark)
    return langid.predict(docs, langid.fit(docs)).where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses lines gets a new n_chars; none is dropped, even if no line is left. A null text becomes empty.
    Rows that repeat a doc_id are one document; those without one are one too, smaller than any other."""
    ship(spark)
    kept = line_runs.drop_repeated_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return kept.withColumn("n_chars", length).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat doc_id and text are one document and stay or go together; rows without words stay. Of a group the
    smallest doc_id stays (none comes last), of equal ones that with the smallest hash of its text."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is taken twice gives two rows; documents without words (null texts too) are not taken. A null source
    is a source of its own. Rows of one doc_id share their place in the draw and are taken in the order of their size."""
    ship(spark)
    taken = mixing.mix(docs).where("taken > 0")
    passes = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return taken.select(*docs.columns, passes.alias("pass")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed little-endian unsigned 32-bit) and digests. A null text is empty: begin
    and end ids alone."""
    ship(spark)
    coded = sp_codec.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL), decoded="decoded")
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), sha256_utf8(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", copies), ("mixing", weights), ("sentencepiece", tokens)]
#: SQL cannot express language ID; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
