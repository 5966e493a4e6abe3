"""A corpus pipeline: junk and toxic documents go, then repeated lines, near duplicates and benchmark passages; what
is left is packed into sequences.

Each stage takes (spark, docs, folder of the tables) and returns a table; it is written and read again before
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm.catalog import table
from ticklane.llm.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither junk nor toxic."""
    from ticklane.llm.quality import is_kept, with_quality

    return with_quality(docs, table(spark, sf_dir, "labels")).filter(is_kept()).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that had nothing else; n_chars follows the text."""
    from ticklane.llm.line_templates import drop_recurring_lines

    changed = drop_recurring_lines(docs, count_column="dropped_lines")
    changed = changed.filter((F.col("dropped_lines") == 0) | (F.length(F.trim("text")) > 0))
    return changed.withColumn("n_chars", F.when(F.col("dropped_lines") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    from ticklane.llm.simhash import drop_similar_documents

    return drop_similar_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    from ticklane.llm.decontaminate import decontaminate

    # a row is named by its id and text: ids may be null or repeated
    named = F.xxhash64("doc_id", "text")
    found = decontaminate(docs.select(named.alias("row"), "text"), table(spark, sf_dir, "benchmark"), doc_id="row")
    hit = stored(found.filter("contaminated").select(F.col("row").alias("_hit_row")).distinct())
    return docs.join(hit, named == F.col("_hit_row"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with the sequence and offset each is packed at."""
    import public_tokenizers

    from ticklane.llm.packing import pack, tokenized_pieces

    pieces = tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

# the classifier, the fingerprints and the tokenizer have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
