"""A corpus from raw documents to packed training sequences: five stages, each a table of its own between the next.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents. Null, empty and wordless
texts go with the quality rules, as do documents that the rules reject; those that stay lack their failing lines, then the lines of
recurring templates (a text may be empty after that and is packed as one end token). Of a component of near copies the row with the
smallest id stays, and of repeated rows one. Rows with a null id stay, link with nothing, and are packed. Very long texts are cut
into pieces only by the last stage. An empty table gives no rows. Further columns of any name are handed on until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import common, decontamination, line_dedup, ngram_join, packing, quality_rules

#: Near duplicates share this percentage of their distinct shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return line_dedup.drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return ngram_join.keep_one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontamination.drop_contaminated(docs, common.load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(common.stash(packing.pieces(docs, packing.default_tokenizer(), with_ids=False)))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for _, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir))
        common.discard(*before)
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    common.discard(*before)  # the last stage has read it into its pieces
    return packed
