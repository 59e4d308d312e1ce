"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the
next one's input.

Defined results: null texts and ids are kept by each stage as by its operator; of documents with
equal or nearly equal texts the one of the smallest id stays; a document that the mix takes twice is
two rows of the mix's result; a table without labels rejects nothing for quality (score 0.5); an
empty table gives an empty result; further columns of ``documents`` go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_cnn, decontam, jaccard_join, source_mix, token_codes
from quarry.llm.common import col, fresh, scratch
from quarry.llm.queries import QUALITY_SCORE, SOURCE_WEIGHTS, held_out, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte classifier does not reject."""
    model = byte_cnn.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), held_out=held_out)
    name = fresh("__score", docs.columns)
    return byte_cnn.add_score(docs, model, name).where(col(name) >= QUALITY_SCORE).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them (none, one or two rows)."""
    return source_mix.mixed(docs, lambda i: SOURCE_WEIGHTS[i % len(SOURCE_WEIGHTS)], share=1.5, max_repeats=2)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable codes; per document where they stand in the files."""
    return token_codes.read_documents(spark, token_codes.write_codes(docs, tokenizer_path()))


STAGES = [("quality", quality), ("near copies", near_copies), ("benchmark", benchmark), ("source mix", mix), ("token ids", token_ids)]

#: The classifier is trained and the tokenizer is a library: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
