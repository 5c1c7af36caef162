"""The corpus pipeline: from raw documents to token ids.

Each stage works on what the one before kept, written to the shared folder and
read again.  All stages but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm import bpe_codec, decontaminate, quality, shingles, substrings
from semspark.llm import common as C


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject."""
    return quality.keep_good(docs, C.table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return shingles.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller id has; ``n_chars`` follows the text."""
    names, counts = docs.columns, C.free_name(docs, "counts")
    cut = substrings.deduplicated(docs, counts)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col(counts)["n_removed"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))
    return cut.select(*names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.uncontaminated(docs, C.table(spark, sf_dir, "benchmark"))


def byte_pair_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian, 32 bits each), their number, and the digests of the ids and of the bytes decoded from them."""
    return bpe_codec.coded(docs).select("doc_id", "ids", *bpe_codec.digest_columns())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_pair_encoding),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
