"""A corpus pipeline of five operators: quality, exact copies, near copies, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogena.llm.bpe import bpe_round_trip
from orogena.llm.common import new_path, stash, told_apart, without
from orogena.llm.exact_dedup import drop_exact_copies
from orogena.llm.mixing import TARGET_WEIGHTS, mixed
from orogena.llm.near_dedup import NearParams, near_duplicates
from orogena.llm.quality import accepted, train
from orogena.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of these documents.

    Each row is judged by its own text, whether its id is null or repeated; a null text is judged as an empty one, a very long one
    whole.  An empty table stays empty, and other columns are kept as they are, whatever their names.
    """
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the smallest id stays, a null id last, and of rows that repeat both one.

    A null text counts as an empty one; other columns are kept; an empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays, that with the smallest id.

    Rows are told apart by a key of their own where ids are null (last in order) or repeated.  A text without words is linked
    with nothing; very long texts are compared whole; other columns are kept; an empty table stays empty.
    """
    keyed, row = told_apart(docs, "doc_id")
    found = stash(near_duplicates(keyed, NearParams(words=5), row).select(F.col("doc_id").alias("found_row"), "component_id"), "found")
    ids = keyed.select(F.col(row).alias("found_row"), F.col("doc_id"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "found_row")
    first = found.join(ids, "found_row").groupBy("component_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, "component_id").where(F.col("found_row") != F.col("first.found_row"))
    left = without(keyed, row, gone, "found_row")
    return left if row == "doc_id" else left.drop(row)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which the sources take turns by their target weights.

    Rows with a null source, or one without a weight, share one turn; repeated rows stay; other columns are kept.
    """
    return mixed(docs, TARGET_WEIGHTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its number of tokens and the digests of its token ids and of the text decoded from them.

    A null text is encoded as an empty one, of no tokens; null ids and repeated rows are carried; an empty table gives an empty result.
    Documents that say where they stand (see :func:`in_order`) are given out in that order.
    """
    if not set(PLACE) <= set(docs.columns):
        return bpe_round_trip(docs, vocabulary())
    return bpe_round_trip(docs, vocabulary(), carried=PLACE).orderBy(*PLACE).drop(*PLACE)


#: Where a row stands in the files that a stage wrote: a file's name begins with the number of its task.
PLACE = ["__file", "__at"]


def in_order(spark: SparkSession, path: str) -> DataFrame:
    """A stage's rows with their places, as a read doesn't keep the order of the files."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: SQL can express neither the classifier nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's documents; the result is in the order of the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = in_order(spark, path) if stage in (mixing, encoding) else spark.read.parquet(path)
    return docs.orderBy(*PLACE).drop(*PLACE)
