"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Each task that reads documents is a memtable: it flushes a run of (digest, id) entries, sorted by digest and
written with Parquet's own filter on the digest.  Compaction merges the runs into one entry for each digest, which
has the smallest identifier in the order asked for and the number of rows.  A digest with several rows is a hit;
a bitmap over the hits' digests sends only their texts on to byte verification, which compares the least and the
greatest text of a digest.  Digests whose texts differ are settled by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import filter_bits, key_filter, stash, through_filter, told_apart, without


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest": which id of equal texts stays.  A null text counts as an empty one.
    A null id loses against any other.  Of rows that repeat both id and text one is kept, the others are
    dropped rows of the same group.  Other columns are ignored, whatever their names; an empty table gives an
    empty result.  ``digest`` may be weak: byte verification keeps different texts apart.
    """
    settled = _found(docs, id_col, text_col, keep, normalise, digest)
    return settled.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def _found(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    keep: str,
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = _sha256,
    row: Column | None = None,
) -> DataFrame:
    """Rows (row, id, keep_id, n, kept, sha); ``row`` is the key of a row, or else its number."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    number = F.monotonically_increasing_id() if row is None else row
    own = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(own) if normalise else own
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), text.alias("text"))

    # memtables: a run for each task that reads, with no exchange
    runs = stash(
        rows.select("row", "id", digest(F.col("text")).alias("digest"), _sha256(F.col("text")).alias("sha")).sortWithinPartitions("digest"),
        "runs",
        **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000", "parquet.bloom.filter.max.bytes": "262144"},
    )
    index = stash(_compacted(runs, "digest", keep), "index")
    hits = index.where("n > 1").select("digest")
    n_hits = hits.count()

    bits = filter_bits(n_hits)
    bitmap = stash(key_filter(hits, "digest", bits), "filter")
    texts = rows.select(digest(F.col("text")).alias("digest"), "text")
    doubtful = (
        through_filter(texts, texts["digest"], bitmap, bits)
        .groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("digest")
    )
    doubtful = stash(doubtful, "doubtful")
    settled = _marked(runs, index, "digest")
    if not doubtful.isEmpty():
        apart = stash(
            rows.select("row", "id", "text", digest(F.col("text")).alias("digest"), _sha256(F.col("text")).alias("sha")).join(doubtful, "digest", "left_semi"),
            "apart",
        )
        settled = _marked(runs.join(doubtful, "digest", "left_anti"), index, "digest").unionByName(_marked(apart, _compacted(apart, "text", keep), "text"))
    return settled


def _compacted(runs: DataFrame, key: str, keep: str) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")) if keep == "smallest" else F.max(F.struct(F.col("id").isNotNull(), "id", "row"))
    return runs.groupBy(key).agg(first.alias("first"), F.count("*").alias("n")).select(key, F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n")


def _marked(runs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Entries with what stays of their group; only digests with several rows are looked up."""
    found = runs.join(index.where("n > 1"), key, "left")
    alone = F.col("n").isNull()
    return found.select(
        "row",
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("n"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row for each text; same columns.

    Rows are found again by their ids, or where ids are null or repeated by a key written with them, so that one row stays in any case.
    """
    keyed, row = told_apart(docs, id_col)
    found = stash(_found(keyed, id_col, text_col, keep, row=F.col(row)), "marked")
    left = without(keyed, row, found.where("NOT kept"), "row")
    return left if row == id_col else left.drop(row)
