"""Token counts from an exact length histogram.

Documents are encoded in tasks and only their lengths are grouped, so what is shuffled is a row for each length and
task.  Suffix sums over the histogram then answer totals, quantiles and truncated totals for every context limit.
The sums run over groups of 256 lengths first and inside each group second, so no task orders the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogena.llm.bpe import loaded
from orogena.llm.common import stash
from orogena.llm.kernels import slices

#: Lengths in a group.
GROUP = 256


def lengths(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each row; a null text counts as an empty one, of no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            out = [len(ids) for _, part in slices(batch.column(0)) for ids in bpe.encode_batch([x.decode() for x in part])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """A row for each length that occurs: n_tokens, docs, and the suffix sums of :func:`with_suffix_sums`."""
    histogram = lengths(docs, vocabulary, text_col).groupBy("n_tokens").agg(F.count("*").alias("docs"))
    return with_suffix_sums(stash(histogram, "histogram"))  # it is read twice; encoding is not to be


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """From (n_tokens, docs): docs and tokens in documents at least that long, totals, and tokens left at that limit.

    ``truncated_tokens`` is the total if each document is cut at n_tokens; ``rank_from`` and ``rank_to`` are the
    places, from 1, of these documents in the order of length.  An empty histogram gives an empty result.
    """
    h = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / GROUP).alias("g"))
    later = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    groups = h.groupBy("g").agg(F.sum("docs").alias("gd"), F.sum("tokens").alias("gt"))
    groups = groups.select(
        "g",
        F.coalesce(F.sum("gd").over(later), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum("gt").over(later), F.lit(0)).alias("tokens_over"),
        F.sum("gd").over(everything).alias("all_docs"),
        F.sum("gt").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("g").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at_least, tokens_at_least = F.col("docs_over") + F.sum("docs").over(within), F.col("tokens_over") + F.sum("tokens").over(within)
    return (
        h.join(groups, "g")
        .select("n_tokens", "docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), "all_docs", "all_tokens")
        .select(
            "*",
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
            (F.col("all_docs") - F.col("docs_at_least") + 1).alias("rank_from"),
            (F.col("all_docs") - F.col("docs_at_least") + F.col("docs")).alias("rank_to"),
        )
    )


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row (context_limit) of ``limits``: docs that are longer, tokens kept and tokens cut off.

    The answer for a limit comes from the least length at or above it.
    """
    near = limits.select("context_limit").distinct().join(sums, sums["n_tokens"] >= F.col("context_limit"), "left")
    first = near.groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x"), F.max("all_tokens").alias("t"))
    total = sums.agg(F.max("all_tokens").alias("total"))
    n, t = F.coalesce("x.docs_at_least", F.lit(0)), F.coalesce("x.tokens_at_least", F.lit(0))
    out = first.join(F.broadcast(total)).select("context_limit", n.alias("docs_at_least"), (F.coalesce("total", F.lit(0)) - t + F.col("context_limit") * n).alias("tokens_kept"), (t - F.col("context_limit") * n).alias("tokens_cut"))
    return out


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length with at least that share of documents at or below it: (share, n_tokens)."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all_docs")))
    return sums.join(F.broadcast(asked), (rank >= F.col("rank_from")) & (rank <= F.col("rank_to"))).select("share", "n_tokens")

