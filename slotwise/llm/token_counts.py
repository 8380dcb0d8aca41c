"""Token counts: an exact histogram of encoded lengths answers every context limit by suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from slotwise.llm.bpe import count_tokens

#: Lengths per block of the two-level suffix sums.
BLOCK = 256


def length_histogram(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Documents per encoded length: n_tokens, n_docs (null and empty texts have length 0)."""
    return count_tokens(docs, vocabulary_path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """What each context limit that occurs as a length keeps and cuts.

    Input: n_tokens, n_docs. Per length L: docs_longer and tokens_longer (documents over L and their
    tokens), docs_up_to (documents of at most L: the quantile rank of L), tokens_up_to,
    truncated_total (tokens left if every document is cut to L), tokens_cut. Between two lengths
    nothing changes but docs_longer tokens per step, see `at_limits`. An empty histogram gives no rows.

    Suffix sums run per block of BLOCK lengths and over the block totals, so the largest window holds
    the longest length / BLOCK rows, whatever the number of documents.
    """
    rows = histogram.select(
        F.col("n_tokens"), F.col("n_docs"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.partitionBy(F.lit(1)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    totals = totals.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"))
    own = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(totals, "block")
        .withColumn("docs_longer", F.col("docs_after") + F.coalesce(F.sum("n_docs").over(own), F.lit(0)))
        .withColumn("tokens_longer", F.col("tokens_after") + F.coalesce(F.sum("tokens").over(own), F.lit(0)))
        .select(
            "n_tokens", "n_docs", "docs_longer", "tokens_longer",
            (F.col("docs_all") - F.col("docs_longer")).alias("docs_up_to"),
            (F.col("tokens_all") - F.col("tokens_longer")).alias("tokens_up_to"),
            (F.col("tokens_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer"))
            .alias("truncated_total"),
            (F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")).alias("tokens_cut"))
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any limits: context_limit, n_docs, n_tokens, docs_longer, truncated_total, tokens_cut."""
    wanted = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context_limit")
    n, d = F.col("n_tokens"), F.col("n_docs")
    return histogram.select("*", wanted).groupBy("context_limit").agg(
        F.sum("n_docs").alias("n_docs"), F.sum(n * d).alias("n_tokens"),
        F.sum(F.when(n > F.col("context_limit"), d).otherwise(0)).alias("docs_longer"),
        F.sum(F.least(n, F.col("context_limit")) * d).alias("truncated_total"),
        F.sum(F.greatest(n - F.col("context_limit"), F.lit(0)) * d).alias("tokens_cut"))


def quantile_lengths(totals: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that covers each share of the documents: share, n_tokens."""
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    covers = F.col("docs_up_to") >= F.col("share") * (F.col("docs_up_to") + F.col("docs_longer"))
    return totals.select("*", share).where(covers).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
