"""Exact length histogram of encoded documents.

Workers count their documents by encoded length, so only (length, count) pairs
are shuffled. Suffix sums over the lengths then answer, for any context limit
L: how many documents are at least that long, the tokens in them, and the
tokens that remain when every document is cut at L. The sums run in two levels
(blocks of lengths, then within a block), so no task gathers all lengths.

Cases: null and empty texts count as length 0. Ties share a row. Repeated rows
count as often as they occur. Very long texts are encoded whole. An empty table
gives no rows, and ``at_limit`` zeros. Only the text is read, so clashing names do
no harm.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .tokens import default_tokenizer, encode

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): the exact histogram."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts[len(encode(text.as_py(), path))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["n_tokens", "n_docs"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L present: documents and tokens at L, documents and tokens in
    documents of length >= L, and ``tokens_cut``, the total when all documents
    are cut at L; ``share_below`` is the share of documents shorter than L."""
    block = F.expr(f"n_tokens div {BLOCK}")
    hist = stored(hist)  # both levels read it; the texts are encoded once
    h = hist.select(block.alias("block"), "n_tokens", "n_docs", (F.col("n_docs") * F.col("n_tokens")).alias("n_total"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_total").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("docs_all"),
        F.sum("t").over(every).alias("tokens_all"),
    )
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").withColumns(
        {
            "docs_from": F.sum("n_docs").over(inner) + F.col("docs_after"),
            "tokens_from": F.sum("n_total").over(inner) + F.col("tokens_after"),
        }
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "n_total",
        "docs_from",
        "tokens_from",
        (F.col("tokens_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_cut"),
        (1 - F.col("docs_from") / F.col("docs_all")).alias("share_below"),
        "docs_all",
        "tokens_all",
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, present as a length or not: documents and
    tokens longer than it, tokens kept when cut there."""
    over = sums.where(F.col("n_tokens") > limit)
    first = over.agg(F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("f"))
    total = sums.agg(F.max("tokens_all").alias("tokens_all"))
    zero = F.lit(0).cast("long")
    n, t = F.coalesce("f.docs_from", zero), F.coalesce("f.tokens_from", zero)
    return first.crossJoin(F.broadcast(total)).select(  # one row each
        F.lit(limit).alias("context_limit"), n.alias("docs_over"), t.alias("tokens_over"),
        (F.coalesce("tokens_all", zero) - t + n * limit).alias("tokens_cut"),
    )


def quantile(q: float) -> Column:
    """Aggregate over ``suffix_sums``: the least length that a share ``q`` of
    the documents doesn't exceed."""
    reached = F.col("docs_all") - F.col("docs_from") + F.col("n_docs") >= F.ceil(F.lit(q) * F.col("docs_all"))
    return F.min(F.when(reached, F.col("n_tokens")))
