"""Token counts: an exact histogram of encoded lengths, and what suffix sums over it answer for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .encode import encoder, read_tokenizer
from .shared import store


def length_histogram(docs: DataFrame, tokenizer_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Stored (length long, n_docs long): documents by the number of token ids of their whole text.

    Null and empty texts have length 0. Each batch sends one row for each length it has met, so what
    is shuffled is counts. An empty table gives no rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer.value)
        for batch in batches:
            seen = Counter(len(enc.encode(t.as_py())) // 4 for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lengths, "length long, n long")
    return store(seen.groupBy("length").agg(F.sum("n").alias("n_docs")))


def limits(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length met, taken as a context limit: what the corpus holds, up to and beyond it.

    length, n_docs, n_tokens (of that length), docs_ge and tokens_ge (of documents at least as long),
    docs_le, tokens_le, truncated_tokens (when every document is cut to this length) and quantile
    (share of documents no longer). Sums run over blocks of lengths first and then within each block,
    so no task needs all lengths.
    """
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("block"))
    each = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = each.select("block", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}0") for c in ("bd", "bt")], *[F.sum(c).over(every).alias(f"{c}1") for c in ("bd", "bt")])
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    le = rows.select("*", F.sum("n_docs").over(upto).alias("d"), F.sum("n_tokens").over(upto).alias("t")).join(starts, "block")
    le = le.select("length", "n_docs", "n_tokens", (F.col("d") + F.col("bd0")).alias("docs_le"), (F.col("t") + F.col("bt0")).alias("tokens_le"), "bd1", "bt1")
    out = le.withColumns({"docs_ge": F.col("bd1") - F.col("docs_le") + F.col("n_docs"), "tokens_ge": F.col("bt1") - F.col("tokens_le") + F.col("n_tokens")})
    return out.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge", "docs_le", "tokens_le",
        (F.col("tokens_le") + F.col("length") * (F.col("docs_ge") - F.col("n_docs"))).alias("truncated_tokens"),
        (F.col("docs_le") / F.col("bd1")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit` tokens; 0 for an empty table."""
    return histogram.select(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs"))).head()[0] or 0


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length such that at least `share` of the documents are no longer; None for an empty table."""
    return limits(histogram).where(F.col("quantile") >= share).agg(F.min("length")).head()[0]
