"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its leading tokens, tokens with digits being variable fields. In a
leaf a token that too few documents have at its place is a variable field too, if enough of the line stays
constant; what then stays is the line's template. Too few is a share of the leaf's documents: the largest of
SHARES that leaves enough constant, so a busy leaf whose field values recur has the templates of a small one. Lines of a template that recurs across documents are
dropped everywhere but in the first document that has one. All counts are aggregates over the whole corpus; equal lines are one row
before anything is joined, so a very common line is one row and a busy leaf is never one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import drop, hash_words, mix, split_words, store

FIELD = np.uint64(0)

#: Shares of a leaf's documents that have a constant token, tried in order; `least_docs` documents at least.
SHARES = (0.1, 0.01, 0.0)
FILTER_BITS = 26


def parse(text: str | None, depth: int, least_tokens: int, constant: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number, leaf, line, tokens) of the \\n-split lines that have enough tokens and few enough variable ones; all lines at once.

    leaf and line are signed longs; tokens are hashes, FIELD for a token with a digit.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    word, starts, ends = split_words(raw)
    none = np.empty(0, dtype=np.int64)
    if not len(starts):
        return none, none, none, []
    found = hash_words(raw, word, ends - starts)
    digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
    found = np.where(digits[ends] > digits[starts], FIELD, found)
    of_line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    first = np.flatnonzero(np.concatenate(([True], of_line[1:] != of_line[:-1])))
    size = np.diff(np.concatenate((first, [len(found)])))
    place = np.arange(len(found)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        each = mix(found ^ mix((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        leaf = mix(np.add.reduceat(np.where(place < depth, each, np.uint64(0)), first) ^ size.astype(np.uint64)).view(np.int64)
        line = mix(np.add.reduceat(each, first) + size.astype(np.uint64)).view(np.int64)
    kept = np.add.reduceat((found != FIELD).astype(np.int64), first)
    good = np.flatnonzero((size >= least_tokens) & (kept >= constant * size))
    return of_line[first[good]], leaf[good], line[good], [found[first[i] : first[i] + size[i]] for i in good]


def lines(docs: DataFrame, depth: int, least_tokens: int, constant: float) -> DataFrame:
    """Stored: a row for each distinct line of each document, with doc (a hash of id and text), doc_id, leaf, line, and 64 bits of each token (0: field)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seen = {h: (leaf, found) for _, leaf, h, found in zip(*parse(text.as_py(), depth, least_tokens, constant), strict=True)}
                for line, (leaf, found) in seen.items():
                    rows.append((doc, key, leaf, line, found.astype("<u8").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "doc_id", "leaf", "line", "tokens"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return store(rows.mapInArrow(run, "doc long, doc_id long, leaf long, line long, tokens binary"))


_SPREAD = "key long, line long, n long, docs long, size long"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, n, docs, tokens) to a row for each constant token, under one key for its leaf, its place and its 64 bits."""
    for batch in batches:
        found = [np.frombuffer(t.as_buffer(), "<u8") for t in batch.column(4)]
        size = np.asarray([len(f) for f in found], dtype=np.int64)
        flat = np.concatenate(found) if found else np.empty(0, "<u8")
        row = np.repeat(np.arange(len(size)), size)
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        keep = flat != 0
        leaf, line, n, docs = (batch.column(i).to_numpy(zero_copy_only=False)[row[keep]] for i in range(4))
        with np.errstate(over="ignore"):
            own = mix(flat[keep].astype(np.uint64) ^ mix((spot[keep] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            key = mix(own + leaf.astype(np.int64).view(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (key, line, n, docs, size[row[keep]]))], ["key", "line", "n", "docs", "size"])


def _near(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """A test for long columns: true for every value of `key` and few others, by a bit for each value of FILTER_BITS bits, so at most 8 MB, whatever the data. What fails it needn't be shuffled to be joined with `keys`."""
    at = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select((at / 64).cast("long").alias("word"), F.col(key).bitwiseAND(F.lit(63)).cast("int").alias("spot"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, spot)")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(bits)

    def test(values: pd.Series) -> pd.Series:
        value = values.to_numpy().view(np.uint64)
        spot = value & np.uint64((1 << FILTER_BITS) - 1)
        return pd.Series((held.value.view(np.uint64)[spot >> np.uint64(6)] >> (value & np.uint64(63)) & np.uint64(1)).astype(bool))

    return F.pandas_udf(test, "boolean")


def templates(found: DataFrame, tokens: DataFrame, least_docs: int, constant: float, passage_docs: int) -> DataFrame:
    """Stored (leaf, line, template, n_docs, first): lines whose template `least_docs` documents or more have, or that are passages and in `passage_docs`, and the first of these; `tokens`, the lines with these, is dropped once it is read."""
    first = F.min(F.struct("doc_id", "doc")).alias("first")
    kinds = store(found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), first, F.max("passage").alias("passage")))
    leaves = store(kinds.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).where(F.col("docs") >= least_docs))
    several = leaves.where("lines > 1").select("leaf", "docs")
    shared = _near(several, "leaf")
    busy = store(kinds.where(shared("leaf")).join(several, "leaf").select("leaf", "line", "n", "docs", "first", "passage"))
    # the first document's line; rows may repeat, and their group is what the join has already brought together
    own = tokens.where(shared("leaf")).select("line", "doc", "tokens").join(busy.select("leaf", "line", "n", "docs", F.col("first.doc").alias("doc")), ["line", "doc"])
    own = own.groupBy("line", "doc").agg(*[F.min(c).alias(c) for c in ("leaf", "n", "docs", "tokens")])
    each = store(own.select("leaf", "line", "n", "docs", "tokens").mapInArrow(_spread, _SPREAD))
    drop(tokens)
    common = each.groupBy("key").agg(F.sum("n").alias("support"), F.min("docs").alias("docs")).where(F.col("support") >= least_docs)
    common = store(common.select("key", (F.col("support") / F.col("docs")).alias("share")))
    has = [F.col("share") >= s for s in SHARES]
    sums = [F.sum(F.when(h, F.xxhash64("key").cast("decimal(20,0)"))).alias(f"sum{k}") for k, h in enumerate(has)]
    kept = [F.count(F.when(h, 1)).alias(f"kept{k}") for k, h in enumerate(has)]
    held = each.select("key", "line", "size").join(common, "key").groupBy("line").agg(*sums, *kept, F.min("size").alias("size"))
    # what a share leaves constant, a smaller one does too: lines of one template at a share are of one at every larger share
    general = F.coalesce(*[F.when(F.col(f"kept{k}") >= constant * F.col("size"), F.xxhash64(f"sum{k}", f"kept{k}", "size")) for k in range(len(SHARES))])
    general = store(held.select("line", general.alias("template")).where("template is not null"))
    # any other line is a template of its own, and recurs by itself or not at all
    often = (F.col("n") >= least_docs) | F.col("passage") & (F.col("n") >= passage_docs)
    alone = kinds.where(often).join(general.select("line"), "line", "left_anti").withColumn("template", F.xxhash64("line", F.lit("line")))
    parts = ["leaf", "line", "n", "first", "template", "passage"]
    named = store(busy.join(general, "line").select(*parts).union(alone.select(*parts)))
    recurring = store(named.groupBy("leaf", "template").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"), F.max(often).alias("often")).where((F.col("n_docs") >= least_docs) | F.col("often")))
    out = store(named.select("leaf", "line", "template").join(recurring, ["leaf", "template"]).select("leaf", "line", "template", "n_docs", "first"))
    for x in (kinds, leaves, busy, each, common, general, named, recurring):
        drop(x)
    return out


def dedup(docs: DataFrame, least_docs: int = 3, depth: int = 3, least_tokens: int = 3, constant: float = 0.7, passage_tokens: int = 51, passage_docs: int = 2) -> DataFrame:
    """docs with recurring lines dropped from text, and n_lines, n_dropped (long).

    A line has `least_tokens` tokens or more, at least `constant` of them without a digit. A template keeps
    at least `constant` of a line's tokens, those that `least_docs` documents and one of SHARES of its leaf's have, and recurs if `least_docs` documents or more have it, or if `passage_docs` have a line of it
    that has `passage_tokens` tokens or more and is the same but for tokens with a digit; the document with
    the smallest doc_id (null first) keeps its lines of that template, so nothing is lost from the
    corpus as a whole. A null text stays null, an empty one empty; neither has lines. Rows that repeat
    doc_id and text count as documents and are treated alike. Columns named n_lines or n_dropped give
    way, others stay. An empty table gives no rows.
    """
    tokens = lines(docs, depth, least_tokens, constant)
    found = store(tokens.select("doc", "doc_id", "leaf", "line", (F.octet_length("tokens") >= 8 * passage_tokens).alias("passage")))
    again = templates(found, tokens, least_docs, constant, passage_docs)
    later = found.where(_near(again, "line")("line")).join(again.select("leaf", "line", "first"), ["leaf", "line"])
    later = later.where(~F.struct("doc_id", "doc").eqNullSafe(F.col("first")))
    drops = store(later.groupBy("doc").agg(F.collect_set("line").alias("__drop")))  # one document's lines at most
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    packed = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.struct(*rest).alias("__rest"), F.col("text").cast("string").alias("text"))
    loses = _near(drops, "doc")
    met = packed.where(loses("doc")).join(drops, "doc", "left").select("__rest", "text", "__drop")
    # texts that lose nothing stay where they are
    total = F.when(F.col("text") != "", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).otherwise(0)
    whole = packed.where(~loses("doc")).select("__rest", "text", total.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, dropped in zip(batch.column(1), batch.column(2), strict=True):
                t, d = text.as_py(), dropped.as_py()
                total.append(len(t.split("\n")) if t else 0)
                if d:
                    number, _, line, _ = parse(t, depth, least_tokens, constant)
                    out, parts = set(number[np.isin(line, d)].tolist()), t.split("\n")
                    kept = [p for i, p in enumerate(parts) if i not in out]
                    gone.append(len(parts) - len(kept))
                    t = "\n".join(kept)
                else:
                    gone.append(0)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["__rest", "text", "n_lines", "n_dropped"])

    kind = met.schema["__rest"].dataType.simpleString()
    out = met.mapInArrow(run, f"__rest {kind}, text string, n_lines long, n_dropped long").union(whole)
    return out.select(*[F.col(f"__rest.`{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
