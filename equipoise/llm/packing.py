"""Best-fit packing by minimum bin slack.

Documents become token ids closed by an end id; only one that is longer than a sequence is cut, into
pieces of the full size of which the first may be shorter. Pieces of one length are interchangeable, so
the packing is worked out over the histogram of lengths, at most `size` numbers whatever the data: for
each bin the longest piece left is fixed, a bitset subset-sum over the lengths left finds the fullest
combination with it, and that is removed as often as the counts allow. Pieces then take their places by
their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .encode import encoder, read_tokenizer
from .shared import buckets, running, store

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, piece (from 0), start, length, ids_crc32, and the ids themselves if asked for.

    A null or empty text is the end id alone. Rows that repeat, or whose doc_id is null, are documents
    like others. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                total, at, k = len(ids) // 4, 0, 0
                while at < total:
                    long = (total - at) % size or size if k == 0 else size
                    part = ids[4 * at : 4 * (at + long)]
                    rows.append((key, k, at, long, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else (key, k, at, long, zlib.crc32(part)))
                    at, k = at + long, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            cols = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], [x.split()[0] for x in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kind)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of `counts` pieces of each length, a combination whose sum is as near to `room` as can be; longer pieces are preferred."""
    reach, seen = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts):
        if length > room:
            break
        seen.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            reach = grown
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in reversed(seen):
        while not before >> at & 1:
            out[length] = out.get(length, 0) + 1
            at -= length
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each length in every one of them), until no piece is left."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        combination = fullest(rest, size - longest)
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        out.append((times, combination))
        for n, k in combination.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def places(made: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces a bin, first bin, offset) for the pieces of each length in each run of equal bins."""
    used: dict[int, int] = {}
    out, first_bin = [], 0
    for times, combination in made:
        offset = 0
        for length in sorted(combination, reverse=True):
            k, rank = combination[length], used.get(length, 0)
            out.append((length, rank, rank + times * k - 1, k, first_bin, offset))
            used[length] = rank + times * k
            offset += k * length
        first_bin += times
    return out


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """Place stored pieces: the columns of `cut`, sequence_id long and offset long.

    A piece's rank among those of its length comes from sums over hash buckets, so a length that a third
    of all pieces have is spread like any other. The table of places grows with `size` alone (each run of
    equal bins uses up some length's largest feasible multiplicity: under size * ln(size) runs).
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `size` rows at most
    table = cut.sparkSession.createDataFrame(places(plan(histogram, size)), "len int, first long, last long, each long, bin long, base long")
    n = buckets(sum(histogram.values()), 64, 50_000)
    keyed = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    ranked = running(keyed, ["length"], "__bucket", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], {"__rank": "1L"})
    put = ranked.join(F.broadcast(table), (F.col("length") == F.col("len")) & F.col("__rank").between(F.col("first"), F.col("last")))
    step = F.col("__rank") - F.col("first")
    return put.select(*cut.columns, (F.col("bin") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("base") + step % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """Cut and place in one go; texts are encoded once, and the pieces' lengths kept in the shared folder."""
    return pack(store(pieces(docs, size, end_id, tokenizer_path)), size)
